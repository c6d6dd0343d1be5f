"""Features to verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.functions import verdicts as v
from accesslens.models.bundle import Bundle
from accesslens.operators.featurizing import add_features
from accesslens.operators.parsing import parse_requests
from accesslens.operators.settling import settle
from accesslens.schemas import FEATURE_NAMES


def _named(prefix: str, expressions: list[str]) -> tuple[list[str], list[str]]:
    names = [f"_{prefix}{i}" for i in range(len(expressions))]
    return names, [f"{e} AS {n}" for n, e in zip(names, expressions)]


def _scaled(inputs: list[str], bundle: Bundle) -> list[str]:
    return [v.standardized(c, m, s) for c, m, s in zip(inputs, bundle.mean, bundle.std)]


def standardize(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Replace every feature column by (x - mean) / std."""
    scaled = {n: f"{sql} AS {n}" for n, sql in zip(bundle.feature_names, _scaled(bundle.feature_names, bundle))}
    return df.selectExpr(*[scaled.get(c, f"`{c}`") for c in df.columns])


def _forward(df: DataFrame, bundle: Bundle) -> tuple[DataFrame, list[str], list[str], list[str]]:
    """Run the network; returns the frame with its columns, the kept ones, the standardized inputs and the outputs."""
    keep = [f"`{c}`" for c in df.columns]
    named = set(FEATURE_NAMES) <= set(df.columns)
    inputs = FEATURE_NAMES if named else [f"get(features, {i})" for i in range(bundle.n_features)]
    x, columns = _named("x", _scaled(inputs, bundle))
    out = df.selectExpr(*keep, *columns)
    h = x
    for depth, (w, b) in enumerate(zip(bundle.weights, bundle.biases)):
        last = depth == len(bundle.weights) - 1
        h, columns = _named(f"h{depth}_", v.layer(h, w, b, not last))
        out = out.selectExpr(*keep, *x, *columns)
    return out, keep, x, h


def reconstruct(df: DataFrame, bundle: Bundle, name: str = "recon") -> DataFrame:
    """Add what the network makes of each row's standardized features, as an array in their order."""
    out, keep, _, h = _forward(df, bundle)
    return settle(out.selectExpr(*keep, f"array({', '.join(h)}) AS {name}"), keep, name)


def add_errors(df: DataFrame, bundle: Bundle) -> tuple[DataFrame, list[str]]:
    """The frame with the squared errors of its rows, and SQL for each of them.

    Features come from the twenty named columns, or from ``features`` if those are absent.
    """
    out, keep, x, h = _forward(df, bundle)
    squares = ", ".join(f"({r} - {n}) * ({r} - {n})" for r, n in zip(h, x))
    out = out.selectExpr(*keep, f"array({squares}) AS _errors")
    return settle(out, keep, "_errors"), [f"get(_errors, {i})" for i in range(bundle.n_features)]


def score_features(df: DataFrame, bundle: Bundle, top_k: int = 3) -> DataFrame:
    """Add ``error``, ``score``, ``is_anomaly``, ``threshold``, ``drivers`` and ``top_features``.

    ``error`` is unrounded and decides the verdict; ``score`` is its rounded form.
    """
    if not 1 <= top_k <= bundle.n_features:
        raise ValueError(f"top_k must be between 1 and {bundle.n_features}")
    keep = [f"`{c}`" for c in df.columns]
    threshold = f"{bundle.threshold!r}D"
    out, errors = add_errors(df, bundle)
    out = out.selectExpr(*keep, f"{v.mean_of(errors)} AS error",
                         f"{v.ranked_errors(errors, bundle.feature_names, top_k)} AS _ranked")
    return out.selectExpr(
        *keep, "error", "round(error, 5) AS score", f"error > {threshold} AS is_anomaly",
        f"{threshold} AS threshold", "_ranked.feature AS drivers",
        f"{v.contributions('_ranked', top_k)} AS top_features")


def score_lines(df: DataFrame, bundle: Bundle, column: str = "value", keep=("line_no",), top_k: int = 3,
                unparsed: bool = False) -> DataFrame:
    """Raw lines to scored requests; unparseable lines go, ``keep`` columns stay.

    ``unparsed`` keeps all lines, told apart by ``parsed`` (see ``parse_requests``).
    """
    featured = add_features(parse_requests(df, column, keep, unparsed))
    return score_features(featured, bundle, top_k).drop(*FEATURE_NAMES)


def score_parity(df: DataFrame, bundle: Bundle, top_k: int = 3) -> DataFrame:
    """How far the column scorer and the vectorized UDF scorer differ (one row)."""
    scored = score_features(df, bundle, top_k)
    recon = v.reconstruct_udf(df.sparkSession, bundle)
    both = scored.select("error", "drivers", F.array(*FEATURE_NAMES).alias("_f"))
    both = both.select("error", "drivers", "_f", recon("_f").alias("_recon"))
    x = _scaled([f"get(_f, {i})" for i in range(bundle.n_features)], bundle)
    errors, columns = _named("u", [f"pow(get(_recon, {i}) - {sql}, 2)" for i, sql in enumerate(x)])
    both = both.selectExpr("error", "drivers", *columns).selectExpr(
        "error", "drivers", f"{v.mean_of(errors)} AS _other",
        f"{v.ranked_errors(errors, bundle.feature_names, top_k)}.feature AS _drivers")
    return both.agg(
        F.count("*").alias("n_rows"),
        F.max(F.abs(F.col("error") - F.col("_other"))).alias("max_score_diff"),
        F.count_if(F.col("drivers") != F.col("_drivers")).alias("n_driver_mismatches"),
    )
