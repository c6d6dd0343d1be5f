"""Quality scores from random Fourier features of document statistics.

Each text becomes STATISTICS numbers.  Standardised, they are projected to cosines whose products approximate a
Gaussian kernel.  Tasks sum the normal equations of their rows and Spark adds the sums row by row; the ridge solution
is small.  Isotonic regression over binned scores turns them into probabilities.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.language_id import held_out
from accesslens.session import cut_lineage

STATISTICS, FEATURES, RIDGE, BINS = 18, 256, 1.0, 1000
#: Bound on the labelled rows that fit the classifier; above it, rows are taken by the hash of their id.
TRAINING_ROWS = 200_000
_CLASSES = {c: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for c, chars in {
    "digit": b"0123456789", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "stop": b".?!", "comma": b",;:", "symbol": b"#$%&*+<=>@^_|~\\/{}[]",
    "bang": b"!", "space": b" \t\n\x0b\x0c\r", "line": b"\n"}.items()}
_SUMS = np.array(list(_CLASSES.values()), np.float64).T


def statistics(text: str | None) -> np.ndarray:
    """Numbers about one whole text; of an empty one all are zero."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return np.zeros(STATISTICS)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    digit, upper, stop, comma, symbol, bang, space, line = seen @ _SUMS
    words = text.split()
    n, m = len(raw), max(1, len(words))
    share = seen[seen > 0] / n
    lines = text.split("\n")
    again = sum(map(str.__eq__, words, words[1:]))
    return np.array([
        np.log1p(n), np.log1p(len(words)), (n - space) / m, len(set(words)) / m, digit / n, upper / n, stop / m, comma / m,
        symbol / n, bang / m, line / m, space / n, -(share * np.log(share)).sum(), again / m,
        np.log1p(max(map(len, words), default=0)), len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / n, (raw[0] < 97) * 1.0])


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x) for each row, x the statistics."""
    def run(batches):
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(1)]).reshape(-1, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(x.ravel(), STATISTICS).cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Kernel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """A constant and FEATURES cosines of the standardised statistics, outliers drawn in."""
        rng = np.random.default_rng(7)
        w, b = rng.normal(size=(STATISTICS, FEATURES)) / np.sqrt(STATISTICS), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ w + b)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), *self.knots)


def isotonic(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to mean, weighed by n (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for weight, value in zip(n, mean, strict=True):
        blocks.append([weight, value, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w, v, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w, (blocks[-1][0] * blocks[-1][1] + w * v) / (blocks[-1][0] + w), blocks[-1][2] + k]
    return np.concatenate([np.full(k, v) for _, v, k in blocks]) if blocks else np.empty(0)


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(-1, STATISTICS)


def fit(rows: DataFrame) -> Kernel | float:
    """Fit on rows (x, y); without both classes, the share of ones (0.5 if there are no rows)."""
    spark = rows.sparkSession
    n, ones = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not ones or ones == n:
        return float(ones / n) if n else 0.5
    parts = [f(F.col("x")[i]).alias(f"{k}{i}") for i in range(STATISTICS) for k, f in (("m", F.avg), ("s", F.stddev_pop))]
    sums = rows.agg(*parts).first()
    kernel = Kernel(np.array([sums[f"m{i}"] for i in range(STATISTICS)]), np.array([max(sums[f"s{i}"], 1e-6) for i in range(STATISTICS)]))
    width = FEATURES + 1
    shared = spark.sparkContext.broadcast(kernel)

    def equations(batches):
        total = np.zeros((width, width + 1))
        for batch in batches:
            z = shared.value.features(_matrix(batch))
            total += z.T @ np.hstack([z, batch.column("y").to_numpy().astype(float)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": part["i"].iloc[:1], "row": [np.sum(np.vstack(part["row"]), axis=0)]})

    added = rows.select("x", "y").mapInArrow(equations, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>").toPandas().sort_values("i")
    total = np.vstack(added["row"])
    kernel.weights = np.linalg.solve(total[:, :width] + RIDGE * np.eye(width), total[:, width])
    fitted = spark.sparkContext.broadcast(kernel)

    def binned(batches):
        for batch in batches:
            raw = fitted.value.raw(_matrix(batch))
            yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor(raw * BINS), -BINS, 2 * BINS).astype(np.int64)), pa.array(raw), batch.column("y").cast(pa.float64())], ["bin", "raw", "y"])

    bins = (rows.select("x", "y").mapInArrow(binned, "bin long, raw double, y double").groupBy("bin")
            .agg(F.count("*").alias("n"), F.avg("raw").alias("raw"), F.avg("y").alias("y")).toPandas().sort_values("bin"))
    kernel.knots = (bins["raw"].to_numpy(), np.clip(isotonic(bins["n"].to_numpy(float), bins["y"].to_numpy()), 0, 1))
    return kernel


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                  threshold: float = 0.5, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels of rows that are not held out (checksum of the id mod 3 is 1) are learned; a null label is none, and of an
    id labelled twice the greatest label counts.  Null texts are empty texts.  Without both classes every score is the
    share of ones, 0.5 without labels.  Other columns of docs are not read.
    """
    marked = cut_lineage(measured(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id"), 3, 1)))
    truth = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("y")).filter("y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    known = cut_lineage(marked.filter(~F.col("held_out")).join(truth, "doc_id").select("doc_id", "x", "y"))
    cut = int(min(1.0, training_rows / max(1, known.count())) * (1 << 31))
    model = docs.sparkSession.sparkContext.broadcast(fit(known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < cut).repartition(16, "doc_id")))

    def run(batches):
        for batch in batches:
            got = model.value
            score = got.score(_matrix(batch)) if isinstance(got, Kernel) else np.full(batch.num_rows, got)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    return marked.mapInArrow(run, f"doc_id {marked.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")
