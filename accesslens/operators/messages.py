"""Requests and verdicts as the JSON messages between pipeline stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.functions.log_format import is_parseable, iso_timestamp
from accesslens.functions.request_features import feature_array
from accesslens.operators.featurizing import add_features
from accesslens.operators.parsing import parse_requests
from accesslens.operators.scoring import score_features
from accesslens.operators.settling import settle
from accesslens.models.bundle import Bundle
from accesslens.sources.logs import drop_blank
from accesslens.schemas import PARSED_MESSAGE, SCORED_MESSAGE, VERDICT_MESSAGE


def parsed_records(df: DataFrame, column: str = "value", offset: str = "offset", keep=(),
                   unparsed: bool = False) -> DataFrame:
    """Raw lines to ``offset, raw, record, features``; unparseable lines go.

    ``unparsed`` keeps all lines, told apart by ``parsed`` (see ``parse_requests``).
    """
    requests = parse_requests(df.select(*keep, F.col(offset).alias("offset"), F.col(column).alias("_message")),
                              "_message", [*keep, "offset", "_message"], unparsed)
    keep = [*keep, "parsed"] if unparsed else keep
    featured = add_features(requests)
    timestamp = iso_timestamp(F.col("ts"), F.col("tz_offset"))
    fields = [f.name for f in PARSED_MESSAGE["record"].dataType]
    record = F.struct(*[(timestamp if f == "timestamp" else F.col(f)).alias(f) for f in fields])
    return featured.select(*keep, "offset", F.col("_message").alias("raw"), record.alias("record"),
                           feature_array().alias("features"))


def verdicts(parsed: DataFrame, bundle: Bundle, top_k: int = 3, keep=()) -> DataFrame:
    """``parsed_records`` rows to verdict rows.  Features are used as they arrive.

    The rest of the record goes first: every layer of the network would else copy it.
    """
    shown = [f.name for f in SCORED_MESSAGE["record"].dataType]
    needed = parsed.select(*keep, "offset", "raw", *[F.col(f"record.{c}").alias(c) for c in shown], "features")
    return score_features(needed, bundle, top_k).select(
        *keep, "offset", "raw", *shown, "score", "is_anomaly", "threshold", "drivers")


def _encode(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One JSON message per row; a log's name goes with the offset where the rows have one.

    The message is settled: a parser of it would else evaluate the whole record inside its own expression, uncompiled.
    """
    named = [*fields, *[c for c in ("file",) if c in rows.columns]]
    return settle(rows.select(F.to_json(F.struct(*named), {"ignoreNullFields": "false"}).alias("value")), [], "value")


def encode_parsed(parsed: DataFrame) -> DataFrame:
    return _encode(parsed, PARSED_MESSAGE.fieldNames())


def encode_verdicts(rows: DataFrame) -> DataFrame:
    return _encode(rows, VERDICT_MESSAGE.fieldNames())


def keyed_lines(df: DataFrame, column: str = "value", limit: int | None = None) -> DataFrame:
    """Non-blank lines keyed by client address, ``unknown`` where a line does not parse.

    The key orders and routes messages in a topic.  No shuffle by key happens
    here, so an address that sends a third of all lines makes no task large.
    """
    lines = drop_blank(df.select(F.col(column).alias("value")))
    if limit is not None:
        lines = lines.limit(limit)
    key = F.when(is_parseable(F.col("value")), F.substring_index("value", " ", 1)).otherwise(F.lit("unknown"))
    return lines.select(key.alias("key"), "value")
