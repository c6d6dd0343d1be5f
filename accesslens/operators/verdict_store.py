"""Rows and reads of the verdict table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.operators.reports import rate
from accesslens.schemas import DECIMAL_TABLE, VERDICT_TABLE
from accesslens.sinks.batches import live_batches, read_batches, read_newest_flagged

MAX_RECENT = 500


def verdict_id(batch_id: int) -> Column:
    """A unique id that grows with the batch: the row's place in the batch, and 2 ** 63 for each batch before.

    It needs no pass over the batch and is the same when the batch is replayed.
    """
    return (F.lit(str(batch_id << 63)).cast("decimal(38,0)") + F.monotonically_increasing_id().cast("decimal(20,0)")).cast("decimal(38,0)")


def stored_rows(verdicts: DataFrame, batch_id: int = 0) -> DataFrame:
    """Verdict messages as table rows: id, processing time, the log's name if known, and defaults for absent fields."""
    return verdicts.select(
        verdict_id(batch_id).alias("id"), F.current_timestamp().alias("ts"),
        F.col("file") if "file" in verdicts.columns else F.lit(None).cast("string").alias("file"), "offset", "raw", "method", "path", "query", "status", "score", "threshold",
        F.coalesce("drivers", F.array().cast("array<string>")).alias("drivers"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
    )


def decimal_rows(verdicts: DataFrame) -> DataFrame:
    """The same rows for a store without binary floats, 0 when absent.

    ``score`` and ``threshold`` are decimals of 17 places, null where a number does not fit 38 digits;
    ``score_text`` and ``threshold_text`` have all digits of every number.
    """
    numbers = ("score", "threshold")

    def text(name):
        return F.coalesce(F.col(name), F.lit(0.0)).cast("string")
    return verdicts.select(
        *[text(c).try_cast("decimal(38,17)").alias(c) if c in numbers else F.col(c) for c in verdicts.columns
          if c not in ("drivers", "is_anomaly")],
        *[text(c).alias(f"{c}_text") for c in numbers],
        F.coalesce("drivers", F.array().cast("array<string>")).alias("drivers"),
        F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
    )


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """All verdicts that are published."""
    return read_batches(spark, path, VERDICT_TABLE)


def read_decimals(spark: SparkSession, path: str) -> DataFrame:
    """All verdicts of a table that ``store_decimals`` wrote."""
    return read_batches(spark, path, DECIMAL_TABLE)


def _with_rate(counts: DataFrame) -> DataFrame:
    return counts.select("total", "anomalies", rate(F.col("anomalies"), F.col("total")).alias("anomaly_rate"))


def verdict_stats(verdicts: DataFrame) -> DataFrame:
    """Total, anomalies and rate of a frame of verdicts (one row, zeros for an empty one)."""
    return _with_rate(verdicts.agg(F.count("*").alias("total"), F.count_if("is_anomaly").alias("anomalies")))


def stored_stats(spark: SparkSession, path: str) -> DataFrame:
    """The same of a whole verdict table, from the counts of its batches: no verdict is read."""
    return _with_rate(live_batches(spark, path).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "anomalies")]))


def _checked(limit: int) -> int:
    if not 1 <= limit <= MAX_RECENT:
        raise ValueError(f"limit must be between 1 and {MAX_RECENT}")
    return limit


def recent_anomalies(verdicts: DataFrame, limit: int = 50, order: str = "id") -> DataFrame:
    """The newest flagged verdicts of a frame first."""
    return verdicts.filter("is_anomaly").orderBy(F.desc(order)).limit(_checked(limit))


def read_recent(spark: SparkSession, path: str, limit: int = 50, order: str = "id") -> DataFrame:
    """The newest flagged verdicts of a verdict table first: newest batch first, ``order`` inside it.

    Only the flagged folders of the newest batches that fill the limit are opened, however long the table is.
    """
    newest = read_newest_flagged(spark, path, VERDICT_TABLE, _checked(limit))
    return newest.orderBy(F.desc("batch_id"), F.desc(order)).limit(limit)
