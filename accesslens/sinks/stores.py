"""Write verdicts, detectors and usage rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.functions.visitors import visitor_hash
from accesslens.models.bundle import Bundle
from accesslens.operators.usage import usage_sketches
from accesslens.operators.verdict_store import decimal_rows, stored_rows
from accesslens.schemas import BUNDLE, SCAN_EVENTS, USAGE_SKETCHES
from accesslens.sinks.batches import publish_batch


def store_verdicts(verdicts: DataFrame, path: str, batch_id: int = 0) -> None:
    """Write one batch of verdicts.  A replayed batch replaces itself at once: readers see the old rows or the new ones."""
    publish_batch(stored_rows(verdicts, batch_id), path, batch_id)


def store_decimals(verdicts: DataFrame, path: str, batch_id: int = 0) -> None:
    """Write one batch of verdicts as decimals, for a store without binary floats."""
    publish_batch(decimal_rows(verdicts), path, batch_id, key=None)


def save_bundle(spark: SparkSession, bundle: Bundle, path: str, mode: str = "error") -> None:
    """Write the detector as a one-row JSON table on any file system Spark can write."""
    row = json.dumps(bundle.to_dict())
    spark.sql("SELECT from_json(:row, :schema) AS b",
              args={"row": row, "schema": BUNDLE.simpleString()}).select("b.*").write.mode(mode).json(path)


def record_scan(summary: DataFrame, path: str, scan_id: str, salt: str, ip: str = "") -> None:
    """Append one usage row from a scan summary: tallies and a salted hash, no address."""
    record_scans(summary.select(F.lit(scan_id).alias("scan_id"), "total_lines", "anomalies", F.lit(ip).alias("ip")), path, salt)


def record_scans(summaries: DataFrame, path: str, salt: str) -> None:
    """Append a usage row for each row ``scan_id, total_lines, anomalies, ip``, many to a file."""
    (summaries.select("scan_id", F.col("total_lines").alias("lines"), "anomalies", visitor_hash(F.col("ip"), salt).alias("visitor_hash"))
     .write.mode("append").parquet(path))


def record_sketches(spark: SparkSession, events_path: str, path: str, part: str) -> None:
    """Append one sketch row for the usage rows in a folder that was appended, such as a day's.

    The sketch is of what the folder holds.  A part that is recorded again is there twice; ``latest_sketches`` reads the
    newer row.
    """
    events = spark.read.schema(SCAN_EVENTS).parquet(events_path)
    usage_sketches(events, F.lit(part)).withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def latest_sketches(spark: SparkSession, path: str) -> DataFrame:
    """The newest sketch row of each part."""
    schema = T.StructType([*USAGE_SKETCHES.fields, T.StructField("at", T.TimestampType())])
    newest = F.max_by(F.struct("scans", "lines", "anomalies", "visitors"), "at").alias("_row")
    return spark.read.schema(schema).parquet(path).groupBy("part").agg(newest).select("part", "_row.*")
