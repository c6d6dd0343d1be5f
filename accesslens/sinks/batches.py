"""Tables that grow by batches, each published by one row of a manifest.

A batch is written to a folder of its own that nobody reads yet (``data/batch_id=N/attempt=A``).  Then one row is
appended to the manifest, as one file that appears at once: which attempt holds the batch, and its counts.  Readers
take the newest row of each batch, so they see a batch as it was or as it is, never without it, also while it is
replayed.  The counts are of what was written, so a total needs no scan of the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from accesslens.schemas import MANIFEST
from accesslens.session import broadcast_small, cut_lineage
from accesslens.sinks import files

#: Batches whose manifest rows share a folder, and later a file.
BLOCK = 1000


def _attempts(path: str) -> str:
    return f"{path.rstrip('/')}/data"


def _manifest(path: str) -> str:
    return f"{path.rstrip('/')}/manifest"


def write_aside(df: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> str:
    """Write a batch where no reader looks yet; returns the attempt's name."""
    attempt = uuid.uuid4().hex
    df.write.partitionBy(*partition_by).parquet(f"{_attempts(path)}/batch_id={batch_id}/attempt={attempt}")
    return attempt


def publish(spark: SparkSession, path: str, batch_id: int, attempt: str, schema: T.StructType, flag: str = "is_anomaly", key: str | None = "id") -> None:
    """Make an attempt the one that readers see, with counts of what it holds.

    Only the flag's folder names and the key column are read again.  A batch has one writer at a time, as a streaming
    query's batches have; publishing the same attempt twice changes nothing.
    """
    written = spark.read.schema(schema).parquet(f"{_attempts(path)}/batch_id={batch_id}/attempt={attempt}")
    greatest = F.max(key).cast("decimal(38,0)") if key else F.lit(None).cast("decimal(38,0)")
    facts = written.agg(F.count("*").alias("total"), F.count_if(flag).alias("anomalies"), greatest.alias("greatest_id")).first()
    before = live_batches(spark, path).filter(F.col("batch_id") == batch_id).select("version", "attempt").first()
    if before and before["attempt"] == attempt:
        return
    row = (batch_id, attempt, before["version"] + 1 if before else 1, facts["total"], facts["anomalies"], facts["greatest_id"])
    (spark.createDataFrame([row], T.StructType(MANIFEST.fields[:-1])).coalesce(1)
     .write.mode("append").parquet(f"{_manifest(path)}/block={batch_id // BLOCK}"))


def publish_batch(df: DataFrame, path: str, batch_id: int, flag: str = "is_anomaly", key: str | None = "id") -> None:
    """Write one batch, split by its flag, and publish it; the batch of that id before, if any, is replaced."""
    attempt = write_aside(df, path, batch_id, [flag])
    publish(df.sparkSession, path, batch_id, attempt, df.schema, flag, key)


def manifest_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the manifest, superseded ones included."""
    if not files.exists(spark, _manifest(path)):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("basePath", _manifest(path)).parquet(_manifest(path))


def live_batches(spark: SparkSession, path: str) -> DataFrame:
    """The newest manifest row of each batch."""
    newest = F.max(F.struct("version", "attempt", "total", "anomalies", "greatest_id")).alias("_row")
    return manifest_rows(spark, path).groupBy("batch_id").agg(newest).select("batch_id", "_row.*")


def _rows(spark: SparkSession, path: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    with_attempt = T.StructType([*schema.fields, T.StructField("attempt", T.StringType())])
    return spark.read.schema(with_attempt).option("basePath", _attempts(path)).parquet(*folders)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All published rows.  The manifest is settled before the folders are listed, so what it names is there."""
    live = cut_lineage(live_batches(spark, path).select("batch_id", "attempt"))
    if live.isEmpty():
        return spark.createDataFrame([], schema)
    rows = _rows(spark, path, schema, [_attempts(path)])
    return rows.join(broadcast_small(live), ["batch_id", "attempt"], "left_semi").select(*schema.fieldNames())


def read_newest_flagged(spark: SparkSession, path: str, schema: T.StructType, limit: int, flag: str = "is_anomaly") -> DataFrame:
    """Flagged rows of the newest batches that hold at least ``limit`` of them: other folders are not opened.

    At most ``limit`` rows of the manifest come to the driver, since each names a batch with a flagged row.
    """
    heads = live_batches(spark, path).filter("anomalies > 0").orderBy(F.desc("batch_id")).limit(limit).collect()
    folders, held = [], 0
    for row in heads:
        folders.append(f"{_attempts(path)}/batch_id={row['batch_id']}/attempt={row['attempt']}/{flag}=true")
        held += row["anomalies"]
        if held >= limit:
            break
    if not folders:
        return spark.createDataFrame([], schema)
    return _rows(spark, path, schema, folders).select(*schema.fieldNames())


def fold_manifest(spark: SparkSession, path: str) -> None:
    """Write each full block's manifest rows into one file.  Rows that are there twice meanwhile count once."""
    blocks = [n for n in files.names(spark, _manifest(path)) if n.startswith("block=")]
    newest = max((int(n.partition("=")[2]) for n in blocks), default=0)
    for name in blocks:
        folder = f"{_manifest(path)}/{name}"
        parts = [n for n in files.names(spark, folder) if n.startswith("part-")]
        if int(name.partition("=")[2]) < newest and len(parts) > 1:
            rows = spark.read.schema(T.StructType(MANIFEST.fields[:-1])).parquet(*[f"{folder}/{n}" for n in parts])
            rows.distinct().coalesce(1).write.mode("append").parquet(folder)
            for n in parts:
                files.delete(spark, f"{folder}/{n}")


def drop_superseded(spark: SparkSession, path: str) -> int:
    """Delete attempts that a later one of their batch has replaced; returns how many.  Run it when no reader is on them."""
    live = live_batches(spark, path).select("batch_id", F.col("version").alias("_live"), F.col("attempt").alias("_attempt"))
    old = (manifest_rows(spark, path).join(live, "batch_id").filter("version < _live AND attempt <> _attempt")
           .select("batch_id", "attempt").distinct())
    dropped = 0
    for row in old.toLocalIterator():
        folder = f"{_attempts(path)}/batch_id={row['batch_id']}/attempt={row['attempt']}"
        if files.exists(spark, folder):
            files.delete(spark, folder)
            dropped += 1
    return dropped
