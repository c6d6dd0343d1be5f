"""Session settings and shared storage that the library relies on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scan partitions that a session is given at least, as far as its files fill them (``spark.sql.files.openCostInBytes``).
SCAN_PARTITIONS = 64
#: Rows that a broadcast may hold.
BROADCAST_ROWS = 1_000_000
_CHECKPOINT_DIR = "spark.checkpoint.dir"
_HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"
_MIN_PARTITIONS = "spark.sql.files.minPartitionNum"


def tune(spark: SparkSession) -> SparkSession:
    """Keep generated methods small enough for the JIT, unless the session says otherwise.

    HotSpot never compiles a method above 8000 bytes of bytecode.  Parsing and
    scoring fuse into larger ones, which would then run interpreted (measured:
    eight times slower), so such stages are left unfused instead.  The number of scan partitions is pinned,
    so that two passes over the same files cut them alike; not below ``SCAN_PARTITIONS``, for the executors that are
    there when a session starts may be few, and a scan of one part for each core waits for the slowest.
    """
    if spark.conf.get(_HUGE_METHOD, "65535") == "65535":
        spark.conf.set(_HUGE_METHOD, "8000")
    if spark.conf.get(_MIN_PARTITIONS, None) is None:
        spark.conf.set(_MIN_PARTITIONS, str(max(SCAN_PARTITIONS, spark.sparkContext.defaultParallelism)))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a temporary one in local mode only."""
    path = spark.conf.get(_CHECKPOINT_DIR, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="accesslens-")
        spark.conf.set(_CHECKPOINT_DIR, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder; the folder around it is deleted when the session's JVM ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return f"{folder.toString()}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialize in the shared folder, so that lost executors lose no work."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def broadcast_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialized table of ids and numbers for broadcasting if it was counted to be small; else Catalyst chooses."""
    return F.broadcast(df) if df.count() <= limit else df
