"""Write lines and messages to topics or files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.sinks import files


def publish_topic(df: DataFrame, servers: str, topic: str) -> None:
    """Send ``value`` (and ``key``, if there is one) rows to a topic.

    Needs Spark's own Kafka connector on the class path.
    """
    df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_text(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write ``value`` rows as lines of text files."""
    df.select("value").write.mode(mode).text(path)


def publish_once(df: DataFrame, path: str, batch_id: int) -> bool:
    """Write one micro-batch of ``value`` rows as a folder of text files that appears whole, and only the first time.

    The folder is written aside and renamed.  A batch that was published before is left as it is, so a replay adds
    nothing for readers of ``path/batch-*``; returns whether this call published it.
    """
    spark, final = df.sparkSession, f"{path.rstrip('/')}/batch-{batch_id:012d}"
    if files.exists(spark, final):
        return False
    aside = f"{path.rstrip('/')}/_{uuid.uuid4().hex}"
    df.select("value").write.text(aside)
    return files.rename(spark, aside, final)


def publish_shards(keyed: DataFrame, path: str, shards: int, mode: str = "error") -> None:
    """Write keyed rows so that equal keys share a shard folder.

    ``rebalance`` lets adaptive execution cut the shard of a hot key into several
    files instead of handing it to one task.
    """
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    rows = keyed.select("key", "value", shard.alias("shard"))
    rows.hint("rebalance", "shard").write.mode(mode).partitionBy("shard").parquet(path)
