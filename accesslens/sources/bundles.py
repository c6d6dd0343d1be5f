"""Load a trained detector."""

from __future__ import annotations

from pyspark.sql import SparkSession

from accesslens.models.bundle import Bundle
from accesslens.schemas import BUNDLE


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """Read the single-row bundle table at ``path`` (any file system Spark can read)."""
    rows = spark.read.schema(BUNDLE).json(path).take(2)
    if len(rows) != 1:
        raise ValueError(f"expected one detector at {path}")
    return Bundle.from_dict(rows[0].asDict(recursive=True))
