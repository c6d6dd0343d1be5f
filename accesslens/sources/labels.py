"""Ground-truth labels per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.schemas import FILE_LABELS, LABELS


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, label`` from CSV with a header; the last row of a line number wins."""
    rows = spark.read.csv(path, schema=LABELS, header=True, enforceSchema=False).select(
        "line_no", "label",
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                 F.monotonically_increasing_id()).alias("_position"))
    return rows.groupBy("line_no").agg(F.max_by("label", "_position").alias("label"))


def normal_name(name):
    """A log's name below its folder: no leading ``./`` or ``/``, no doubled slashes, ``/`` as the separator."""
    return F.regexp_replace(F.regexp_replace(F.replace(F.trim(name), F.lit("\\"), F.lit("/")), "/+(\\./+)*", "/"), "^(\\./|/)+", "")


def read_file_labels(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, label`` from CSV with a header: one label for each line of each file of a folder.

    A line with two different labels is an error; one that is repeated counts once.
    """
    rows = spark.read.csv(path, schema=FILE_LABELS, header=True, enforceSchema=False)
    keyed = rows.groupBy(normal_name(F.col("file")).alias("file"), "line_no").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    differs = F.raise_error(F.concat(F.lit("two labels for line "), F.col("line_no").cast("string"), F.lit(" of "), F.col("file"))).cast("int")
    return keyed.select("file", "line_no", F.when(F.col("label") == F.col("_other"), F.col("label")).when(F.col("label").isNotNull(), differs).alias("label"))
