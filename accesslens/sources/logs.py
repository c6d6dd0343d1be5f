"""Access-log text as DataFrames, batch and streaming."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accesslens.operators.parsing import parse_requests
from accesslens.session import scratch_path

_SPLIT_KEY = [F_FILE, F_BLOCK] = ["file", "_block"]


def _decoded(column: str = "value"):
    """Invalid UTF-8 becomes U+FFFD, as a lenient text decoder would do."""
    return F.make_valid_utf8(F.col(column).cast("string")).alias("value")


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """All lines of the files, blank and unparseable ones included."""
    return spark.read.text(paths).select(_decoded())


def read_requests(spark: SparkSession, paths) -> DataFrame:
    """The parseable lines of the files as structured requests."""
    return parse_requests(read_lines(spark, paths))


def drop_blank(df: DataFrame, column: str = "value") -> DataFrame:
    """Strip line ends and drop lines that are then empty."""
    stripped = F.rtrim(F.col(column), F.lit("\r\n"))
    return df.withColumn(column, stripped).filter(F.col(column) != "")


def _placed(reader, paths) -> DataFrame:
    """Decoded lines with the file and the split that they come from."""
    return reader(paths).select(_decoded(), F.col("_metadata.file_path").alias(F_FILE), F.col("_metadata.file_block_start").alias(F_BLOCK))


def count_splits(lines: DataFrame) -> DataFrame:
    """For each split of each file its first row's id, its lines, and the lines of the file before it.

    ``lines`` has ``file, _block, _id``.  The table is written, so Catalyst knows its size for the join.
    """
    before = Window.partitionBy(F_FILE).orderBy(F_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    counted = (
        lines.groupBy(*_SPLIT_KEY).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .select(*_SPLIT_KEY, "_first", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    kept = scratch_path(lines.sparkSession, "splits")
    counted.write.parquet(kept)
    return lines.sparkSession.read.parquet(kept)


def add_line_numbers(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``file, line_no, value`` from placed lines and the counts of their splits.  A row outside its split raises an error."""
    position = F.col("_id") - F.col("_first")
    inside = position.between(F.lit(0), F.col("_n") - 1)
    line_no = F.when(inside, F.col("_before") + position + 1).otherwise(
        F.raise_error(F.lit("the files were cut differently in the two passes")).cast("bigint"))
    return lines.join(splits, _SPLIT_KEY, "left").select(F_FILE, line_no.alias("line_no"), "value")


def number_lines(placed: DataFrame) -> DataFrame:
    """Number lines in their files, without sorting them: batch lines, or a micro-batch of a stream of placed lines.

    One pass counts the lines of every file split; a prefix sum over the splits of
    a file gives each split its first number.  The second pass only adds.  Both
    passes must cut the files alike: ``session.tune`` pins the number of scan
    partitions against a changing cluster size.
    """
    lines = placed.withColumn("_id", F.monotonically_increasing_id())
    return add_line_numbers(lines, count_splits(lines))


def read_numbered_lines(spark: SparkSession, paths, nested: bool = False) -> DataFrame:
    """Lines with their 1-based ``line_no`` in their ``file``; ``nested`` reads the folders below, too."""
    return number_lines(_placed(spark.read.option("recursiveFileLookup", nested).text, paths))


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """One uploaded log with line numbers; an upload without lines is an error, told by the counts of its splits."""
    lines = _placed(spark.read.text, path).withColumn("_id", F.monotonically_increasing_id())
    splits = count_splits(lines)
    if splits.isEmpty():
        raise ValueError("empty upload")
    return add_line_numbers(lines, splits)


def log_name(file, root: str):
    """A file's path below the folder (or the folder's own name, if it is the file), without scheme and escapes: how labels name a log."""
    bare = F.regexp_replace(F.url_decode(F.regexp_replace(file, r"\+", "%2B")), r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
    top = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "", root).strip("/")
    inside = F.substring(bare, F.lit(len(top) + 2), F.char_length(bare))
    return F.when(bare.startswith(f"{top}/"), inside).otherwise(F.substring_index(bare, "/", -1))


def stream_lines(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Messages in the text files that arrive in a folder.  They carry their own offsets, so these are null here."""
    return _stream(spark, max_files_per_trigger).load(path).select(_decoded(), F.lit(None).cast("bigint").alias("offset"))


def _stream(spark: SparkSession, max_files_per_trigger: int | None):
    reader = spark.readStream.format("text")
    return reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else reader


def stream_logs(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Lines of the logs that arrive in a folder, with file and split: ``number_lines`` numbers each micro-batch of them.

    A file belongs to one micro-batch, so its numbers start at 1 and have no gaps.
    """
    return _placed(_stream(spark, max_files_per_trigger).load, path)


def stream_topic(spark: SparkSession, servers: str, topic: str, max_offsets_per_trigger: int, **options) -> DataFrame:
    """Messages of a topic, from the earliest one on, with their offset; a micro-batch takes a bounded number.

    Needs Spark's own Kafka connector on the class path.
    """
    reader = (spark.readStream.format("kafka")
              .option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic)
              .option("startingOffsets", "earliest")
              .option("maxOffsetsPerTrigger", max_offsets_per_trigger))
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load().select(_decoded(), "offset", "partition")
