"""Sharding by a Hilbert curve over document metadata.

Source, language, size and id are quantised to 2 ** BITS levels each.  Rows are sorted by the index of their cell on
the Hilbert curve and the order is cut into runs whose counts differ by one at most.  Neighbours on the curve are
neighbours in every dimension, so the least and greatest values of a file are close together in each of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from accesslens.llm.support import broadcast_if_small, numbered, whole_row
from accesslens.session import cut_lineage

BITS = 6


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of axes (rows x dimensions, each below 2 ** bits), all rows at once."""
    x = [axes[:, i].astype(np.int64).copy() for i in range(axes.shape[1])]
    step = 1 << (bits - 1)
    while step > 1:  # undo the rotations of the sub-cubes, the largest first
        for i in range(len(x)):
            high = (x[i] & step) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (step - 1))
            x[0] = np.where(high, x[0] ^ (step - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap
        step >>= 1
    for i in range(1, len(x)):  # Gray code across the dimensions
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            index = (index << 1) | (((axis ^ flip) >> b) & 1)
    return index


@F.pandas_udf(LongType())
def _curve(source: pd.Series, lang: pd.Series, size: pd.Series, place: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.column_stack([source, lang, size, place]), BITS))


def _levels(rows: DataFrame, column: str, level: str) -> DataFrame:
    """Level of each distinct value: the share of rows below it in sort order, so that a value has one level."""
    values = numbered(rows.groupBy(column).agg(F.count("*").alias("_n")), [F.col(column).asc_nulls_last()], "_rank")
    total = values.agg(F.count("*")).first()[0]
    return values.select(F.col(column).alias(f"_{column}"), F.floor(F.col("_rank") * (1 << BITS) / F.lit(max(1, total))).cast("int").alias(level))


def place_in_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, curve, shard, slot, number (place in the whole order).

    Size is the UTF-8 bytes of the text, none for null, plus 16; the checksum of null is that of no bytes.  Order is
    by curve index, then id (null first), size and checksum; rows equal in all of these are interchangeable.  Source
    and language get levels by the rank of their distinct values (null last), size by its logarithm, id by its place
    between the least and the greatest (null: lowest).  With fewer rows than shards some shards are empty.  Other
    columns of docs are not read.
    """
    text = F.col(text_col)
    rows = cut_lineage(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")))
    n, least, most = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    top = (1 << BITS) - 1
    least, most = least or 0, most or 0
    share = (F.col("doc_id").cast("double") - F.lit(float(least))) / F.lit(max(1.0, float(most) - float(least)))
    levelled = rows
    for column, level in (("source", "_l1"), ("lang", "_l2")):
        values = broadcast_if_small(cut_lineage(_levels(rows, column, level)))
        levelled = levelled.join(values, F.col(column).eqNullSafe(F.col(f"_{column}"))).drop(f"_{column}")
    indexed = levelled.select("doc_id", "size", "text_crc32", _curve(
        "_l1", "_l2", F.least(F.floor(2 * F.log2("size")), F.lit(top)).cast("int"),
        F.coalesce(F.floor(share * top), F.lit(0)).cast("int")).alias("curve"))
    ordered = numbered(indexed, [F.col(c) for c in ("curve", "doc_id", "size", "text_crc32")], "number")
    return (ordered.withColumn("shard", F.expr(f"CAST(number * {shards} DIV {max(1, n)} AS INT)"))
            .withColumn("slot", F.expr(f"number - (shard * {max(1, n)}L + {shards - 1}) DIV {shards}")))


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", lang_col: str = "lang", task_bytes: int = 256 << 20) -> None:
    """Write docs as Parquet, one folder per shard, sorted along the curve, so that readers can prune files.

    All columns stay; the folders are named `_shard=`, with more underscores in front if docs has such a column.  A task
    writes about task_bytes of text.  Rows that share an id (or have none) must share their text's checksum to get their
    own places; each row is written once.  An empty table writes no shard.
    """
    name = "_shard"
    while name in docs.columns:
        name = f"_{name}"
    rows = docs.select(whole_row(docs).alias("_row"), F.col(id_col).cast("long").alias("_id"),
                       F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_crc"))
    placed = cut_lineage(place_in_shards(docs, shards, id_col, text_col, source_col, lang_col))
    total = placed.agg(F.sum("size")).first()[0] or 0
    places = (placed.groupBy(F.col("doc_id").alias("_id2"), F.col("text_crc32").alias("_crc2"))
              .agg(F.min("number").alias("_number"), F.min_by("shard", "number").alias("_at")))
    met = rows.join(places, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_crc") == F.col("_crc2")))
    ordered = met.repartitionByRange(max(shards, -(-total // task_bytes)), "_number").sortWithinPartitions("_number")
    ordered.select("_row.*", F.col("_at").alias(name)).write.partitionBy(name).parquet(path)
