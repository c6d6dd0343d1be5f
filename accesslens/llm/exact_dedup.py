"""Exact dedup with a split for heavy hitters.

A Misra-Gries sketch on each partition finds digests that may be frequent.  Their exact counts and winners, at most
KEEP rows, are broadcast and settle those rows where they lie; all other digests are grouped by an ordinary shuffle,
in which no group can hold more than about 2 / KEEP of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.support import ascii_lower, broadcast_if_small, one_of_equal, whole_row
from accesslens.session import cut_lineage

KEEP = 4096


def _normal(text):
    return ascii_lower(F.coalesce(text, F.lit("")))


def _sketch(keep: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for digest, n in batch["digest"].value_counts().items():
                counts[digest] = counts.get(digest, 0) + n
            if len(counts) > keep:
                cut = np.partition(np.fromiter(counts.values(), dtype=np.int64), -keep - 1)[-keep - 1]
                counts = {d: n - cut for d, n in counts.items() if n > cut}
        yield pd.DataFrame({"digest": list(counts), "n": list(counts.values())})
    return run


def frequent_digests(signed: DataFrame, keep: int = KEEP) -> DataFrame:
    """At most keep digests, among them each that more than 2 / (keep + 1) of the rows have.

    A partition's counter is too low by at most its rows / (keep + 1), so the sum is by at most all rows / (keep + 1).
    """
    return (signed.select("digest").mapInPandas(_sketch(keep), "digest binary, n long")
            .groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1")
            .orderBy(F.desc("n"), "digest").limit(keep).select("digest"))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The largest id of a group stays.
    Rows that repeat both id and text are one document written twice: all of them carry the same kept.  A null id is
    smaller than any other; a group without ids keeps its rows.  Other columns of docs are not read.
    """
    signed = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(_normal(F.col(text_col)), 256)).alias("digest")))

    def group(rows):
        return rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))

    heavy = cut_lineage(group(signed.join(F.broadcast(frequent_digests(signed, keep)), "digest")))
    settled = signed.join(F.broadcast(heavy), "digest")
    rest = signed.join(F.broadcast(heavy), "digest", "left_anti")
    both = settled.unionByName(rest.join(group(rest), "digest"))
    return both.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: int = KEEP) -> DataFrame:
    """The rows of docs that mark_copies keeps, with all their columns unchanged; of rows that repeat both id and text one.

    A group without ids keeps one row too.
    """
    out = cut_lineage(mark_copies(docs, id_col, text_col, keep).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_sha")).distinct())
    gone = broadcast_if_small(out)
    rows = docs.select(whole_row(docs).alias("_row"), F.col(id_col).alias("_own"), F.unhex(F.sha2(_normal(F.col(text_col)), 256)).alias("_text"))
    kept = rows.join(gone, F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha")), "left_anti").select("_row.*")
    return one_of_equal(kept, [F.col(id_col), F.unhex(F.sha2(_normal(F.col(text_col)), 256))])
