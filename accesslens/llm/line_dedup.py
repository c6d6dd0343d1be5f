"""Line dedup: long lines that many documents hold stay in one document only.

Lines are exploded and hashed; each document counts once for a hash, so a count needs no distinct.  Frequent hashes
meet the exploded lines again, by broadcast if they were counted to be few, else by a shuffle whose hot keys Spark can
split.  The dropped positions of a document come together, and its other lines are joined in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.llm.support import SPACES, ascii_lower, broadcast_if_small, settled
from accesslens.session import cut_lineage


def _lines(text):
    return F.split(text, "\n", -1)


def _hashes(text, min_chars):
    """For each line its digest, or null if its key is too short to count."""
    def digest(line):
        key = F.btrim(line, F.lit(SPACES))
        return F.when(F.char_length(key) >= min_chars, F.md5(ascii_lower(key)))
    return F.transform(_lines(text), digest)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, text (the lines that stay).

    A line's key is the line stripped of blanks at both ends, A-Z lower-cased; keys compare by MD5.  A key of min_chars
    code points or more in min_docs or more documents loses its lines everywhere but in the largest id that holds it.
    Null and empty texts are one empty line.  Every row of docs is a document, also one that repeats another's id;
    a null id is smaller than any other.  Other columns of docs are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    held = base.select("doc_id", F.explode(F.array_distinct(_hashes(F.col("text"), min_chars))).alias("hash")).filter("hash IS NOT NULL").withColumn("hash", F.unhex("hash"))
    repeated = cut_lineage(held.groupBy("hash").agg(F.count("*").alias("_docs"), F.max("doc_id").alias("_keeper"))
                           .filter(F.col("_docs") >= min_docs).filter("_keeper IS NOT NULL").select("hash", "_keeper"))
    placed = base.select("doc_id", F.md5("text").alias("_same"), F.posexplode(_hashes(F.col("text"), min_chars)).alias("_pos", "hash"))
    gone = (placed.filter("hash IS NOT NULL").withColumn("hash", F.unhex("hash")).join(broadcast_if_small(repeated), "hash")
            .filter("doc_id IS NULL OR doc_id < _keeper")
            .groupBy(F.col("doc_id").alias("_id"), "_same").agg(F.collect_set("_pos").alias("_gone")))
    joined = base.withColumn("_same2", F.md5("text")).join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_same2") == F.col("_same")), "left")
    cut = settled(joined, F.col("doc_id"), _lines(F.col("text")).alias("lines"), F.coalesce("_gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return cut.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
                      F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n").alias("text"))
