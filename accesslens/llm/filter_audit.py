"""Filter interaction audit: what each of five filters removes under all 120 orders of applying them.

A document counts only by its mask, the set of filters that it fails, so the texts are read once and leave at most 32
rows for each part.  Orders are numbered by their Lehmer rank, that is lexicographically: all orders that begin with
the same letters lie in one interval of ranks.  A mask is removed at step k by exactly those orders whose first k - 1
letters are outside it and whose k-th is inside, a set of such intervals.  Each adds its counts where it begins and
takes them back where it ends; a prefix sum over the ranks then gives the removals of every order and step.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accesslens.llm.support import WORD, broadcast_if_small, settled
from accesslens.session import cut_lineage

FILTERS = "ABCDE"
RANKS = math.factorial(len(FILTERS))
COUNTS = ["n", "good", "toxic"]


def lehmer_rank(order: str) -> int:
    """Place of an order among all orders in lexicographic sequence, from 0."""
    return sum(sum(later < letter for later in order[i + 1:]) * math.factorial(len(order) - 1 - i) for i, letter in enumerate(order))


def intervals() -> list[tuple[int, int, int, int]]:
    """All (mask, step, first rank, rank after the last) at which a mask is removed; bit i of a mask is FILTERS[i]."""
    found = []
    for step in range(1, len(FILTERS) + 1):
        width = math.factorial(len(FILTERS) - step)
        for begin in permutations(range(len(FILTERS)), step):
            rest = sorted(set(range(len(FILTERS))) - set(begin))
            first = lehmer_rank("".join(FILTERS[i] for i in [*begin, *rest]))
            before = sum(1 << i for i in begin[:-1])
            found += [(mask, step, first, first + width) for mask in range(1, 1 << len(FILTERS))
                      if mask >> begin[-1] & 1 and not mask & before]
    return found


def _bit(condition: Column, letter: str) -> Column:
    return F.when(condition, F.lit(1 << FILTERS.index(letter))).otherwise(F.lit(0))


def text_facts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """For each row doc_id, part, the mask of the filters that look at one text alone, and the text's digest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = settled(docs, F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("part"),
                      F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
                      F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("capitals"),
                      F.char_length(text).cast("long").alias("points"), text.rlike("[#$%&*|]").alias("marked"),
                      F.unhex(F.sha2(text, 256)).alias("digest"))
    words, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    return counted.select("doc_id", "part", "digest", (
        _bit(words < 100, "A").bitwiseOR(_bit(100 * distinct < 80 * words, "B"))
        .bitwiseOR(_bit(100 * F.col("capitals") > 10 * F.col("points"), "C")).bitwiseOR(_bit(F.col("marked"), "D"))).alias("mask"))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, part, mask.  Filter E is the only one that needs other rows."""
    facts = cut_lineage(text_facts(docs, id_col, text_col, lang_col))
    copied = cut_lineage(facts.groupBy("digest").agg(F.count("*").alias("_rows"), F.min("doc_id").alias("_first"), F.bool_or(F.isnull("doc_id")).alias("_nameless"))
                         .filter("_rows > 1").select("digest", "_first", "_nameless"))
    met = facts.join(broadcast_if_small(copied), "digest", "left")
    copy = F.coalesce(F.col("doc_id").isNotNull() & (F.col("_nameless") | (F.col("doc_id") > F.col("_first"))), F.lit(False))
    return met.select("doc_id", "part", F.col("mask").bitwiseOR(_bit(copy, "E")).alias("mask"))


def tally(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good ones and toxic ones for each part and mask; labels are joined to the rows that have some."""
    marks = (labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
             .filter("good = 1 OR toxic = 1"))
    keys = ["part", "mask"]
    every = masked.groupBy(*keys).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    marked = masked.join(marks, "doc_id").groupBy(*keys).agg(
        F.lit(0).cast("long").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return every.unionByName(marked).groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS])


def _orders(spark: SparkSession) -> DataFrame:
    """Every order and step with the bit of its filter: 600 rows."""
    rows = [(lehmer_rank("".join(p)), "".join(p), step, 1 << FILTERS.index(letter))
            for p in permutations(FILTERS) for step, letter in enumerate(p, 1)]
    return spark.createDataFrame(rows, "rank int, filter_order string, step int, bit int")


def interactions(counts: DataFrame) -> DataFrame:
    """From tally's rows (at most 32 for each part) one row per part, order and step; see audit."""
    spark = counts.sparkSession
    spans = spark.createDataFrame(intervals(), "mask int, step int, first int, after int")
    ends = F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("after").alias("rank"), F.lit(-1).alias("sign")))
    jumps = (counts.join(F.broadcast(spans), "mask").withColumn("end", F.explode(ends))
             .groupBy("part", "step", F.col("end.rank").alias("rank")).agg(*[F.sum(F.col(c) * F.col("end.sign")).alias(c) for c in COUNTS]))
    bits = F.filter(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), lambda bit: F.col("mask").bitwiseAND(bit) > 0)
    fails = (counts.withColumn("bit", F.explode(bits)).groupBy("part", "bit")
             .agg(F.sum("n").alias("fails"), F.sum(F.when(F.col("mask") == F.col("bit"), F.col("n")).otherwise(0)).alias("alone")))
    parts = counts.groupBy("part").agg(F.sum("n").alias("docs"))
    grid = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(RANKS - 1)))).join(F.broadcast(_orders(spark)), "rank")
    upto = Window.partitionBy("part", "step").orderBy("rank")
    removals = grid.join(jumps, ["part", "step", "rank"], "left").withColumns(
        {f"out_{c}": F.sum(F.coalesce(c, F.lit(0))).over(upto) for c in COUNTS})
    gone = F.sum("out_n").over(Window.partitionBy("part", "rank").orderBy("step"))
    return (removals.join(fails, ["part", "bit"], "left")
            .select("part", "filter_order", "step", (F.col("docs") - gone).alias("kept"), F.col("out_n").alias("removed"),
                    (F.coalesce("fails", F.lit(0)) - F.col("out_n")).alias("redundant"), F.coalesce("alone", F.lit(0)).cast("long").alias("unique_fails"),
                    F.col("out_good").alias("good_lost"), F.col("out_toxic").alias("toxic_lost"),
                    F.sum("out_n").over(Window.partitionBy("part", "bit")).alias("shapley")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per part (lang), order of the filters and step, zeros included.

    Columns: part, filter_order, step, kept (after the step), removed (by it), redundant (fail its filter, removed
    before), unique_fails (fail its filter only), good_lost and toxic_lost (removed by it, labelled quality = 1 or
    toxic = 1), shapley (removed by its filter, summed over all orders).

    Null texts are empty: no words, so they fail A and no other filter of the text.  A null or empty lang is the part
    ''.  Every row is a document, also one that repeats another: equal texts of equal ids do not fail E for one another;
    a null id is smaller than any other and has no labels.  A document with several label rows is good (toxic) if one of
    them says so.  An empty table gives no rows.  Other columns of docs and labels are not read.
    """
    return interactions(cut_lineage(tally(masks(docs, id_col, text_col, lang_col), labels)))
