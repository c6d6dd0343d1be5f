"""Mixing sources to target weights by pivotal dependent rounding.

A source of target t and size s should give each document t / s copies.  The whole part is fixed; the fraction is
rounded by pairing documents: probability, weighed by size, moves at random from one to the other until one of them is
integral, which keeps both expectations and the expected words of the pair.  A block of up to BLOCK documents is folded
so, the longest first, so that what is left open tends to be short; its one residual goes to the next level of a tree, whose blocks are BLOCK times as wide, until one residual is left
for each source.  A source thus misses its target by less than one document.  Only DataFrame functions are used.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accesslens.llm.support import WORD, numbered, whole_row
from accesslens.session import cut_lineage

BLOCK = 128
MOST_COPIES = 3
_ITEM = "size double, number bigint, p double, dice double"


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Per source its size, weight and target, from rows (source, size): columns source, source_size, weight, target.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share all words by weight; what exceeds
    most times a source's size is shared again among the others by weight until no target is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "_rank").withColumn("weight", (1 + F.col("_rank") % 3).cast("double"))
    ranked = cut_lineage(ranked.select("source", "source_size", "weight", (F.col("source_size") * most).cast("double").alias("_cap")))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # each round fixes at least one more source at its cap, so few rounds are left after the first
        above = F.col("_cap") <= F.lit(level) * F.col("weight")
        capped, weights = ranked.agg(F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if not weights:
            break
        now = (total - (capped or 0.0)) / weights
        if now <= level:
            break
        level = now
    return ranked.select("source", "source_size", "weight", F.least(F.col("_cap"), F.lit(level) * F.col("weight")).alias("target"))


def _dice(*keys: Column) -> Column:
    """A number in [0, 1) that the keys alone decide."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def _fold() -> Column:
    """Fold the items of a block: the settled ones with 0 or 1 copy more, and the item whose fraction is left."""
    start = F.struct(F.lit(None).cast(f"struct<{_ITEM.replace(' ', ':').replace(',:', ',')}>").alias("open"),
                     F.array().cast("array<struct<number:bigint,copy:int>>").alias("done"))

    def settle(item, copy):
        return F.struct(item["number"].alias("number"), F.lit(copy).alias("copy"))

    def with_p(item, p):
        return F.struct(item["size"].alias("size"), item["number"].alias("number"), p.alias("p"), item["dice"].alias("dice"))

    def step(state, new):
        old, done = state["open"], state["done"]
        up_old, up_new = old["size"] * (1 - old["p"]), new["size"] * new["p"]  # words that can move from new to old
        down_old, down_new = old["size"] * old["p"], new["size"] * (1 - new["p"])  # and from old to new
        up, down = F.least(up_old, up_new), F.least(down_old, down_new)
        to_old = new["dice"] * (up + down) < down
        moved = (F.when(to_old & (up_old <= up_new), F.struct(with_p(new, new["p"] - up / new["size"]).alias("open"), settle(old, 1).alias("out")))
                 .when(to_old, F.struct(with_p(old, old["p"] + up / old["size"]).alias("open"), settle(new, 0).alias("out")))
                 .when(down_old <= down_new, F.struct(with_p(new, new["p"] + down / new["size"]).alias("open"), settle(old, 0).alias("out")))
                 .otherwise(F.struct(with_p(old, old["p"] - down / old["size"]).alias("open"), settle(new, 1).alias("out"))))
        return F.when(old.isNull(), F.struct(new.alias("open"), done.alias("done"))).otherwise(
            F.transform(F.array(moved), lambda m: F.struct(m["open"].alias("open"), F.concat(done, F.array(m["out"])).alias("done")))[0])

    return F.aggregate("items", start, step)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                most: int = MOST_COPIES, seed: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, size (words), source, source_size, target, copies, taken, text_crc32.

    A document of no words gives none and gets the whole part of its source's copies.  The last fraction of a source
    goes to the nearer side.  The dice depend on seed, id, source and checksum alone, and documents meet in the order
    of source, id, size and checksum (null ids first), so reruns agree.  Rows equal in all of these are told apart by
    place only: which of them gets a copy more is open, how many is not.  Null text has no words.  Other columns of
    docs are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                   F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    targets = source_targets(rows, most).withColumnRenamed("source", "_source")
    order = [F.col("source").asc_nulls_last(), *(F.col(c) for c in ("doc_id", "size", "text_crc32"))]
    share = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    meta = cut_lineage(numbered(rows, order, "number").join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
                       .withColumn("base", F.floor(share).cast("int")).withColumn("p", share - F.col("base")))
    n = meta.count()
    left = meta.filter("p > 0 AND size > 0").select(
        "source", F.col("number"), F.col("size").cast("double"), "p",
        _dice(F.lit(seed), F.col("doc_id"), F.col("source"), F.col("text_crc32"), F.col("number")).alias("dice"))
    done, width = [], 1
    while True:
        width *= BLOCK
        folded = cut_lineage(left.groupBy("source", F.expr(f"number DIV {width}L").alias("_block"))
                             .agg(F.sort_array(F.collect_list(F.struct("size", "number", "p", "dice")), asc=False).alias("items"))
                             .select("source", _fold().alias("_f")).select("source", "_f.open", "_f.done"))
        done.append(folded.select(F.inline("done")))
        left = folded.select("source", "open.*")
        if width >= n:
            break
    done.append(left.select("number", (F.col("p") >= 0.5).cast("int").alias("copy")))
    settled = done[0]
    for part in done[1:]:
        settled = settled.unionByName(part)
    copies = F.col("base") + F.coalesce("copy", F.lit(0))
    return (meta.join(settled, "number", "left").withColumn("copies", copies)
            .select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_crc32"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             most: int = MOST_COPIES, seed: int = 1) -> DataFrame:
    """The rows of docs as often as the mix takes them, all columns unchanged.

    Rows that repeat id, source and text share their copies: they are dealt among them as evenly as possible.
    """
    rows = docs.select(whole_row(docs).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"),
                       F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_crc"))
    plan = cut_lineage(mix_sources(docs, id_col, text_col, source_col, most, seed)
                       .groupBy(F.col("doc_id").alias("_id2"), F.col("source").alias("_source2"), F.col("text_crc32").alias("_crc2"))
                       .agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_rows")).filter("_copies > 0"))
    on = F.col("_id").eqNullSafe(F.col("_id2")) & F.col("_source").eqNullSafe(F.col("_source2")) & (F.col("_crc") == F.col("_crc2"))

    def taken(part):
        return part.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")

    out = taken(rows.join(plan.filter("_rows = 1"), on))
    if plan.filter("_rows > 1").isEmpty():
        return out
    # equal rows get numbers by task, each task's after those of the tasks before, so a hot key is not gathered in one
    again = cut_lineage(rows.join(plan.filter("_rows > 1"), on).withColumn("_at", F.monotonically_increasing_id()))
    again = again.withColumn("_task", F.shiftright("_at", 33))
    keys = ["_id", "_source", "_crc"]
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_task")) - F.col("_n")
    begins = again.groupBy(*keys, "_task").agg(F.count("*").alias("_n")).select(*[F.col(c).alias(f"{c}3") for c in [*keys, "_task"]], before.alias("_before"))
    match = functools.reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"{c}3")) for c in [*keys, "_task"]])
    nth = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_task").orderBy("_at"))
    each = F.expr("_copies DIV _rows").cast("int") + (F.col("_nth") <= F.expr("_copies % _rows")).cast("int")
    dealt = again.join(begins, match).withColumn("_nth", nth).withColumn("_copies", each).filter("_copies > 0")
    return out.unionByName(taken(dealt))
