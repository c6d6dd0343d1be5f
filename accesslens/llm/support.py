"""Pieces that several operators share: text rules, gapless numbering, checked broadcasts, blocked pairs, components."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from accesslens.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a broadcast may hold; all of them are ids and small numbers.
BROADCAST_ROWS = 1_000_000
#: Links that a task of a components round takes, and its least tasks.
LINK_ROWS, LINK_TASKS = 200_000, 8
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_MMAP_THRESHOLD = -3
_LOW33 = (1 << 33) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python workers in batches of BATCH_BYTES, unless the session asks for smaller ones.

    Spark's own bound on a batch, 64 MB, is held several times over in each task, in the JVM and in the worker.
    """
    now = spark.conf.get(_BATCH, "64m").lower().rstrip("b")
    held = int(now.rstrip("kmg")) * {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1], 1)
    if held <= 0 or held > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


@functools.cache
def _allocator():
    """The C library, told to return large blocks as soon as they are free; None where it can't be told."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_MMAP_THRESHOLD, 1 << 20)
        return libc if hasattr(libc, "malloc_trim") else None
    except (OSError, AttributeError):
        return None


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives back the memory it no longer needs.

    Python workers outlive their tasks; without this they hold the largest that any task needed, beside the next stage.
    """
    def wrapped(batches: Iterator) -> Iterator:
        libc = _allocator()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc:
                libc.malloc_trim(0)
    return wrapped


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a checkpointed table for broadcasting if it was counted to be small; else the join shuffles."""
    return F.broadcast(df) if df.count() <= limit else df


def settled(df: DataFrame, *columns: Column) -> DataFrame:
    """Compute columns once, so that later expressions read them instead of repeating them."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("_row")).select("_row.*")


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that helper columns beside it can have any name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def one_of_equal(df: DataFrame, keys: list[Column]) -> DataFrame:
    """df, of rows that agree in all keys only one: the least by a hash of the whole row, null keys being equal.

    Only keys that repeat are shuffled with their rows; the least of each is found before the shuffle, so a hot key
    sends one row from each task.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    rows = df.select(whole_row(df).alias("_row"), *[k.alias(n) for k, n in zip(keys, names, strict=True)])
    again = cut_lineage(rows.groupBy(*names).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    if again.isEmpty():
        return df
    known = broadcast_if_small(again.select(*[F.col(n).alias(f"{n}_") for n in names]))
    same = functools.reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names])
    least = rows.join(known, same, "left_semi").groupBy(*names).agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return rows.join(known, same, "left_anti").select("_row.*").unionByName(least.select("_row.*"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add gapless numbers from 0 in the given order; rows equal in all of it get theirs in any order.

    Rows are dealt by range and sorted there; a number is the count of rows in the ranges before plus the place in
    its own.  Only one count for each range is gathered.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id()))
    before = (ranged.groupBy(F.shiftright("_at", 33).alias("_range")).count()
              .select("_range", (F.sum("count").over(Window.orderBy("_range")) - F.col("count")).alias("_before")))
    return (ranged.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_range"))
            .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_LOW33)))
            .drop("_at", "_range", "_before"))


def in_block_pairs(df: DataFrame, group: str, spread: Column, block_rows: int, weight: Column | None = None, block_weight: int = 1) -> DataFrame:
    """Give each row the block pairs in which it meets every other row of its group: columns _own, _low and _high.

    A group of up to block_rows rows, and block_weight in sum, is one block.  A larger one is cut by the hash in spread;
    each of its blocks meets itself and each other block once, so a task holds about two blocks whatever the size of
    the group.
    """
    rows = F.ceil(F.count("*") / block_rows)
    need = rows if weight is None else F.greatest(rows, F.ceil(F.sum(weight) / block_weight))
    blocks = cut_lineage(df.groupBy(group).agg(F.least(F.count("*"), need).cast("int").alias("_blocks")).filter("_blocks > 1"))
    placed = (df.join(broadcast_if_small(blocks), group, "left")
              .withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
              .withColumn("_own", F.pmod(spread, F.col("_blocks")).cast("int")))
    met = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return (met.withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other"))
            .drop("_blocks", "_other"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut sorted batches into tables of equal keys, one at a time in memory."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            now = tuple(c[start] for c in columns)
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def roots(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the least index that its links reach."""
    label = np.arange(len(links))
    while True:
        near = np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links))
        now = np.minimum(label, near)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node: (node, component), from links (a, b) of any orientation.

    Alternates the large-star and small-star steps until nothing changes; every link then points to the smallest
    node of its component.  Each step is a minimum by node, pre-aggregated before its shuffle, and a join that Spark
    can split at a hot node.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n, last = edges.count(), None

    def few(df: DataFrame) -> DataFrame:
        """As many tasks as a round's rows ask for, at most 2 n: shuffles of few links by many tasks would be mostly empty files."""
        return df.coalesce(max(LINK_TASKS, -(-2 * n // LINK_ROWS)))

    while True:
        both = few(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = few(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")).distinct()
        low = few(large).groupBy("a").agg(F.min("b").alias("m"))
        small = few(large).join(low, "a")
        edges = cut_lineage(few(few(small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
                                    .union(low.select("a", F.col("m").alias("b")))).distinct()))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads)
        n, last = now[0], now
