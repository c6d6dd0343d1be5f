"""Exact order statistics of a column of any length."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _step(df: DataFrame, lo: float, hi: float, buckets: int) -> list:
    """Count, least and greatest value per bucket of [lo, hi], in order (at most ``buckets`` rows)."""
    x = F.col("_x")
    scale = buckets / (hi - lo)
    bucket = F.least(F.floor((x - F.lit(lo)) * F.lit(scale)), F.lit(buckets - 1)) if math.isfinite(scale) else x
    return (df.filter(x.between(lo, hi)).groupBy(bucket.alias("_b"))
            .agg(F.count("*").alias("n"), F.min("_x").alias("lo"), F.max("_x").alias("hi"))
            .orderBy("lo").collect())


def exact_percentile(df: DataFrame, column: str, pct: float, buckets: int = 4096) -> float:
    """The ``pct``-th percentile with linear interpolation, as a number.

    Each pass counts values in equal-width buckets (combined before the shuffle)
    and continues inside the bucket that holds the wanted rank, so neither a task
    nor the driver ever holds more than ``buckets`` rows.
    """
    if not 0 <= pct <= 100:
        raise ValueError("pct must be between 0 and 100")
    values = df.select(F.col(column).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    n, lo, hi = values.agg(F.count("*"), F.min("_x"), F.max("_x")).first()
    if not n:
        raise ValueError(f"no values in {column}")
    if not (math.isfinite(lo) and math.isfinite(hi)):
        raise ValueError(f"{column} has values that are not finite")
    position = pct / 100 * (n - 1)
    rank = min(int(position), n - 1)
    share = position - rank
    above = hi
    while lo < hi:
        rows = _step(values, lo, hi, buckets)
        at = 0
        while rank >= rows[at].n:
            rank -= rows[at].n
            at += 1
        if at + 1 < len(rows):
            above = rows[at + 1].lo
        n, lo, hi = rows[at].n, rows[at].lo, rows[at].hi
        if rank == n - 1:
            return hi + (above - hi) * share
        if rank == 0 and n == 2:
            return lo + (hi - lo) * share
    return lo if rank < n - 1 else lo + (above - lo) * share


#: Size of the sketches: at this one a rank is off by less than RANK_ERROR of all values (both sides, 99 % confidence).
SKETCH_SIZE, RANK_ERROR = 1000, 0.005


def error_sketches(df: DataFrame, column: str, part: str, size: int = SKETCH_SIZE) -> DataFrame:
    """One mergeable quantile sketch of ``column`` per ``part`` (a log, a day): ``part, n, sketch``, a few KB each.

    They are filled where the rows lie and merged in the shuffle; keep them, and a later threshold needs no old rows.
    """
    values = df.filter(F.col(column).isNotNull())
    return values.groupBy(F.col(part).alias("part")).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(column).cast("double"), F.lit(size)).alias("sketch"))


def merged_percentile(sketches: DataFrame, pct: float) -> float:
    """The ``pct``-th percentile over all parts, off by RANK_ERROR of the ranks at most (with the sketches' confidence)."""
    if not 0 <= pct <= 100:
        raise ValueError("pct must be between 0 and 100")
    merged = sketches.agg(F.kll_merge_agg_double("sketch").alias("s"), F.sum("n").alias("n"))
    row = merged.filter("n > 0").select(F.kll_sketch_get_quantile_double("s", F.lit(pct / 100)).alias("q")).first()
    if row is None:
        raise ValueError("no values")
    return float(row["q"])
