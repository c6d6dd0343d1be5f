"""Usage counters over recorded scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_totals(scan_events: DataFrame, approximate: bool = False) -> DataFrame:
    """Scans, lines, anomalies and distinct visitors (one row, zeros when nothing was recorded)."""
    visitors = F.approx_count_distinct("visitor_hash") if approximate else F.count_distinct("visitor_hash")
    return scan_events.agg(
        F.count("*").alias("scans_run"),
        F.coalesce(F.sum("lines"), F.lit(0)).alias("lines_processed"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies_flagged"),
        visitors.alias("unique_visitors"),
    )


#: Bits of the sketches' registers: at this one a count of visitors is off by less than SKETCH_ERROR (three standard errors).
SKETCH_BITS, SKETCH_ERROR = 12, 0.05


def usage_sketches(scan_events: DataFrame, part) -> DataFrame:
    """One row per part (a day, an appended batch): counts, and a mergeable sketch of its visitors."""
    return scan_events.groupBy(part.cast("string").alias("part")).agg(
        F.count("*").alias("scans"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies"),
        F.hll_sketch_agg("visitor_hash", F.lit(SKETCH_BITS)).alias("visitors"))


def sketched_totals(sketches: DataFrame) -> DataFrame:
    """``usage_totals`` from the rows of ``usage_sketches``: visitors of several parts count once, off by SKETCH_ERROR."""
    return sketches.agg(
        F.coalesce(F.sum("scans"), F.lit(0)).alias("scans_run"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines_processed"),
        F.coalesce(F.sum("anomalies"), F.lit(0)).alias("anomalies_flagged"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("visitors")), F.lit(0)).alias("unique_visitors"))
