"""Scan summaries and ranked anomaly reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accesslens.functions.request_features import status_class
from accesslens.functions.text import html_escape, mark_fragments
from accesslens.session import cut_lineage

MAX_REPORTED = 200


def rate(part, whole):
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 4))


def scan_summary(scored: DataFrame, threshold: float, limit: int = MAX_REPORTED) -> DataFrame:
    """One row: lines, parsed requests, anomalies, their rate, and whether a report is cut.

    ``scored`` holds all lines with a ``parsed`` flag, so one pass counts everything.
    """
    counts = scored.agg(F.count("*").alias("total_lines"), F.count_if("parsed").alias("parsed"),
                        F.count_if(F.col("parsed") & F.col("is_anomaly")).alias("anomalies"))
    return counts.select(
        "total_lines", "parsed", "anomalies",
        rate(F.col("anomalies"), F.col("parsed")).alias("anomaly_rate"),
        F.lit(threshold).alias("threshold"),
        (F.col("anomalies") > limit).alias("truncated"),
    )


def anomalous(scored: DataFrame) -> DataFrame:
    return scored.filter("is_anomaly")


def ranked_anomalies(scored: DataFrame, order: str = "line_no") -> DataFrame:
    """Anomalies, greatest rounded score first, ties in line order."""
    return anomalous(scored).orderBy(F.desc("score"), order)


def anomaly_report(scored: DataFrame, order: str = "line_no", limit: int = MAX_REPORTED) -> DataFrame:
    """The top of the ranking with the fields that a report shows."""
    return ranked_anomalies(scored, order).limit(limit).select(
        order, "score", "method", "path", "query", "status", "drivers")


def anomaly_listing(scored: DataFrame, order: str = "line_no", n: int = 8) -> DataFrame:
    """The first ``n`` anomalies in line order with their drivers as text."""
    drivers = F.array_join(
        F.transform("top_features", lambda t: F.concat(t["feature"], F.lit("="), t["contribution"].cast("string"))),
        ", ")
    return anomalous(scored).orderBy(order).limit(n).select(
        order, "score", "method", "path", F.substring("query", 1, 50).alias("query"), drivers.alias("drivers"))


def listing_totals(scored: DataFrame) -> DataFrame:
    """How many anomalies of how many lines (one row), from all lines with a ``parsed`` flag."""
    return scored.agg(F.count_if(F.col("parsed") & F.col("is_anomaly")).alias("anomalies"),
                      F.count("*").alias("total_lines"))


def with_severity(report: DataFrame, threshold: float) -> DataFrame:
    """Add the ratio to the threshold and the width of a bar relative to the worst row.

    The worst score is one number, read first, so a report of any length stays distributed.
    """
    report = cut_lineage(report)
    worst = report.agg(F.max("score")).first()[0]
    return report.select(
        "*",
        F.round(F.col("score") / F.lit(threshold), 1).alias("times_over"),
        F.round(F.greatest(F.lit(6.0), F.col("score") / F.lit(worst).cast("double") * 100), 0).cast("int").alias("bar_width"),
    )


def with_markup(df: DataFrame) -> DataFrame:
    """Add the status class, the escaped path and the marked query of a report row."""
    return df.select("*", status_class(F.col("status")).alias("status_class"),
                     html_escape(F.col("path")).alias("path_html"), mark_fragments(F.col("query")).alias("query_html"))
