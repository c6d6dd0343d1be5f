"""Measure verdicts against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_join(lines: DataFrame, labels: DataFrame, on: str | list[str] = "line_no") -> DataFrame:
    """Lines that have a label.  Catalyst picks the join from the sizes it knows."""
    return lines.join(labels, on, "inner")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def confusion(df: DataFrame, predicted: str = "is_anomaly", label: str = "label") -> DataFrame:
    """Counts ``tp, fp, fn, tn`` (one row)."""
    flagged, attack = F.col(predicted), F.col(label) == 1
    return df.agg(
        F.count_if(flagged & attack).alias("tp"),
        F.count_if(flagged & ~attack).alias("fp"),
        F.count_if(~flagged & attack).alias("fn"),
        F.count_if(~flagged & ~attack).alias("tn"),
    )


def quality(matrix: DataFrame) -> DataFrame:
    """Add precision, recall and F1 to a confusion row; 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    scored = matrix.select(
        (tp + fp + fn + F.col("tn")).alias("n"), "tp", "fp", "fn", "tn",
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return scored.select("*", _ratio(2 * p * r, p + r).alias("f1"))


def false_negatives(df: DataFrame) -> DataFrame:
    return df.filter((F.col("label") == 1) & ~F.col("is_anomaly"))


def false_positives(df: DataFrame) -> DataFrame:
    return df.filter((F.col("label") == 0) & F.col("is_anomaly"))


def misclassified(df: DataFrame) -> DataFrame:
    """Missed attacks and flagged normals, told apart by ``kind``."""
    missed = (F.col("label") == 1) & ~F.col("is_anomaly")
    flagged = (F.col("label") == 0) & F.col("is_anomaly")
    return df.withColumn("kind", F.when(missed, "false_negative").when(flagged, "false_positive")).filter("kind IS NOT NULL")


def misses(df: DataFrame, n: int = 5, width: int = 120) -> DataFrame:
    """The ``n`` missed attacks of least error and the ``n`` flagged normals of greatest error.

    One pass: each task keeps its own first ``n`` of a kind before the ranks meet.
    """
    missed = F.col("kind") == "false_negative"
    order = Window.partitionBy("kind").orderBy(F.when(missed, F.col("error")).otherwise(-F.col("error")),
                                               F.when(missed, F.col("raw")), F.desc(F.when(~missed, F.col("raw"))))
    ranked = misclassified(df).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    return ranked.orderBy("kind", "_rank").select("kind", "error", F.substring("raw", 1, width).alias("raw"))
