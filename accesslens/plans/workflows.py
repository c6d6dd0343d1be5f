"""End-to-end jobs: scan a log, train a detector, evaluate it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.models.bundle import Bundle
from accesslens.operators import evaluation, reports
from accesslens.operators.featurizing import add_features
from accesslens.operators.parsing import parse_requests
from accesslens.operators.scoring import score_lines
from accesslens.operators.selection import error_sketches, exact_percentile, merged_percentile
from accesslens.operators.training import train_detector
from accesslens.session import cut_lineage, scratch_path, tune
from accesslens.sinks import files
from accesslens.sources.labels import normal_name, read_file_labels, read_labels
from accesslens.sources.logs import log_name, read_lines, read_numbered_lines, read_upload


@dataclass(frozen=True)
class ScanReport:
    """A scan's one-row summary, its ranked anomalies, and all scored requests."""

    summary: DataFrame
    anomalies: DataFrame
    scored: DataFrame


def scan_frame(lines: DataFrame, bundle: Bundle, order: str = "line_no", column: str = "value", filename: str | None = None) -> ScanReport:
    """Score lines that already carry a line number, in one pass.

    All lines are parsed and scored once and written to the shared folder, without their raw text; summary and report
    come from what was written.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "scan")
    score_lines(lines, bundle, column, keep=[order], unparsed=True).drop("raw").write.parquet(path)
    every = spark.read.parquet(path)
    scored = every.filter("parsed").drop("parsed")
    summary = reports.scan_summary(every, bundle.threshold)
    if filename is not None:
        summary = summary.select(F.lit(filename).alias("filename"), "*")
    return ScanReport(summary, reports.anomaly_report(scored, order), scored)


def scan_upload(spark: SparkSession, path: str, bundle: Bundle) -> ScanReport:
    """Scan one log file; the summary names it.  Raises ``ValueError`` when it has no lines."""
    return scan_frame(read_upload(tune(spark), path), bundle, filename=path.rstrip("/").rpartition("/")[2])


def train_from_logs(spark: SparkSession, paths, **options) -> tuple[Bundle, list[float]]:
    """Train on log files of normal traffic."""
    requests = parse_requests(read_lines(tune(spark), paths))
    return train_detector(add_features(requests), key="raw", **options)


@dataclass(frozen=True)
class Evaluation:
    quality: DataFrame
    misses: DataFrame


def evaluate(scored: DataFrame) -> Evaluation:
    """Metrics and misses of scored, labelled requests."""
    return Evaluation(evaluation.quality(evaluation.confusion(scored)), evaluation.misses(scored))


def evaluate_log(spark: SparkSession, log_path: str, labels_path: str, bundle: Bundle) -> Evaluation:
    """Score a labelled log; lines without a label or that do not parse are left out.

    Labels name lines by number alone, so the log must be one file; ``evaluate_logs`` takes a folder.
    """
    if len(spark.read.text(log_path).inputFiles()) > 1:
        raise ValueError("line numbers restart in each file: evaluate one file at a time")
    lines = read_numbered_lines(tune(spark), log_path)
    labelled = evaluation.label_join(lines, read_labels(spark, labels_path))
    scored = score_lines(labelled, bundle, keep=["line_no", "label"])
    return evaluate(cut_lineage(scored.select("line_no", "label", "error", "is_anomaly", "raw")))


def evaluate_logs(spark: SparkSession, folder: str, labels_path: str, bundle: Bundle) -> Evaluation:
    """Score a folder of labelled logs, and those in folders below it.  Labels name a log by its path below the folder,
    and a line in it by number."""
    lines = read_numbered_lines(tune(spark), folder, nested=True)
    named = lines.withColumn("file", normal_name(log_name(F.col("file"), files.qualified(spark, folder))))
    labelled = evaluation.label_join(named, read_file_labels(spark, labels_path), ["file", "line_no"])
    scored = score_lines(labelled, bundle, keep=["file", "line_no", "label"])
    return evaluate(cut_lineage(scored.select("file", "line_no", "label", "error", "is_anomaly", "raw")))


def calibrate(spark: SparkSession, folder: str, bundle: Bundle, pct: float = 99.0, exact: bool = True) -> Bundle:
    """The detector with the threshold that leaves ``pct`` percent of a folder's requests below it.

    ``exact`` ranks all errors in several passes; otherwise one pass keeps a sketch for each log and merges them.
    """
    requests = read_numbered_lines(tune(spark), folder).select("file", "value")
    errors = score_lines(requests, bundle, keep=["file"]).select("file", "error")
    if exact:
        return bundle.with_threshold(exact_percentile(cut_lineage(errors), "error", pct))
    return bundle.with_threshold(merged_percentile(error_sketches(errors, "error", "file"), pct))
