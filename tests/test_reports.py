import hashlib
import html
import re

import pytest
from conftest import LOUD, CALM, DENSE, lines_frame, calm_lines
from pyspark.sql import functions as F

from accesslens.functions.text import MARKED_FRAGMENTS
from accesslens.functions.visitors import client_ip, visitor_hash
from accesslens.operators import evaluation, reports, usage, verdict_store
from accesslens.plans.workflows import evaluate_log, scan_upload, train_from_logs
from accesslens.sinks.stores import record_scan, store_verdicts
from accesslens.schemas import SCAN_EVENTS, VERDICT_MESSAGE

SCORED = "line_no bigint, score double, error double, is_anomaly boolean, label int, raw string"


def write_log(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_scan_of_an_upload(spark, trained, tmp_path):
    report = scan_upload(spark, write_log(tmp_path / "a.log", [CALM, "junk", "", LOUD]), trained[0])
    s = report.summary.first()
    assert (s.total_lines, s.parsed, s.anomalies, s.anomaly_rate, s.truncated) == (4, 2, 1, 0.5, False)
    (row,) = report.anomalies.collect()
    assert (row.line_no, row.path) == (4, "/loud") and len(row.drivers) == 3


def test_an_empty_upload_is_an_error(spark, trained, tmp_path):
    (tmp_path / "empty.log").write_text("")
    with pytest.raises(ValueError, match="empty upload"):
        scan_upload(spark, str(tmp_path / "empty.log"), trained[0])


def test_a_scan_without_requests(spark, trained, tmp_path):
    s = scan_upload(spark, write_log(tmp_path / "b.log", ["junk"]), trained[0]).summary.first()
    assert (s.total_lines, s.parsed, s.anomalies, s.anomaly_rate) == (1, 0, 0, 0.0)


def test_report_is_cut_and_says_so(spark, trained, tmp_path):
    report = scan_upload(spark, write_log(tmp_path / "c.log", [LOUD] * 205), trained[0])
    assert report.summary.first().truncated and report.anomalies.count() == 200
    assert [r.line_no for r in report.anomalies.limit(3).collect()] == [1, 2, 3]


def test_evaluation_of_a_labelled_log(spark, trained, tmp_path):
    log = write_log(tmp_path / "mixed.log", [CALM, LOUD, "junk", DENSE, CALM, CALM])
    labels = write_log(tmp_path / "labels.csv", ["line_no,label", "1,0", "2,0", "3,1", "4,1", "5,1", "2,1"])
    result = evaluate_log(spark, log, labels, trained[0])
    q = result.quality.first()
    assert (q.n, q.tp, q.fp, q.fn, q.tn, q.precision) == (4, 2, 0, 1, 1, 1.0) and q.recall == pytest.approx(2 / 3)
    assert [(r.kind, r.raw) for r in result.misses.collect()] == [("false_negative", CALM[:120])]


def test_training_from_a_log(spark, tmp_path):
    bundle, losses = train_from_logs(spark, write_log(tmp_path / "n.log", calm_lines(400) + ["junk"]), rounds=2)
    assert len(losses) == 2 and bundle.threshold > 0


def test_metrics_of_nothing_are_zero(spark):
    empty = spark.createDataFrame([], SCORED)
    q = evaluation.quality(evaluation.confusion(empty)).first()
    assert (q.n, q.precision, q.recall, q.f1) == (0, 0.0, 0.0, 0.0)
    s = verdict_store.verdict_stats(empty).first()
    assert (s.total, s.anomalies, s.anomaly_rate) == (0, 0, 0.0)


def test_miss_order(spark):
    rows = [(i, 0.0, float(i % 3), i % 2 == 0, 1 if i % 2 else 0, f"r{i}") for i in range(30)]
    got = evaluation.misses(spark.createDataFrame(rows, SCORED)).collect()
    fn = sorted((r[2], r[5]) for r in rows if r[4] == 1 and not r[3])[:5]
    fp = sorted(((r[2], r[5]) for r in rows if r[4] == 0 and r[3]), reverse=True)[:5]
    assert [(r.error, r.raw) for r in got if r.kind == "false_negative"] == fn
    assert [(r.error, r.raw) for r in got if r.kind == "false_positive"] == fp


def test_severity_and_markup(spark):
    df = spark.createDataFrame([(1, 10.0, "/a<b", "q=<Script>&x='--", 503), (2, 0.2, "/", None, 404)],
                               "line_no int, score double, path string, query string, status int")
    rows = reports.with_markup(reports.with_severity(df, 0.5)).orderBy("line_no").collect()
    assert [(r.times_over, r.bar_width, r.status_class) for r in rows] == [(20.0, 100, "s5"), (0.4, 6, "s4")]
    escaped = html.escape(rows[0].query).replace("&#x27;", "&#39;")
    assert rows[0].query_html == re.sub(f"({MARKED_FRAGMENTS})", r"<mark>\1</mark>", escaped, flags=re.I)
    assert rows[0].path_html == "/a&lt;b" and rows[1].query_html == ""


def verdicts(spark, *rows):
    base = {f: None for f in VERDICT_MESSAGE.fieldNames()}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], VERDICT_MESSAGE)


def test_verdict_table(spark, tmp_path):
    path = str(tmp_path / "verdicts")
    store_verdicts(verdicts(spark, {"path": "/a", "score": 0.1, "is_anomaly": False, "drivers": []},
                            {"path": "/p", "score": 12.0, "is_anomaly": True, "drivers": ["n_special"]}), path, 0)
    store_verdicts(verdicts(spark, {"path": "/late", "is_anomaly": True}, {"path": "/x"}), path, 1)
    store_verdicts(verdicts(spark, {"path": "/late", "is_anomaly": True}, {"path": "/x"}), path, 1)
    table = verdict_store.read_verdicts(spark, path)
    assert verdict_store.verdict_stats(table).first().asDict() == {"total": 4, "anomalies": 2, "anomaly_rate": 0.5}
    for recent in (verdict_store.recent_anomalies(table, 10), verdict_store.read_recent(spark, path, 10)):
        assert [(r.path, r.drivers) for r in recent.collect()] == [("/late", []), ("/p", ["n_special"])]
    assert verdict_store.stored_stats(spark, path).first() == verdict_store.verdict_stats(table).first()
    assert table.select("id").distinct().count() == 4 and table.filter("ts IS NULL").isEmpty()
    for limit in (0, 501):
        with pytest.raises(ValueError):
            verdict_store.recent_anomalies(table, limit)


def test_decimal_rows(spark):
    row = verdict_store.decimal_rows(verdicts(spark, {"score": 0.1, "threshold": 1.2e-5}, {})).collect()
    assert [str(r.score) for r in row] == ["0.10000000000000000", "0E-17"] and row[0].score_text == "0.1" and str(row[0].threshold) == "0.00001200000000000"
    huge = verdict_store.decimal_rows(verdicts(spark, {"score": 1e30, "threshold": 0.14048749062961174})).first()
    assert huge.score is None and huge.score_text == "1.0E30" and str(huge.threshold) == "0.14048749062961174"


def test_usage(spark, tmp_path):
    path = str(tmp_path / "usage")
    summary = spark.sql("SELECT 10L total_lines, 2L anomalies")
    for scan, ip in (("a", "1.1.1.1"), ("b", ""), ("c", "1.1.1.1")):
        record_scan(summary, path, scan, "salt", ip)
    totals = usage.usage_totals(spark.read.schema(SCAN_EVENTS).parquet(path)).first()
    assert tuple(totals) == (3, 30, 6, 2)
    assert tuple(usage.usage_totals(spark.createDataFrame([], SCAN_EVENTS)).first()) == (0, 0, 0, 0)


def test_visitors(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 9.9.9.9", "5.5.5.5"), (None, "5.5.5.5"), (" ,x", None)], "f string, p string")
    rows = df.select(client_ip(F.col("f"), F.col("p")).alias("ip")).select("ip", visitor_hash(F.col("ip"), "salt").alias("h")).collect()
    assert [r.ip for r in rows] == ["1.2.3.4", "5.5.5.5", ""]
    assert rows[2].h == hashlib.sha256(b"salt|unknown").hexdigest()[:32]
