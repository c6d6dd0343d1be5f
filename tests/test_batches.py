"""Batch tables, durable counts, resumable training, folders of logs, sketches."""

import threading

import numpy as np
import pytest
from conftest import CALM, DEEP, DENSE, LOUD, calm_lines, lines_frame
from pyspark.sql import functions as F

from accesslens.models.bundle import packaged
from accesslens.operators import messages, reports, usage, verdict_store
from accesslens.operators.featurizing import add_feature_array, add_features
from accesslens.operators.parsing import parse_requests
from accesslens.operators.scoring import add_errors, reconstruct, score_lines
from accesslens.operators.selection import RANK_ERROR, error_sketches, merged_percentile
from accesslens.operators.training import HOT_ROWS, train_detector
from accesslens.functions import verdicts as v
from accesslens.functions.log_format import strip_line_end
from accesslens.plans import queries
from accesslens.plans.event_lines import event_lines, messy_lines
from accesslens.plans.workflows import calibrate, evaluate_logs, scan_frame, scan_upload
from accesslens.schemas import MANIFEST, SCAN_EVENTS, SCORED_MESSAGE, VERDICT_MESSAGE, VERDICT_TABLE
from accesslens.session import scratch_path, tune
from accesslens.sinks import batches, files
from accesslens.sinks.publish import publish_once
from accesslens.sinks.stores import latest_sketches, record_scans, record_sketches, store_decimals, store_verdicts
from accesslens.sources.labels import normal_name, read_file_labels
from accesslens.sources.logs import read_numbered_lines, stream_lines, stream_logs
from accesslens.sources.messages import decode_parsed, decode_verdicts
from accesslens.streaming import stages
from accesslens.streaming.progress import DurableTotals, fold_counts, keep_counts, kept_totals


def verdicts(spark, *rows):
    base = {f: None for f in VERDICT_MESSAGE.fieldNames()}
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], VERDICT_MESSAGE)


def flagged(spark, batch, n=3):
    return verdicts(spark, *[{"offset": 100 * batch + i, "path": f"/b{batch}", "is_anomaly": i % 2 == 0, "score": 1.5} for i in range(n)])


def paths(df):
    return sorted(r["path"] for r in df.collect())


# ---- batches


def test_a_reader_sees_the_old_batch_until_the_new_one_is_published(spark, tmp_path):
    table = str(tmp_path / "t")
    assert verdict_store.read_verdicts(spark, table).isEmpty() and verdict_store.read_recent(spark, table).isEmpty()
    store_verdicts(flagged(spark, 1), table, 1)
    open_before = verdict_store.read_verdicts(spark, table)
    new = verdict_store.stored_rows(verdicts(spark, {"path": "/new", "is_anomaly": True}), 1)
    attempt = batches.write_aside(new, table, 1, ["is_anomaly"])
    assert paths(verdict_store.read_verdicts(spark, table)) == ["/b1"] * 3, "written, not published"
    batches.publish(spark, table, 1, attempt, new.schema)
    assert paths(verdict_store.read_verdicts(spark, table)) == ["/new"]
    assert paths(open_before) == ["/b1"] * 3, "a reader that began before still has what it saw"
    batches.publish(spark, table, 1, attempt, new.schema)
    assert paths(verdict_store.read_verdicts(spark, table)) == ["/new"]
    assert verdict_store.stored_stats(spark, table).first()["total"] == 1
    assert batches.drop_superseded(spark, table) == 1 and batches.drop_superseded(spark, table) == 0
    assert paths(verdict_store.read_verdicts(spark, table)) == ["/new"]


def test_reads_during_replays(spark, tmp_path):
    table, seen, stop = str(tmp_path / "t"), [], threading.Event()
    store_verdicts(flagged(spark, 0), table, 0)

    def read():
        while not stop.is_set():
            seen.append(verdict_store.read_verdicts(spark, table).count())
    reader = threading.Thread(target=read)
    reader.start()
    try:
        for n in (5, 3, 5):
            store_verdicts(flagged(spark, 0, n), table, 0)
    finally:
        stop.set()
        reader.join()
    assert seen and set(seen) <= {3, 5}


def test_recent_opens_only_the_newest_folders(spark, tmp_path):
    table = str(tmp_path / "t")
    for batch in (1000, 1001):
        store_verdicts(flagged(spark, batch, 7), table, batch)
    # a thousand older batches whose folders are not even there
    rows = [(b, f"gone{b}", 1, 10, b % 3, None) for b in range(1000)]
    old = spark.createDataFrame(rows, "batch_id long, attempt string, version long, total long, anomalies long, greatest_id decimal(38,0)")
    old.coalesce(1).write.mode("append").parquet(f"{table}/manifest/block=0")
    recent = verdict_store.read_recent(spark, table, 6)
    assert [r["offset"] for r in recent.collect()] == [100106, 100104, 100102, 100100, 100006, 100004]
    assert len({f.split("batch_id=")[1].split("/")[0] for f in recent.inputFiles()}) == 2
    assert len({f.split("batch_id=")[1].split("/")[0] for f in verdict_store.read_recent(spark, table, 4).inputFiles()}) == 1
    stats = verdict_store.stored_stats(spark, table)
    assert stats.first().asDict() == {"total": 10_014, "anomalies": 999 + 8, "anomaly_rate": 0.1006}
    assert "data/batch_id" not in stats._jdf.queryExecution().executedPlan().toString()
    for limit in (0, 501):
        with pytest.raises(ValueError):
            verdict_store.read_recent(spark, table, limit)
    assert verdict_store.stored_stats(spark, str(tmp_path / "none")).first().asDict() == {"total": 0, "anomalies": 0, "anomaly_rate": 0.0}


def test_folding_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(batches, "BLOCK", 2)
    table = str(tmp_path / "t")
    for batch in (0, 1, 1, 2, 3, 4):
        store_verdicts(flagged(spark, batch), table, batch)
    before = sorted(map(tuple, batches.live_batches(spark, table).collect()))
    batches.fold_manifest(spark, table)
    assert [sum(n.startswith("part-") for n in files.names(spark, f"{table}/manifest/block={b}")) for b in (0, 1, 2)] == [1, 1, 1]
    batches.fold_manifest(spark, table)
    assert sorted(map(tuple, batches.live_batches(spark, table).collect())) == before
    assert batches.manifest_rows(spark, table).count() == 6 and [r[1] for r in before] == [1, 2, 1, 1, 1]
    store_verdicts(flagged(spark, 1, 9), table, 1)
    assert verdict_store.read_verdicts(spark, table).count() == 4 * 3 + 9
    assert set(batches.manifest_rows(spark, table).columns) == set(MANIFEST.fieldNames())


def test_an_empty_batch(spark, tmp_path):
    table = str(tmp_path / "t")
    store_verdicts(flagged(spark, 0, 0), table, 0)
    assert verdict_store.read_verdicts(spark, table).count() == 0
    store_verdicts(flagged(spark, 0, 2), table, 0)
    store_verdicts(flagged(spark, 1, 0), table, 1)
    assert verdict_store.read_verdicts(spark, table).columns == VERDICT_TABLE.fieldNames()
    assert [r["path"] for r in verdict_store.read_recent(spark, table, 5).collect()] == ["/b0"]


def test_decimals_are_stored(spark, tmp_path):
    table = str(tmp_path / "t")
    store_decimals(verdicts(spark, {"offset": 1, "score": 0.1, "threshold": 1.2e-5, "is_anomaly": True}, {"offset": 2, "score": 1e30}), table, 3)
    one, two = verdict_store.read_decimals(spark, table).orderBy("offset").collect()
    assert (str(one["score"]), str(one["threshold"]), one["batch_id"], one["is_anomaly"]) == ("0.10000000000000000", "0.00001200000000000", 3, True)
    assert (two["score"], two["score_text"], two["is_anomaly"], two["drivers"]) == (None, "1.0E30", False, [])


def test_a_batch_of_messages_is_published_once(spark, tmp_path):
    out = str(tmp_path / "m")
    assert publish_once(lines_frame(spark, ["a", "b"]), out, 0)
    assert not publish_once(lines_frame(spark, ["c"]), out, 0)
    assert publish_once(lines_frame(spark, ["d"]), out, 1)
    assert sorted(r["value"] for r in spark.read.text(f"{out}/batch-*").collect()) == ["a", "b", "d"]


# ---- streams of logs


def test_streamed_logs_name_their_lines(spark, trained, tmp_path):
    base = tmp_path / "run"
    (base / "in" / "sub").mkdir(parents=True)
    logs = {"one.log": [CALM, "junk", LOUD] * 40, "two.log": ["", DENSE], "sub/three log.log": [DEEP]}
    for name, lines in logs.items():
        (base / "in" / name).write_text("\n".join(lines) + "\n")

    def run():
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        try:
            arrived = stream_logs(spark, f"{base}/in/*", 1).union(stream_logs(spark, f"{base}/in/sub/*", 1))
            stages.start_log_ingest(arrived, f"{base}/parsed", f"{base}/c1", once=True).awaitTermination()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        scored = stages.score_stage(stream_lines(spark, f"{base}/parsed/batch-*"), trained[0], logs=True)
        stages.start_messages(scored, f"{base}/results", f"{base}/c2", once=True).awaitTermination()
        rows = stages.store_stage(stream_lines(spark, f"{base}/results"), logs=True)
        stages.start_store(rows, f"{base}/table", f"{base}/c3", once=True).awaitTermination()

    run()
    run()
    (base / "in" / "late.log").write_text(f"junk\n{LOUD}\n")
    run()
    assert len(list((base / "parsed").glob("batch-*"))) >= 3
    got = {(r["file"].rpartition("/")[2], r["offset"]): r["raw"] for r in verdict_store.read_verdicts(spark, f"{base}/table").collect()}
    want = {(name.rpartition("/")[2].replace(" ", "%20"), i): line for name, lines in logs.items() for i, line in enumerate(lines, 1) if line.startswith("203")}
    assert got == want | {("late.log", 2): LOUD}


# ---- scans and evaluations


def test_a_scan_parses_once(spark, trained, tmp_path):
    log = tmp_path / "an upload.log"
    log.write_text("\n".join([CALM, "junk", "", LOUD]) + "\n")
    report = scan_upload(spark, str(log), trained[0])
    assert report.summary.first().asDict() == {"filename": "an upload.log", "total_lines": 4, "parsed": 2, "anomalies": 1, "anomaly_rate": 0.5,
                                               "threshold": trained[0].threshold, "truncated": False}
    for frame in (report.summary, report.anomalies, report.scored):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" not in plan and "Relation" in plan, "read from what was written"
    assert report.scored.count() == 2 and "parsed" not in report.scored.columns
    assert scan_frame(lines_frame(spark, [CALM]), trained[0]).summary.columns[0] == "total_lines"


def test_evaluation_of_a_folder(spark, trained, tmp_path):
    logs = tmp_path / "logs dir"
    (logs / "a").mkdir(parents=True)
    (logs / "a" / "x y+z.log").write_text("\n".join([CALM, LOUD, "junk", CALM]) + "\n")
    (logs / "b.log").write_text("\n".join([DENSE, CALM]) + "\n")
    labels = tmp_path / "labels.csv"
    labels.write_text("file,line_no,label\n./a/x y+z.log,1,0\na//x y+z.log,2,1\na/x y+z.log,3,1\n/b.log,1,1\nb.log,2,1\nb.log,2,1\nc.log,1,1\n")
    result = evaluate_logs(spark, str(logs), str(labels), trained[0])
    assert tuple(result.quality.first())[:5] == (4, 2, 0, 1, 1)
    labels.write_text("file,line_no,label\nb.log,2,1\n./b.log,2,0\n")
    with pytest.raises(Exception, match="two labels for line 2 of b.log"):
        read_file_labels(spark, str(labels)).collect()
    names = spark.createDataFrame([("./a/b",), ("/a//b",), ("a\\b",), ("././a/./b",), (None,)], "n string")
    assert [r[0] for r in names.select(normal_name(F.col("n"))).collect()] == ["a/b"] * 4 + [None]


def test_severity_of_a_long_report_has_no_single_task(spark):
    df = spark.range(5000).select(F.col("id").alias("line_no"), (F.col("id") / 10).alias("score"))
    out = reports.with_severity(df, 0.5)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.agg(F.max("bar_width"), F.min("bar_width")).first()[:] == (100, 6)
    assert reports.with_severity(df.filter("id < 0"), 0.5).count() == 0


def test_reconstruction_by_columns_is_the_vectorized_one(spark):
    df = add_feature_array(add_features(parse_requests(lines_frame(spark, calm_lines(50) + [LOUD, DEEP]), keep=["line_no"])))
    both = reconstruct(df, packaged()).select("recon", v.reconstruct_udf(spark, packaged())("features").alias("other")).collect()
    assert len(both) == 52 and all(np.allclose(r["recon"], r["other"], rtol=1e-9, atol=1e-9) for r in both)
    frame, names = add_errors(df, packaged())
    assert len(names) == 20 and frame.count() == 52


# ---- sketches


def test_sketched_threshold(spark, trained, tmp_path):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.exponential(size=30_000), np.full(2000, 7.0)])
    df = spark.createDataFrame([(float(x), f"log{i % 17}") for i, x in enumerate(values)], "x double, part string")
    sketches = error_sketches(df.unionByName(df.limit(1).withColumn("x", F.lit(None).cast("double"))), "x", "part")
    assert sketches.count() == 17 and sketches.agg(F.sum("n")).first()[0] == 32_000
    for pct in (1, 50, 99, 99.9):
        found = merged_percentile(sketches, pct)
        assert (values < found).mean() - RANK_ERROR <= pct / 100 <= (values <= found).mean() + RANK_ERROR
    with pytest.raises(ValueError):
        merged_percentile(sketches.limit(0), 50)
    for i in range(3):
        (tmp_path / f"{i}.log").write_text("\n".join(calm_lines(400 * (i + 1))) + "\n")
    exact, near = (calibrate(spark, str(tmp_path), trained[0], 95, exact=e) for e in (True, False))
    errors = np.array([r[0] for r in score_lines(read_numbered_lines(spark, str(tmp_path)), trained[0]).select("error").collect()])
    assert exact.threshold == pytest.approx(np.percentile(errors, 95))
    assert (errors < near.threshold).mean() - RANK_ERROR <= 0.95 <= (errors <= near.threshold).mean() + RANK_ERROR
    assert near.weights == trained[0].weights


def test_sketched_visitors(spark, tmp_path):
    events, sketches = str(tmp_path / "events"), str(tmp_path / "sketches")
    for day in range(4):
        scans = spark.range(5000).select(F.concat(F.lit(f"{day}-"), "id").alias("scan_id"), F.lit(2).cast("bigint").alias("total_lines"),
                                         F.lit(1).cast("bigint").alias("anomalies"), (F.col("id") + 2000 * day).cast("string").alias("ip"))
        record_scans(scans, f"{events}/day={day}", "salt")
        record_sketches(spark, f"{events}/day={day}", sketches, f"day{day}")
    record_sketches(spark, f"{events}/day=3", sketches, "day3")
    found = usage.sketched_totals(latest_sketches(spark, sketches)).first()
    assert found[:3] == (20_000, 40_000, 20_000)
    assert abs(found["unique_visitors"] - 11_000) <= usage.SKETCH_ERROR * 11_000
    assert usage.sketched_totals(usage.usage_sketches(spark.createDataFrame([], SCAN_EVENTS), F.lit("x"))).first()[:] == (0, 0, 0, 0)


# ---- counts that last


def test_counts_survive_and_replays_count_once(spark, tmp_path):
    kept = str(tmp_path / "kept")
    assert kept_totals(spark, kept).count() == 0
    for batch in range(6):
        keep_counts(spark, kept, "q1", batch, {"ingest.consumed": 10, "ingest.parsed": 9})
    keep_counts(spark, kept, "q1", 5, {"ingest.consumed": 7, "ingest.parsed": 7})
    keep_counts(spark, kept, "q2", 0, {"score.scored": 4})
    keep_counts(spark, kept, "q2", 1, {})
    want = {"ingest.consumed": 57, "ingest.parsed": 52, "ingest.skipped": 5, "score.scored": 4}
    totals = lambda: {r["name"]: r["value"] for r in kept_totals(spark, kept).collect()}
    assert totals() == want
    for _ in range(2):
        fold_counts(spark, kept)
        assert totals() == want
    assert len(files.names(spark, kept)) == 3
    keep_counts(spark, kept, "q1", 5, {"ingest.consumed": 8, "ingest.parsed": 8})
    keep_counts(spark, kept, "q1", 6, {"ingest.consumed": 1, "ingest.parsed": 0})
    want |= {"ingest.consumed": 59, "ingest.parsed": 53, "ingest.skipped": 6}
    assert totals() == want
    fold_counts(spark, kept)
    assert totals() == want


def test_counts_of_a_restarted_query(spark, trained, tmp_path):
    kept = str(tmp_path / "kept")
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.log").write_text(f"{CALM}\njunk\n")
        with DurableTotals.kept(spark, kept) as seen:
            query = stages.start_messages(stages.ingest_stage(stream_lines(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c"), once=True)
            query.awaitTermination()
            seen.wait_for([query])
    assert {r["name"]: r["value"] for r in kept_totals(spark, kept).collect()} == {"ingest.consumed": 6, "ingest.parsed": 3, "ingest.skipped": 3}


# ---- training


def test_a_killed_training_goes_on(spark, tmp_path):
    df = add_features(parse_requests(lines_frame(spark, calm_lines(500)), keep=["line_no"])).persist()
    whole, losses = train_detector(df, "line_no", rounds=5)
    state = str(tmp_path / "state")
    train_detector(df, "line_no", rounds=2, resume=state)
    (tmp_path / "state" / "_half-written").write_text("{")
    resumed, again = train_detector(df, "line_no", rounds=5, resume=state)
    assert np.allclose(again, losses, rtol=1e-9) and len(files.names(spark, state)) >= 6
    assert all(np.allclose(a, b, rtol=1e-7, atol=1e-9) for a, b in zip(whole.weights, resumed.weights, strict=True))
    same, _ = train_detector(df, "line_no", rounds=5, resume=state)
    assert same.weights == resumed.weights
    for options in ({"rounds": 4}, {"rounds": 9, "seed": 1}):
        with pytest.raises(ValueError):
            train_detector(df, "line_no", resume=state, **options)
    with pytest.raises(ValueError, match="no training rows"):
        train_detector(df.limit(0), "line_no")


def test_a_hot_key_is_spread_by_its_count(spark):
    lines = calm_lines(2600)
    df = add_features(parse_requests(lines_frame(spark, lines), keep=["line_no"])).withColumn("line_no", F.lit(1))
    bundle, losses = train_detector(df, "line_no", rounds=1, partitions=4)
    assert len(lines) > 2 * HOT_ROWS and bundle.threshold > 0 and len(losses) == 1


def test_scratch_folders_are_new_each_time(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.endswith("/x") and not files.exists(spark, a)
    files.write_text(spark, f"{a}/note", "é")
    assert files.read_text(spark, f"{a}/note") == "é" and files.names(spark, a) == ["note"]


def test_messages_without_a_log_have_no_file(spark):
    df = lines_frame(spark, [CALM]).withColumnRenamed("line_no", "offset")
    assert '"file"' not in messages.encode_parsed(messages.parsed_records(df)).first()["value"]


# ---- tasks of the derived lines


def test_one_row_group_gives_rows_to_all_tasks(spark, tmp_path):
    """Also where only a range of ids is wanted; every event gives its line, repeated and null ids too."""
    ids = F.when(F.col("id") % 500 != 7, F.col("id") % 1900)
    events = spark.range(2000).select(
        ids.alias("event_id"), F.lit("2027-03-07 10:00:00").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"),
        (F.col("id") / 7).alias("value"), F.lit("{}").alias("props"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for lines in (event_lines(spark, str(tmp_path)), messy_lines(spark, str(tmp_path)), event_lines(spark, str(tmp_path)).filter("event_id BETWEEN 500 AND 999")):
            assert lines.select(F.spark_partition_id()).distinct().count() == 8
        assert event_lines(spark, str(tmp_path)).count() == 2000
        assert event_lines(spark, str(tmp_path)).filter("event_id IS NULL").count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


# ---- work and tasks of the staged stream


def test_the_text_of_a_message_is_settled_before_it_is_parsed(spark):
    """The parser is not compiled, so it must not hold the decoding of the text either."""
    value = F.make_valid_utf8(F.concat(F.lit('{"offset": '), F.col("id"), F.lit("}"))).alias("value")
    for decode in (decode_parsed, decode_verdicts):
        rows = decode(spark.range(2).select(value))
        parser = [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "from_json(" in x]
        assert len(parser) == 1 and "makeValid" not in parser[0]
        assert sorted(r.offset for r in rows.collect()) == [0, 1]


def test_scoring_reads_what_it_needs_of_a_message(spark, trained):
    """Fewer fields give the same verdicts, also of messages that lack fields, hold wrong ones or are none."""
    df = lines_frame(spark, [CALM + "\r\n", "junk", LOUD]).withColumnRenamed("line_no", "offset")
    odd = spark.createDataFrame([('{"offset": 7}',), ("no message",), (None,), ('{"offset": 8, "record": {"bytes": "x", "path": "/p"}, "features": []}',)], "value string")
    sent = messages.encode_parsed(messages.parsed_records(df)).union(odd)
    every, needed = (messages.verdicts(decode_parsed(sent, **fields), trained[0]) for fields in ({}, {"schema": SCORED_MESSAGE}))
    assert sorted(map(str, every.collect())) == sorted(map(str, needed.collect())) and needed.count() == 6
    stage = stages.score_stage(spark.range(1).select(F.col("id").cast("string").alias("value")), trained[0])
    assert "user_agent" not in stage._jdf.queryExecution().optimizedPlan().toString()


def test_line_ends_are_stripped(spark):
    lines = ["a", "a\n", "a\r\n", "a\n\r\r", "a\nb", "\n", "", " \n", None]
    rows = spark.createDataFrame([(x,) for x in lines], "v string").select(strip_line_end(F.col("v")).alias("v")).collect()
    assert [r.v for r in rows] == [x if x is None else x.rstrip("\r\n") for x in lines]


def test_scans_are_cut_finely_whatever_executors_are_there(spark):
    """A session may start before its executors have."""
    session = spark.newSession()
    session.conf.unset("spark.sql.files.minPartitionNum")
    assert int(tune(session).conf.get("spark.sql.files.minPartitionNum")) >= 64


def test_each_log_is_written_by_a_task_of_its_own(spark, tmp_path):
    ids = F.when(F.col("id") != 5, F.col("id") % 3000 - 10)
    events = spark.range(4000).select(
        ids.alias("event_id"), F.lit("2027-03-07 10:00:00").cast("timestamp_ntz").alias("ts"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"),
        (F.col("id") / 7).alias("value"), F.lit("{}").alias("props"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    logs = spark.read.text(queries._log_folder(spark, str(tmp_path), "logs")).withColumn("file", F.col("_metadata.file_name"))
    task = F.regexp_extract("file", "part-([0-9]+)", 1)
    found = logs.filter("part BETWEEN 1 AND 15").select("part", task.alias("task")).distinct().collect()
    assert logs.count() == 4000 and len(found) == 15 and len({r.task for r in found}) == 15
