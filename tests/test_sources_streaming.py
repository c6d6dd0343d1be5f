import json

import pytest
from conftest import LOUD, CALM, DENSE, lines_frame

from accesslens.operators import messages, verdict_store
from accesslens.sinks.publish import publish_shards, publish_text
from accesslens.sinks.stores import store_verdicts
from accesslens.sources.logs import drop_blank, read_lines, read_numbered_lines, read_requests, stream_lines
from accesslens.sources.messages import decode_parsed, decode_verdicts
from accesslens.streaming import stages
from accesslens.streaming.progress import ProgressTotals


@pytest.mark.parametrize("split_bytes", ["700", "4096", "128m"])
def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_path, split_bytes):
    want = {}
    for name, n in (("a.log", 500), ("b.log", 3), ("c.log", 120)):
        rows = [f"{name} {i}" if i % 9 else "" for i in range(n)]
        (tmp_path / name).write_text("\n".join(rows) + "\n")
        want |= {(name, i + 1): r for i, r in enumerate(rows)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        for bound in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
            df = read_numbered_lines(spark, str(tmp_path))
            got = {(r.file.rsplit("/", 1)[1], r.line_no): r.value for r in df.collect()}
            assert got == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_line_ends_and_bad_bytes(spark, tmp_path):
    raw = b"a\xff\r\nb\n\n\xe2\x82x\nlast"
    (tmp_path / "x.log").write_bytes(raw)
    got = sorted(r.value for r in read_lines(spark, str(tmp_path / "x.log")).collect())
    want = raw.decode("utf-8", errors="replace").replace("\r\n", "\n").split("\n")
    assert got == sorted(want)


def test_requests_and_blank_lines(spark, tmp_path):
    (tmp_path / "x.log").write_text(f"{CALM}\njunk\n\n{LOUD}\n")
    assert read_requests(spark, str(tmp_path / "x.log")).count() == 2
    assert drop_blank(lines_frame(spark, ["a\r\n", "\r\n", "", " "])).count() == 2


def test_keyed_lines_and_shards(spark, tmp_path):
    keyed = messages.keyed_lines(lines_frame(spark, [CALM, "junk", "", LOUD] * 50))
    assert {r["key"] for r in keyed.collect()} == {"203.0.113.5", "unknown", "203.0.113.77"}
    publish_shards(keyed, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 150 and back.select("key", "shard").distinct().count() == 3
    assert messages.keyed_lines(lines_frame(spark, [CALM] * 9), limit=5).count() == 5


def test_messages(spark, trained):
    df = lines_frame(spark, [CALM + "\n", "junk", LOUD]).withColumnRenamed("line_no", "offset")
    encoded = messages.encode_parsed(messages.parsed_records(df))
    first = json.loads(encoded.first().value)
    assert set(first) == {"offset", "raw", "record", "features"} and first["raw"].endswith("\n")
    assert first["record"]["timestamp"] == "2027-03-07T00:00:00+00:00" and len(first["features"]) == 20
    rows = messages.encode_verdicts(messages.verdicts(decode_parsed(encoded), trained[0]))
    out = {r.offset: r for r in decode_verdicts(rows).collect()}
    assert set(out) == {1, 3} and out[3].is_anomaly and not out[1].is_anomaly and len(out[3].drivers) == 3
    sparse = decode_verdicts(spark.createDataFrame([('{"path": "/attack", "is_anomaly": true}',)], "value string"))
    assert sparse.first().path == "/attack" and sparse.first().score is None


def run_pipeline(spark, trained, base, listener=None):
    parsed = stages.start_messages(stages.ingest_stage(stream_lines(spark, f"{base}/in", 1)), f"{base}/parsed",
                                   f"{base}/c1", once=True)
    parsed.awaitTermination()
    results = stages.start_messages(stages.score_stage(stream_lines(spark, f"{base}/parsed"), trained[0]),
                                    f"{base}/results", f"{base}/c2", once=True)
    results.awaitTermination()
    stored = stages.start_store(stages.store_stage(stream_lines(spark, f"{base}/results")), f"{base}/table",
                                f"{base}/c3", once=True)
    stored.awaitTermination()
    return [parsed, results, stored]


def test_stages_store_what_a_batch_scores(spark, trained, tmp_path):
    base = str(tmp_path)
    publish_text(lines_frame(spark, [CALM, "junk", LOUD]), f"{base}/in")
    with ProgressTotals.listening(spark) as seen:
        seen.wait_for(run_pipeline(spark, trained, base))
    assert seen.totals() == {"ingest.consumed": 3, "ingest.parsed": 2, "ingest.skipped": 1, "score.scored": 2,
                      "score.anomalies": 1, "store.stored": 2, "store.anomalies": 1}
    publish_text(lines_frame(spark, [DENSE]), f"{base}/in", mode="append")
    run_pipeline(spark, trained, base)
    run_pipeline(spark, trained, base)
    table = verdict_store.read_verdicts(spark, f"{base}/table")
    assert table.count() == 3
    newest = verdict_store.recent_anomalies(table).collect()
    assert [r.path for r in newest] == ["/dense", "/loud"]

    lines = lines_frame(spark, [CALM, "junk", LOUD, DENSE]).withColumnRenamed("line_no", "offset")
    store_verdicts(messages.verdicts(messages.parsed_records(lines), trained[0]), f"{base}/batch")
    columns = ["raw", "score", "is_anomaly", "drivers"]
    batch = verdict_store.read_verdicts(spark, f"{base}/batch").select(columns)
    assert sorted(map(str, table.select(columns).collect())) == sorted(map(str, batch.collect()))


def test_fused_query_and_listener(spark, trained, tmp_path):
    publish_text(lines_frame(spark, [CALM, LOUD]), str(tmp_path / "in"))
    listener = ProgressTotals()
    spark.streams.addListener(listener)
    try:
        query = stages.start_store(stages.fused_verdicts(stream_lines(spark, str(tmp_path / "in")), trained[0]),
                                   str(tmp_path / "table"), str(tmp_path / "c"), once=True)
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert listener.totals()["store.stored"] == 2
    assert verdict_store.verdict_stats(verdict_store.read_verdicts(spark, str(tmp_path / "table"))).first().anomalies == 1


def test_totals_count_more_batches_than_a_query_remembers(spark, tmp_path):
    for i in range(130):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.log").write_text(CALM + "\n")
    with ProgressTotals.listening(spark) as seen:
        query = stages.start_messages(stages.ingest_stage(stream_lines(spark, str(tmp_path / "in"), 1)), str(tmp_path / "out"), str(tmp_path / "c"), once=True)
        query.awaitTermination()
        seen.wait_for([query])
    assert seen.totals()["ingest.consumed"] == 130


def test_ids_of_long_partitions_and_late_batches(spark):
    ids = spark.range(0, 17_000_000, 1, 1).select(verdict_store.verdict_id(1 << 40).alias("id"))
    low, high = ids.selectExpr("min(id)", "max(id)").first()
    assert int(low) == 1 << 103 and int(high) - int(low) == 16_999_999
