"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores.  The events are first written into one file of many row
groups, as a large log would have, so that all cores have splits to read.  Every query runs once to warm up and is then
timed; all its columns are produced, none are collected.  The training-data operators run over the same tables, once
to warm up and once timed, and are summed apart.
"""

import importlib.util
import json
import os
import statistics
import tempfile
import time

import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from accesslens.plans.queries import all_queries
from accesslens.session import checkpoint_dir

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "suspicious_by_status", "parsed_requests", "parse_quality_report", "target_split", "features_structural",
    "features_entropy", "fit_scaler", "score_requests", "top_drivers", "error_threshold", "scan_summary",
    "anomaly_report", "label_join", "eval_metrics", "parsed_messages", "keyed_lines", "recent_anomalies",
    "usage_totals", "numbered_lines", "stream_pipeline", "stream_stages", "reconstructions", "eval_misses",
    "verdict_stats", "upload_scan", "eval_files", "sketched_visitors",
]
#: Too long to repeat: run once, compilation included.
ONCE = ["train_detector"]
LLM = ["op2_hilbert_shards", "op5_bpe_automaton", "op6_pivotal_mixing", "op7_exact_dedup", "op10_line_dedup",
       "op11_spelling_variants", "op12_host_reputation", "op13_filter_audit"]


def split_tables(folder: str) -> tuple[str, int, int]:
    """The tables in a folder of their own, events in 8 row groups for each core; also the file's bytes and rows."""
    for name in os.listdir(SF_DIR):
        if name != "events.parquet":
            os.symlink(os.path.join(os.path.abspath(SF_DIR), name), os.path.join(folder, name))
    events, path = pq.read_table(f"{SF_DIR}/events.parquet"), f"{folder}/events.parquet"
    pq.write_table(events, path, row_group_size=max(1, events.num_rows // (8 * int(CPUS))))
    return folder, os.path.getsize(path), events.num_rows


def main() -> None:
    folder, size, rows = split_tables(tempfile.mkdtemp(prefix="bench-tables-"))
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.sql.files.maxPartitionBytes", str(max(1 << 16, size // int(CPUS))))
             .config("spark.sql.files.openCostInBytes", "65536")
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    checkpoint_dir(spark)

    def timed(query, runs: int) -> list[float]:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return times

    queries, seconds, llm = all_queries(), {}, {}
    for name in HEADLINE + ONCE:
        times = timed(queries[name], 1 if name in ONCE else RUNS + 1)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    if importlib.util.find_spec("accesslens.llm") and importlib.util.find_spec("accesslens.llm.queries"):
        llm_queries = importlib.import_module("accesslens.llm.queries").llm_queries()
        llm = {name: round(timed(llm_queries[name], 2)[1], 3) for name in LLM}
    print(json.dumps({
        "metric": "total seconds of the headline queries, warm medians",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": {**seconds, **llm},
        "llm_seconds": round(sum(llm.values()), 3),
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS), "lines": rows,
        "lines_per_sec": {n: round(rows / seconds[n]) for n in ("parsed_requests", "features_structural", "score_requests")},
        "lines_per_sec_and_core": {n: round(rows / seconds[n] / int(CPUS)) for n in ("parsed_requests", "features_structural", "score_requests")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
