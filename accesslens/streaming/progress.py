"""Running totals of what the stages observed."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Condition

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from accesslens.sinks import files

_KEPT = "query string, batch_id bigint, upto bigint, counts map<string, bigint>"


class ProgressTotals(StreamingQueryListener):
    """Adds up the observed counts of every micro-batch; skipped = consumed - parsed."""

    def __init__(self) -> None:
        self._lock, self._totals, self._ended = Condition(), Counter(), set()

    @classmethod
    @contextmanager
    def listening(cls, spark: SparkSession) -> Iterator[ProgressTotals]:
        """Totals of all queries that start inside the block."""
        totals = cls()
        spark.streams.addListener(totals)
        try:
            yield totals
        finally:
            spark.streams.removeListener(totals)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self._totals.update(count_observed(event.progress))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self._ended.add(str(event.runId))
            self._lock.notify_all()

    def wait_for(self, queries: list[StreamingQuery], seconds: float = 60) -> None:
        """Wait until the last report of each ended query was counted."""
        runs = {str(q.runId) for q in queries}
        with self._lock:
            if not self._lock.wait_for(lambda: runs <= self._ended, seconds):
                raise TimeoutError("a query's end was not reported")

    def totals(self) -> dict[str, int]:
        with self._lock:
            return with_skipped(self._totals)


def count_observed(progress) -> Counter:
    counts = Counter()
    for stage, row in (progress.observedMetrics or {}).items():
        for name, value in row.asDict().items():
            counts[f"{stage}.{name}"] += value or 0
    return counts


def with_skipped(counts: Counter) -> dict[str, int]:
    out = dict(counts)
    if "ingest.consumed" in out:
        out["ingest.skipped"] = out["ingest.consumed"] - out["ingest.parsed"]
    return out


class DurableTotals(ProgressTotals):
    """The same counts, kept in a folder by query and micro-batch: they survive the driver, and a replayed batch counts once.

    Each report becomes one small file named by the query's own id (its checkpoint keeps it) and the batch, written aside
    and renamed; a replay replaces it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        super().__init__()
        self._spark, self._path = spark, path.rstrip("/")

    @classmethod
    @contextmanager
    def kept(cls, spark: SparkSession, path: str) -> Iterator[DurableTotals]:
        """Keep the counts of all queries that start inside the block."""
        totals = cls(spark, path)
        spark.streams.addListener(totals)
        try:
            yield totals
        finally:
            spark.streams.removeListener(totals)

    def onQueryProgress(self, event) -> None:
        keep_counts(self._spark, self._path, str(event.progress.id), event.progress.batchId, count_observed(event.progress))
        super().onQueryProgress(event)


def keep_counts(spark: SparkSession, path: str, query: str, batch_id: int, counts: dict[str, int]) -> None:
    """Write the counts of one micro-batch of one query; what was there for it is replaced.  No counts, no file."""
    if counts:
        row = {"query": query, "batch_id": batch_id, "counts": dict(counts)}
        files.write_text(spark, f"{path.rstrip('/')}/{query}-{batch_id:012d}.json", json.dumps(row))


def _kept(spark: SparkSession, path: str) -> DataFrame:
    """query, batch_id, upto, counts: a row per micro-batch, and folded ones whose upto names the last batch in them."""
    if not any(n.endswith(".json") for n in files.names(spark, path)):
        return spark.createDataFrame([], _KEPT)
    return spark.read.schema(_KEPT).json(f"{path.rstrip('/')}/*.json")


def kept_totals(spark: SparkSession, path: str) -> DataFrame:
    """``name, value``: the counts in a folder summed over all queries and micro-batches, each counted once."""
    rows = _kept(spark, path)
    folded = rows.filter("upto IS NOT NULL").groupBy("query").agg(F.max("upto").alias("upto"), F.max_by("counts", "upto").alias("counts"))
    later = (rows.filter("upto IS NULL").join(folded.select("query", F.col("upto").alias("_upto")), "query", "left")
             .filter("_upto IS NULL OR batch_id > _upto").select("counts"))
    every = folded.select("counts").union(later)
    summed = every.select(F.explode("counts").alias("name", "value")).groupBy("name").agg(F.sum("value").alias("value"))
    consumed, parsed = (F.sum(F.when(F.col("name") == f"ingest.{n}", F.col("value"))) for n in ("consumed", "parsed"))
    skipped = summed.agg((consumed - F.coalesce(parsed, F.lit(0))).alias("value")).filter("value IS NOT NULL")
    return summed.unionByName(skipped.select(F.lit("ingest.skipped").alias("name"), "value"))


def fold_counts(spark: SparkSession, path: str) -> None:
    """Sum each query's micro-batches but the newest, which may be replayed, into one file, and delete theirs."""
    rows = _kept(spark, path)
    newest = rows.groupBy("query").agg(F.max("batch_id").alias("newest"))
    for row in newest.toLocalIterator():
        query, upto = row["query"], row["newest"] - 1
        if upto < 0 or files.exists(spark, f"{path.rstrip('/')}/{query}-folded-{upto:012d}.json"):
            continue
        own = _kept(spark, path).filter((F.col("query") == query) & (F.col("upto").isNotNull() | (F.col("batch_id") <= upto)))
        counts = {r["name"]: r["value"] for r in _sum_of_one(own).collect()}
        files.write_text(spark, f"{path.rstrip('/')}/{query}-folded-{upto:012d}.json", json.dumps({"query": query, "upto": upto, "counts": counts}))
        for name in files.names(spark, path):
            number = name.removesuffix(".json").rpartition("-")[2]
            if name.startswith(f"{query}-") and number.isdigit() and int(number) <= upto and name != f"{query}-folded-{upto:012d}.json":
                files.delete(spark, f"{path.rstrip('/')}/{name}")


def _sum_of_one(rows: DataFrame) -> DataFrame:
    last = rows.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]
    kept = rows.filter((F.col("upto") == last) | (F.col("upto").isNull() & (F.col("batch_id") > last)))
    return kept.select(F.explode("counts").alias("name", "value")).groupBy("name").agg(F.sum("value").alias("value"))
