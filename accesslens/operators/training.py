"""Fit the scaler, the network and the threshold on normal traffic."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesslens.functions import autoencoder
from accesslens.functions.verdicts import mean_of
from accesslens.models.bundle import Bundle
from accesslens.operators.scoring import add_errors, standardize
from accesslens.operators.selection import exact_percentile
from accesslens.schemas import FEATURE_NAMES
from accesslens.session import broadcast_small, cut_lineage
from accesslens.sinks import files

#: Rows of one key that go to one task.
HOT_ROWS = 1000
#: Tasks that sum the states of a round: about 2000 numbers from each part, and no shuffle file for every partition.
SUM_TASKS = 8

# The package need not be installed on the workers for this small helper.
cloudpickle.register_pickle_by_value(autoencoder)


def fit_scaler(df: DataFrame) -> DataFrame:
    """Mean and population standard deviation of every feature (one row per feature).

    One aggregate over all features; a feature without spread gets deviation 1.
    Spread is told by the extremes: merged partial deviations need not be exactly 0.
    """
    aggregates = []
    for name in FEATURE_NAMES:
        aggregates += [F.avg(name).alias(f"_mean_{name}"),
                       F.when(F.min(name) == F.max(name), 1.0).otherwise(F.stddev_pop(name)).alias(f"_std_{name}")]
    one = df.agg(*aggregates)
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(n).alias("feature"), F.col(f"_mean_{n}").alias("mean"), F.col(f"_std_{n}").alias("std"))
        for i, n in enumerate(FEATURE_NAMES)])
    return one.select(F.inline(rows))


def error_summary(df: DataFrame, bundle: Bundle, pct: float = 99.0) -> dict:
    """Mean, percentile and maximum reconstruction error of the rows of ``df``."""
    scored, errors = add_errors(df.select(*FEATURE_NAMES), bundle)
    scored = scored.selectExpr(f"{mean_of(errors)} AS error").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, mean, top = scored.agg(F.count("*"), F.avg("error"), F.max("error")).first()
        return {"n_rows": n, "mean": mean, "percentile": exact_percentile(scored, "error", pct), "max": top}
    finally:
        scored.unpersist()


def _packing():
    """Each Arrow batch of ``part, x`` as one row ``part, n, block``: the numbers of its rows as the bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            if record.num_rows:
                block = record.column("x").flatten().to_numpy().tobytes()
                yield pa.RecordBatch.from_arrays(
                    [record.column("part").slice(0, 1), pa.array([record.num_rows], pa.int32()), pa.array([block], pa.binary())],
                    names=["part", "n", "block"])
    return run


def _local_round(state, step, round_no, seed, batch, lr, epochs=1):
    """A task's share of a round: mini-batch Adam over its rows, block by block."""
    loss_and_gradient = autoencoder.gradient

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, m, v = (a.copy() for a in np.split(state, 3))
        t, rows, loss_sum, rng = step, 0, 0.0, None
        for record in batches:
            for part, n, block in zip(*(record.column(c) for c in ("part", "n", "block"))):
                if rng is None:
                    rng = np.random.default_rng([seed, round_no, part.as_py()])
                x = np.frombuffer(block.as_buffer()).reshape(n.as_py(), -1)
                for _ in range(epochs):
                    order = rng.permutation(len(x))
                    for at in range(0, len(x), batch):
                        chunk = x[order[at:at + batch]]
                        loss, grad = loss_and_gradient(flat, chunk)
                        t += 1
                        m = 0.9 * m + 0.1 * grad
                        v = 0.999 * v + 0.001 * grad ** 2
                        flat -= lr * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
                        loss_sum += loss * len(chunk)
                rows += len(x)
        if rows:
            values = np.concatenate([flat, m, v, [loss_sum / rows / epochs, t - step]]) * rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values),
                 pa.array(np.full(len(values), rows, dtype=np.int64))], names=["position", "value", "rows"])
    return run


class Rounds:
    """The scaler and the rounds that a training run keeps in a folder (nowhere, if it names none)."""

    def __init__(self, spark: SparkSession, path: str | None, settings: dict):
        self._spark, self._path, self.last, self._scaler = spark, path and path.rstrip("/"), None, None
        if not path:
            return
        if files.exists(spark, f"{self._path}/settings.json"):
            found = json.loads(files.read_text(spark, f"{self._path}/settings.json"))
            if {k: found[k] for k in settings} != settings:
                raise ValueError(f"the folder belongs to a run with {found}, not {settings}")
            self._scaler = found["scaler"]
            done = [name for name in files.names(spark, self._path) if name.startswith("round-")]
            if done:
                self.last = json.loads(files.read_text(spark, f"{self._path}/{done[-1]}"))
        self._settings = settings

    def scaler(self, fit) -> list:
        if self._scaler is None:
            self._scaler = fit()
            if self._path:
                files.write_text(self._spark, f"{self._path}/settings.json", json.dumps({**self._settings, "scaler": self._scaler}))
        return self._scaler

    def keep(self, state: np.ndarray, step: int, losses: list[float]) -> None:
        """The round's file appears whole under its name; a run that is killed before repeats the round."""
        if self._path:
            row = {"state": state.tolist(), "step": step, "losses": losses}
            files.write_text(self._spark, f"{self._path}/round-{len(losses):06d}.json", json.dumps(row))


def default_partitions(n_rows: int) -> int:
    """How many ways to split the training rows: from the data, not from the cluster."""
    return max(n_rows // 250_000, 4)


def train_detector(df: DataFrame, key: str, rounds: int = 60, batch: int = 128, lr: float = 1e-3,
                   pct: float = 99.0, seed: int = 42, partitions: int | None = None,
                   local_epochs: int = 1, resume: str | None = None) -> tuple[Bundle, list[float]]:
    """Train on normal-only feature rows; returns the detector and the loss per round.

    Data-parallel with parameter averaging: per round every partition runs Adam
    from the shared state over its rows and the states are averaged by row count.
    ``key`` identifies rows; a key of more than HOT_ROWS rows is spread over as many tasks as its count asks for, by
    numbers that the rows got before they were written.  The input is
    read once into the shared folder.  Rows are dealt out and ordered by hashes, and packed once into blocks of an
    Arrow batch each, so that a round hands blocks to Python and turns no row into Arrow again.  The order is fixed
    and the averages are sums of decimals, so a retried task repeats its part and the order of merging does not
    matter; a repeated run may differ in the last digits, as the scaler's averages do.  The
    driver only ever sees the averaged state.

    ``resume`` names a folder that keeps the scaler and, after each round, the averaged state and the losses.  A run that
    finds rounds there goes on after the last of them, with the same input and settings to the same detector; other
    settings or another number of rows are an error.
    """
    spark = df.sparkSession
    df = cut_lineage(df.select(F.xxhash64(key).alias("_h"), F.monotonically_increasing_id().alias("_id"), *FEATURE_NAMES))
    n, n_rows = len(FEATURE_NAMES), df.count()
    if not n_rows:
        raise ValueError("no training rows")
    parts = partitions or default_partitions(n_rows)
    settings = {"rows": n_rows, "parts": parts, "batch": batch, "lr": lr, "seed": seed, "local_epochs": local_epochs}
    kept = Rounds(spark, resume, settings)
    scaler = kept.scaler(lambda: [(r["mean"], r["std"]) for r in fit_scaler(df).orderBy("position").collect()])
    mean, std = [m for m, _ in scaler], [s for _, s in scaler]
    blank = Bundle.from_arrays([np.zeros(s) for s in autoencoder.shapes(n)], [np.zeros(s[0]) for s in autoencoder.shapes(n)], mean, std, 0.0)
    hot = cut_lineage(df.groupBy("_h").count().filter(F.col("count") > HOT_ROWS)
                      .select("_h", F.ceil(F.col("count") / HOT_ROWS).alias("_pieces")))
    spread = F.pmod("_id", F.coalesce("_pieces", F.lit(1)))
    marked = df.join(broadcast_small(hot), "_h", "left").withColumn("_spread", spread)
    dealt = standardize(marked, blank).select("_h", "_spread", F.array(*FEATURE_NAMES).alias("x"))
    dealt = (dealt.repartition(parts, "_h", "_spread").sortWithinPartitions("_h", "_spread", "x")
             .select(F.spark_partition_id().alias("part"), "x"))
    dealt = cut_lineage(dealt.mapInArrow(_packing(), "part int, n int, block binary")).persist(StorageLevel.MEMORY_AND_DISK)

    weights = autoencoder.initial(n, seed)
    state = np.concatenate([weights, np.zeros(2 * len(weights))])
    step, losses = 0, []
    if kept.last is not None:
        state, step, losses = np.array(kept.last["state"]), kept.last["step"], kept.last["losses"]
    if len(losses) > rounds:
        raise ValueError(f"{len(losses)} rounds were done already")
    exact = "decimal(38,18)"
    try:
        for round_no in range(len(losses), rounds):
            run = _local_round(state, step, round_no, seed, batch, lr, local_epochs)
            sums = (dealt.mapInArrow(run, "position int, value double, rows long")
                    .repartition(SUM_TASKS, "position").groupBy("position")
                    .agg(F.sum(F.col("value").cast(exact)).cast("double").alias("total"), F.sum("rows").alias("rows"))
                    .collect())
            averaged = np.array([r["total"] / r["rows"] for r in sorted(sums, key=lambda r: r["position"])])
            state, loss, steps = averaged[:-2], averaged[-2], averaged[-1]
            step += int(round(steps))
            losses.append(float(loss))
            kept.keep(state, step, losses)
    finally:
        dealt.unpersist()

    layers = autoencoder.views(state[:len(weights)], n)
    fitted = Bundle.from_arrays([w for w, _ in layers], [b for _, b in layers], mean, std, 0.0)
    summary = error_summary(df, fitted, pct)
    return Bundle.from_arrays(fitted.weights, fitted.biases, mean, std, summary["percentile"]), losses
