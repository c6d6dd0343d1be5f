import json
import random

import numpy as np
import pytest
from conftest import LOUD, CALM, DENSE, DEEP, lines_frame, calm_lines
from pyspark.sql import functions as F

from accesslens.functions import autoencoder
from accesslens.models.bundle import Bundle, packaged
from accesslens.operators.featurizing import add_features
from accesslens.operators.parsing import parse_requests
from accesslens.operators.scoring import score_features, score_lines, score_parity
from accesslens.operators import training
from accesslens.operators.selection import exact_percentile
from accesslens.operators.training import error_summary, fit_scaler, train_detector
from accesslens.schemas import FEATURE_NAMES
from accesslens.sinks.stores import save_bundle
from accesslens.sources.bundles import load_bundle

def expected(bundle, vectors):
    x = (np.asarray(vectors) - bundle.mean) / bundle.std
    h = x
    for i, (w, b) in enumerate(zip(bundle.weights, bundle.biases)):
        h = h @ np.asarray(w).T + b
        h = np.maximum(h, 0) if i < 3 else h
    return (h - x) ** 2


def test_training_lowers_the_loss_and_separates(spark, trained):
    bundle, losses = trained
    assert losses[-1] < losses[0] / 3
    rows = score_lines(lines_frame(spark, [CALM, LOUD, DENSE, DEEP]), bundle).orderBy("line_no").collect()
    assert [r.is_anomaly for r in rows] == [False, True, True, True]
    assert rows[1].score > rows[0].score and all(len(r.top_features) == 3 for r in rows)
    assert {"n_special", "query_entropy", "n_suspicious_tokens", "ua_is_tool"} & set(rows[2].drivers)


def test_vectors_are_scored_as_they_arrive(spark, trained):
    bundle, _ = trained
    own = add_features(parse_requests(lines_frame(spark, [CALM, LOUD]), keep=["line_no"])).orderBy("line_no").collect()
    vectors = [[float(r[n]) for n in FEATURE_NAMES] for r in own]
    df = spark.createDataFrame(list(enumerate(vectors)), "id int, features array<double>")
    normal, attack = score_features(df, bundle).orderBy("id").collect()
    assert not normal.is_anomaly and attack.is_anomaly and len(normal.drivers) == 3


def test_scores_match_numpy_and_a_filter_keeps_them(spark, trained):
    bundle, _ = trained
    rng = np.random.default_rng(5)
    vectors = rng.uniform(0, 20, (50, 20)).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "id int, features array<double>")
    scored = score_features(df, bundle, top_k=4)
    want = expected(bundle, vectors)
    for r in scored.collect():
        e = want[r.id]
        assert abs(r.error - e.mean()) < 1e-9 * max(1, e.mean())
        assert r.drivers == [FEATURE_NAMES[i] for i in np.argsort(e, kind="stable")[::-1][:4]]
        assert r.is_anomaly == (r.error > bundle.threshold)
    assert scored.filter(F.col("error") > 0).filter("is_anomaly").count() == sum(want.mean(axis=1) > bundle.threshold)


def test_equal_errors_rank_the_later_feature_first(spark):
    zero = [np.zeros(s) for s in autoencoder.shapes(20)]
    bundle = Bundle.from_arrays(zero, [np.zeros(s[0]) for s in autoencoder.shapes(20)], np.zeros(20), np.ones(20), 1.0)
    row = score_features(spark.createDataFrame([([1.0] * 20,)], "features array<double>"), bundle).first()
    assert row.drivers == ["ua_is_tool", "ua_len", "log_bytes"]
    assert (row.error, row.is_anomaly) == (1.0, False)


def test_a_filter_on_a_score_does_not_unfold_the_network(spark):
    scored = score_lines(lines_frame(spark, [CALM]), packaged()).filter("is_anomaly")
    assert len(scored._jdf.queryExecution().optimizedPlan().toString()) < 400_000


def test_both_scorers_agree(spark, trained):
    bundle, _ = trained
    df = add_features(parse_requests(lines_frame(spark, calm_lines(300) + [LOUD, DENSE, DEEP])))
    row = score_parity(df, bundle).first()
    assert row.n_rows == 303 and row.max_score_diff < 1e-4 and row.n_driver_mismatches == 0


def test_training_repeats_exactly(spark):
    df = add_features(parse_requests(lines_frame(spark, calm_lines(600)), keep=["line_no"])).persist()
    first = train_detector(df, "line_no", rounds=3)
    again = train_detector(df.repartition(5), "line_no", rounds=3)
    assert np.allclose(first[1], again[1], rtol=1e-9)
    assert np.allclose(first[0].weights[0], again[0].weights[0], rtol=1e-7)


def test_a_round_gets_blocks_of_rows(spark, monkeypatch):
    packed, cut = [], training.cut_lineage
    monkeypatch.setattr(training, "cut_lineage", lambda df: packed.append(cut(df)) or packed[-1])
    df = add_features(parse_requests(lines_frame(spark, calm_lines(600)), keep=["line_no"]))
    train_detector(df, "line_no", rounds=1)
    blocks = packed[-1].collect()
    assert sum(b.n for b in blocks) == 600 and len(blocks) <= 4
    assert all(len(b.block) == 8 * 20 * b.n for b in blocks)


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    flat, x = autoencoder.initial(20, 1), rng.normal(size=(8, 20))
    _, grad = autoencoder.gradient(flat, x)
    for i in rng.integers(0, len(flat), 25):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (autoencoder.gradient(up, x)[0] - autoencoder.gradient(down, x)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-6


def test_scaler_of_a_constant_feature_is_one(spark):
    df = add_features(parse_requests(lines_frame(spark, calm_lines(500)), keep=["line_no"])).repartition(7)
    rows = {r.feature: r for r in fit_scaler(df.withColumn("ua_len", F.lit(0.1))).collect()}
    assert rows["ua_len"].std == 1.0 and rows["path_len"].std > 0


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], [5.0] * 100, [1.0] * 60 + [2.0] * 40, [random.Random(2).expovariate(1) ** 5 for _ in range(999)],
    [0.0, 1e-300, 1e300, 3.0, 3.0, 4.0], [float(i % 7) for i in range(1000)],
])
def test_percentiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for pct in (0, 1, 50, 93.7, 99, 100):
        assert exact_percentile(df, "x", pct, buckets=16) == pytest.approx(np.percentile(values, pct), rel=1e-12)


def test_percentile_of_nothing_is_an_error(spark):
    with pytest.raises(ValueError):
        exact_percentile(spark.createDataFrame([], "x double"), "x", 50)


def test_summary_and_threshold_agree(spark, trained):
    bundle, _ = trained
    df = add_features(parse_requests(lines_frame(spark, calm_lines())))
    summary = error_summary(df, bundle)
    assert summary["percentile"] == pytest.approx(bundle.threshold) and summary["max"] >= summary["percentile"]


def test_bundle_round_trip(spark, trained, tmp_path):
    bundle, _ = trained
    save_bundle(spark, bundle, str(tmp_path / "model"))
    assert load_bundle(spark, str(tmp_path / "model")) == bundle
    broken = json.loads(json.dumps(bundle.to_dict()))
    broken["biases"][0].pop()
    with pytest.raises(ValueError):
        Bundle.from_dict(broken)
