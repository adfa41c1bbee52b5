from __future__ import annotations

import itertools
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import at
from pulsegrid.operators.drift import (
    baseline_vectors, drift_check, drift_features, exact_ks_pvalue, freeze_baseline, ks_pvalue_limit, ks_two_sample,
    live_vectors, model_metrics, psi,
)
from pulsegrid.operators.sequence import FEATURES


def long_frame(spark, columns: dict, domain="market"):
    rows = [(domain, name, float(v)) for name, values in columns.items() for v in values]
    return spark.createDataFrame(rows, "domain string, feature string, value double")


def vector_frame(spark, x, domain="market"):
    rows = [(domain, "e", at(i), [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "domain string, entity_key string, window_end timestamp, vector array<double>")


def psi_loop(base, live, bins=10):
    edges = np.unique(np.percentile(base, np.linspace(0, 100, bins + 1)))
    if len(edges) < 3:
        return 0.0
    b, l = np.histogram(base, edges)[0], np.histogram(live, edges)[0]
    b, l = b / max(b.sum(), 1) + 1e-6, l / max(l.sum(), 1) + 1e-6
    return float(np.sum((l - b) * np.log(l / b)))


def ks_loop(a, b):
    grid = np.unique(np.concatenate([a, b]))
    return max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(8)
    base = {
        "zscore": rng.normal(size=200), "realized_vol": rng.integers(0, 6, 200).astype(float),
        "spread_bps": np.full(200, 3.0), "order_imbalance": rng.exponential(size=200), "error_rate": rng.normal(size=200),
    }
    live = {
        "zscore": rng.normal(0.3, 1.4, 317), "realized_vol": rng.integers(2, 9, 317).astype(float),
        "spread_bps": np.full(317, 4.0), "order_imbalance": rng.exponential(2.0, 317),
        "error_rate": rng.normal(50, 1, 317),
    }
    return base, live


def test_psi_and_ks_match_brute_force(spark, samples):
    base, live = samples
    b, l = long_frame(spark, base), long_frame(spark, live)
    index = {r["feature"]: r["psi"] for r in psi(b, l).collect()}
    stats = {r["feature"]: r for r in ks_two_sample(b, l).collect()}
    assert set(index) == set(stats) == set(base)
    for name in base:
        assert index[name] == pytest.approx(psi_loop(base[name], live[name]), abs=1e-9)
        assert stats[name]["ks_stat"] == pytest.approx(ks_loop(base[name], live[name]), abs=1e-12)
    assert index["spread_bps"] == 0.0


def test_exact_pvalue_counts_every_ordering():
    n, m = 4, 5
    for d in (0.2, 0.35, 0.5, 0.6, 0.8, 1.0):
        hits = total = 0
        for firsts in itertools.combinations(range(n + m), n):
            i = j = 0
            gap = 0.0
            for k in range(n + m):
                i, j = (i + 1, j) if k in firsts else (i, j + 1)
                gap = max(gap, abs(i / n - j / m))
            hits, total = hits + (gap >= d - 1e-9), total + 1
        # The chance of a gap at least as large as d, on the lattice of possible gaps.
        floor = np.floor(d * n * m - 1e-7) / (n * m)
        if abs(floor + 1 / (n * m) - d) < 1e-6 or abs(floor - d) < 1e-6:
            assert exact_ks_pvalue(d, n, m) == pytest.approx(hits / total, abs=1e-12)
    assert exact_ks_pvalue(0.0, 10, 10) == 1.0


def test_limit_and_exact_agree_for_large_samples(spark):
    df = spark.createDataFrame([(0.03, 4000, 5000), (0.02, 4000, 5000), (0.05, 4000, 5000)], "d double, n long, m long")
    got = df.withColumn("p", ks_pvalue_limit(F.col("d"), F.col("n"), F.col("m"))).collect()
    for r in got:
        assert r["p"] == pytest.approx(exact_ks_pvalue(r["d"], r["n"], r["m"]), abs=0.01)


def test_shift_is_drift_and_same_draw_is_not(spark):
    rng = np.random.default_rng(1)
    base = vector_frame(spark, rng.normal(size=(200, 8)))
    moved = drift_check(base, vector_frame(spark, rng.normal(10, 1, size=(200, 8)))).first()
    assert moved["drift_detected"] and all(v > 0.2 for v in moved["psi_by_feature"].values())
    assert set(moved["psi_by_feature"]) == set(FEATURES["market"])
    same = np.random.default_rng(2).normal(size=(400, 8))
    row = drift_check(vector_frame(spark, same[:200]), vector_frame(spark, same[:200])).first()
    assert not row["drift_detected"] and max(row["ks_stat_by_feature"].values()) == 0.0


def test_too_few_rows_or_no_baseline_report_zeros(spark):
    rng = np.random.default_rng(3)
    base, few = vector_frame(spark, rng.normal(size=(100, 8))), vector_frame(spark, rng.normal(9, 1, size=(9, 8)))
    row = drift_check(base, few).first()
    assert not row["drift_detected"] and set(row["psi_by_feature"].values()) == {0.0}
    other = vector_frame(spark, rng.normal(size=(50, 8)), "payments")
    got = drift_features(base, other).toPandas()
    # The domain without a baseline and the silent one.
    assert len(got) == 16 and (got["psi"] == 0).all() and (got["ks_stat"] == 0).all()


def test_baseline_and_live_are_the_ends_of_each_domain(spark):
    df = vector_frame(spark, np.arange(40).repeat(8).reshape(40, 8)).unionByName(
        vector_frame(spark, np.arange(5).repeat(8).reshape(5, 8), "payments"))
    first = baseline_vectors(df, 10).toPandas()
    last = live_vectors(df, 10).toPandas()
    assert sorted(v[0] for v in first[first.domain == "market"].vector) == list(range(10))
    assert sorted(v[0] for v in last[last.domain == "market"].vector) == list(range(30, 40))
    assert (first.domain == "payments").sum() == 5


def test_a_saved_baseline_never_moves(spark, tmp_path):
    path = str(tmp_path / "baseline")
    x = np.random.default_rng(4).normal(size=(60, 8))
    assert freeze_baseline(vector_frame(spark, x[:30]), path).count() == 0  # buffer not full yet
    assert freeze_baseline(vector_frame(spark, x), path).count() == 60
    later = vector_frame(spark, x + 100).unionByName(vector_frame(spark, x, "payments"))
    got = freeze_baseline(later, path).toPandas()
    assert got.groupby("domain").size().to_dict() == {"market": 60, "payments": 60}
    assert np.vstack(got[got.domain == "market"].vector.to_list()).max() < 50


def test_metrics_event(spark):
    x = np.random.default_rng(5).normal(size=(100, 8))
    base = vector_frame(spark, x)
    times = list(range(1, 101))
    scored = spark.createDataFrame([("market", float(t)) for t in times], "domain string, inference_ms double")
    row = model_metrics(scored, drift_check(base, base), 50.0, F.lit(at(0))).first()
    assert (row["model_id"], row["events_scored"], row["throughput_eps"]) == ("ensemble-market", 100, 2.0)
    assert (row["p50_inference_ms"], row["p99_inference_ms"]) == (51.0, 100.0)
    assert row["precision"] is None and not row["drift_detected"]


def test_constant_feature_reports_zero(spark):
    rows = [("payments", "error_rate", 0.0)] * 20
    frame = spark.createDataFrame(rows, "domain string, feature string, value double")
    assert [r["psi"] for r in psi(frame, frame).collect()] == [0.0]
    with pytest.raises(ValueError):
        ks_two_sample(frame, frame, method="other")


def test_a_silent_domain_reports_zeros(spark):
    rng = np.random.default_rng(1)
    schema = "domain string, entity_key string, window_end timestamp, vector array<double>"
    rows = [(d, "e", at(i), rng.normal(size=8).tolist()) for d in ("market", "payments") for i in range(60)]
    base = spark.createDataFrame(rows, schema)
    live = base.where("domain = 'market'")
    got = {r["domain"]: r for r in drift_check(base, live).collect()}
    assert set(got) == {"market", "payments"} and not got["payments"]["drift_detected"]
    assert set(got["payments"]["psi_by_feature"].values()) == {0.0} and len(got["payments"]["psi_by_feature"]) == 8
    scored = live.withColumn("inference_ms", F.lit(2.0))
    rows = {r["model_id"]: r for r in model_metrics(scored, drift_check(base, live), 60.0, F.current_timestamp()).collect()}
    assert rows["ensemble-payments"]["events_scored"] == 0 and rows["ensemble-payments"]["throughput_eps"] == 0.0
    assert rows["ensemble-market"]["events_scored"] == 60


def test_two_runs_freeze_one_baseline(spark, tmp_path):
    schema = "domain string, entity_key string, window_end timestamp, vector array<double>"
    frames = [spark.createDataFrame([("market", "e", at(i), [float(v)] * 8) for i in range(60)], schema) for v in (1, 2)]
    path = str(tmp_path / "baseline")
    with ThreadPoolExecutor(2) as pool:
        got = list(pool.map(lambda df: freeze_baseline(df, path).count(), frames))
    stored = spark.read.parquet(path)
    assert got == [60, 60] and stored.count() == 60 and stored.select("vector").distinct().count() == 1
