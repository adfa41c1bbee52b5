from __future__ import annotations

import uuid
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import FEATURE_SCHEMA, at
from pulsegrid.functions.expr import rfc3339
from pulsegrid.operators.scoring import (
    ALERT_NAMESPACE, BASE_WEIGHTS, Tier, alert_id, apply_rules, drift_asof, drift_spans, ensemble, latest_alerts, probable_cause,
    rules_from_config, top_features,
)
from pulsegrid.operators.windows import FEATURE_COLUMNS
from pulsegrid.plans.pipeline import score_pipeline


def detectors(spark, *values, xgboost=None):
    names = list(BASE_WEIGHTS)
    schema = ", ".join(f"{n} double" for n in names) + ", xgboost double"
    return spark.createDataFrame([(*values, xgboost)], schema)


def test_ensemble_weights_and_bounds(spark):
    assert ensemble(detectors(spark, 1.0, 1.0, 1.0, 1.0, 1.0)).first()["anomaly_score"] == pytest.approx(1.0)
    assert ensemble(detectors(spark, 0.0, 0.0, 0.0, 0.0, 0.0)).first()["anomaly_score"] == 0.0
    base = ensemble(detectors(spark, 1.0, 0.5, 0.0, 0.2, 0.4)).first()["anomaly_score"]
    assert base == pytest.approx(0.15 + 0.1 + 0.04 + 0.1)
    blended = ensemble(detectors(spark, 1.0, 0.5, 0.0, 0.2, 0.4, xgboost=1.0)).first()["anomaly_score"]
    assert blended == pytest.approx(0.35 + 0.65 * base)
    assert ensemble(detectors(spark, 9.0, 9.0, 9.0, 9.0, 9.0)).first()["anomaly_score"] == 1.0


def test_rules_pick_the_first_tier(spark):
    rows = [("payments", 0.86), ("payments", 0.7), ("payments", 0.5), ("payments", 0.49), ("market", 0.95),
            ("market", 0.55), ("market", 0.5), ("other", 0.9), ("other", 0.75), ("other", 0.1)]
    got = apply_rules(spark.createDataFrame(rows, "domain string, anomaly_score double")).collect()
    assert [(r["severity"], r["action"]) for r in got] == [
        ("critical", "block"), ("alert", "alert"), ("watch", "watch"), (None, None), ("critical", "alert"),
        ("watch", "watch"), (None, None), ("critical", "block"), ("alert", "alert"), (None, None)]
    one = {"default": [Tier(0.1, "watch", "watch")]}
    assert apply_rules(spark.createDataFrame(rows, "domain string, anomaly_score double"), one).where(
        "severity = 'watch'").count() == 10


def test_rules_can_come_from_a_file(spark):
    config = {
        "default": {"thresholds": [{"min_score": 0.9, "severity": "critical", "action": "block"}]},
        "domains": {"market": {"thresholds": [{"min_score": 0.2, "severity": "watch", "action": "watch"}]}},
    }
    df = spark.createDataFrame([("market", 0.95), ("payments", 0.95), ("payments", 0.5)], "domain string, anomaly_score double")
    got = apply_rules(df, rules_from_config(config)).collect()
    assert [r["severity"] for r in got] == ["watch", "critical", None]


def explained(spark, vector, mean=None, std=None, shap=None, domain="market"):
    schema = ("domain string, vector array<double>, base_mean array<double>, base_std array<double>, "
              "shap array<double>")
    return spark.createDataFrame([(domain, vector, mean, std, shap)], schema)


def test_top_features(spark):
    zeros, ones = [0.0] * 8, [1.0] * 8
    top = top_features(explained(spark, [0.1, 5.0] + [0.1] * 6, zeros, ones)).first()["top_features"]
    assert [t["feature"] for t in top] == ["realized_vol", "zscore", "spread_bps"]  # ties by order
    top = top_features(explained(spark, [0.0, 0.0, 9.0] + [0.0] * 5), k=1).first()["top_features"]
    assert (top[0]["feature"], top[0]["baseline"], top[0]["contribution"]) == ("spread_bps", 0.0, 9.0)
    top = top_features(explained(spark, [3.0] + [0.0] * 7, zeros, zeros), k=1).first()["top_features"]
    assert top[0]["contribution"] == 3.0  # a constant feature counts with deviation 1
    shap = [0.0, -0.9] + [0.1] * 6
    top = top_features(explained(spark, [9.0] * 8, zeros, ones, shap), k=1).first()["top_features"]
    assert (top[0]["feature"], top[0]["contribution"]) == ("realized_vol", -0.9)


@pytest.mark.parametrize("domain,top,fields,cause", [
    ("payments", "zscore", {"decline_rate": 0.3, "distinct_accounts": 2, "mean_amount": 5.0}, "fraud_pattern"),
    ("payments", "error_rate", {"decline_rate": 0.3, "distinct_accounts": 0, "mean_amount": 5.0}, "data_corruption"),
    ("payments", "latency_p99_ms", {}, "latency_incident"),
    ("payments", "velocity_count", {}, "volume_spike"),
    ("payments", "zscore", {"cusum_score": 0.9, "zscore_score": 0.1}, "regime_change"),
    ("payments", "decline_rate", {}, "fraud_pattern"),
    ("payments", "distinct_accounts", {}, "unknown"),
    ("market", "throughput_eps", {}, "volume_spike"),
    ("market", "realized_vol", {"cusum_score": 0.9, "zscore_score": 0.95}, "volatility_spike"),
    ("market", "realized_vol", {"cusum_score": 0.9, "zscore_score": 0.1}, "regime_change"),
    ("market", None, {}, "unknown"),
])
def test_probable_cause(spark, domain, top, fields, cause):
    base = {"decline_rate": None, "distinct_accounts": None, "mean_amount": None, "cusum_score": 0.0,
            "zscore_score": 0.0, **fields}
    schema = ("domain string, top_features array<struct<feature:string>>, decline_rate double, "
              "distinct_accounts long, mean_amount double, cusum_score double, zscore_score double")
    row = (domain, [(top,)] if top else [], *base.values())
    assert probable_cause(spark.createDataFrame([row], schema)).first()["probable_cause"] == cause


def test_alert_id_is_a_name_based_uuid(spark):
    ends = [datetime(2024, 1, 1, 6), datetime(2024, 1, 1, 6, 0, 0, 120_000), datetime(2024, 1, 1, 6, 0, 0, 123_456)]
    df = spark.createDataFrame([("payments", f"mérch_{i}", e) for i, e in enumerate(ends)], "d string, e string, t timestamp")
    got = df.select("e", rfc3339(F.col("t")).alias("text"), alert_id(F.col("d"), F.col("e"), F.col("t")).alias("id")).collect()
    assert [r["text"] for r in got] == [
        "2024-01-01T06:00:00+00:00", "2024-01-01T06:00:00.120+00:00", "2024-01-01T06:00:00.123456+00:00"]
    for r in got:
        assert r["id"] == str(uuid.uuid5(uuid.UUID(ALERT_NAMESPACE), f"payments|{r['e']}|{r['text']}"))


def test_latest_alert_wins(spark):
    rows = [("market", "e", at(0), "a", at(i), i) for i in range(5)] + [("market", "e", at(0), "b", at(9), 9)]
    df = spark.createDataFrame(rows, "domain string, entity_key string, window_end timestamp, alert_id string, ts timestamp, v int")
    got = latest_alerts(df)
    assert sorted((r["alert_id"], r["v"]) for r in got.collect()) == [("a", 4), ("b", 9)]
    assert "row_number(), 1, Partial" in got._jdf.queryExecution().executedPlan().toString()


def test_drift_flag_is_the_latest_check(spark):
    rng = np.random.default_rng(7)
    checks = [(d, at(int(t)), bool(rng.random() < 0.5)) for d in ("market", "payments")
              for t in rng.choice(50_000, 30, replace=False)]
    alerts = [("market" if rng.random() < 0.9 else "payments", f"a{i}", at(int(rng.integers(0, 60_000))), True)
              for i in range(400)]
    alerts.append(("market", "same", checks[0][1], True))
    a = spark.createDataFrame(alerts, "domain string, alert_id string, ts timestamp, drift_flag boolean")
    c = spark.createDataFrame(checks, "domain string, ts timestamp, drift_detected boolean")
    got = {r["alert_id"]: r["drift_flag"] for r in drift_asof(a, c).collect()}
    assert len(got) == 401
    for domain, name, ts, _ in alerts:
        past = [(t, f) for d, t, f in checks if d == domain and t <= ts]
        assert got[name] == (max(past)[1] if past else False)


def test_spans_of_drift_join_checks(spark):
    flags = [(0, False), (10, True), (20, True), (30, False), (30, True), (40, False), (50, True)]
    c = spark.createDataFrame([("market", at(t), f) for t, f in flags] + [("payments", at(5), False)],
                              "domain string, ts timestamp, drift_detected boolean")
    got = sorted(map(tuple, drift_spans(c).collect()), key=lambda r: r[1])
    assert got == [("market", at(10), at(40)), ("market", at(50), None)]


def test_scored_chain_is_planned_once_with_drift_checks(spark):
    """Alerts are joined with spans, not sorted: one fit, one scan of the features."""
    rng = np.random.default_rng(6)
    rows = [("payments", "e", at(i * 5), at(i * 5 + 5), 5.0, 1, float(rng.normal()), 0.0) for i in range(80)]
    base = spark.createDataFrame(rows, FEATURE_SCHEMA)
    missing = [c for c in FEATURE_COLUMNS if c not in base.columns]
    features = base.withColumns({c: F.lit(0.0) for c in [*missing, "ewma_mean", "ewma_var", "velocity_count"]})
    checks = spark.createDataFrame([("payments", at(0), True)], "domain string, ts timestamp, drift_detected boolean")
    rules = {"default": [Tier(0.0, "watch", "watch")]}
    plans = {}
    for name, c in (("without", None), ("with", checks)):
        got = score_pipeline(features, F.col("window_end"), rules=rules, drift_checks=c)
        plans[name] = got._jdf.queryExecution().optimizedPlan().toString()
    assert plans["with"].count("FlatMapGroupsInPandas") == plans["without"].count("FlatMapGroupsInPandas") == 1
    # Lag and lead over the checks, once for closed and once for open spans; none over alerts.
    assert plans["with"].count("Window ") == plans["without"].count("Window ") + 4
    assert got.count() == 80 and got.where("drift_flag").count() == 80
