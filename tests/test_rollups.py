from __future__ import annotations

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import at
from pulsegrid.operators import rollups as R

ALERTS = (
    "alert_id string, entity_key string, domain string, ts timestamp, window_end timestamp, anomaly_score double, "
    "severity string, action string, detectors map<string,double>, probable_cause string, top_features string, "
    "model_version string, drift_flag boolean, latency_ingest_to_alert_ms double"
)
NOW = at(7200)


@pytest.fixture(scope="module")
def alerts(spark):
    rng = np.random.default_rng(13)
    rows = []
    for i in range(300):
        severity = ("watch", "alert", "critical")[int(rng.integers(3))]
        rows.append((
            f"id{i:04d}", f"e{rng.integers(4)}", ("market", "payments")[int(rng.random() < 0.7)],
            at(int(rng.integers(0, 7200))), at(0), float(rng.random()), severity, "watch", {"zscore": 0.5},
            ("volume_spike", "unknown")[i % 2], "[]", "v1", False, float(rng.integers(1, 5000))))
    return spark.createDataFrame(rows, ALERTS)


def test_five_minute_rollup_adds_up(alerts):
    got, pdf = R.alerts_5m(alerts).toPandas(), alerts.toPandas()
    assert got["alert_count"].sum() == 300
    assert got["sum_latency_ms"].sum() == pytest.approx(pdf["latency_ingest_to_alert_ms"].sum())
    want = pdf.groupby([pdf["ts"].dt.floor("5min"), "domain", "severity"]).size()
    assert len(got) == len(want)
    for _, r in got.iterrows():
        assert want[r["bucket"], r["domain"], r["severity"]] == r["alert_count"]


def test_partials_merge_to_the_whole(alerts):
    keys = ["bucket", "domain", "severity"]
    parts = R.alerts_5m(alerts.where("entity_key < 'e2'")).unionByName(R.alerts_5m(alerts.where("entity_key >= 'e2'")))
    a = R.merge_rollup(parts, keys).toPandas().sort_values(keys, ignore_index=True)
    b = R.alerts_5m(alerts).toPandas().sort_values(keys, ignore_index=True)
    assert list(a["alert_count"]) == list(b["alert_count"])
    np.testing.assert_allclose(a["sum_anomaly_score"], b["sum_anomaly_score"])


def test_search_filters_sorts_and_limits(alerts):
    got = R.search_alerts(alerts, NOW, domain="payments", severity="watch", entity_key="e1", since_minutes=100, limit=5)
    pdf = alerts.toPandas()
    keep = pdf[(pdf.domain == "payments") & (pdf.severity == "watch") & (pdf.entity_key == "e1")
               & (pdf.ts > NOW - timedelta(minutes=100))]
    want = keep.sort_values(["ts", "alert_id"], ascending=[False, True])["alert_id"].head(5)
    assert [r["alert_id"] for r in got.collect()] == list(want)
    assert "TakeOrderedAndProject" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("bad", [{"domain": "fx"}, {"severity": "low"}, {"since_minutes": 0}, {"since_minutes": 10_081},
                                 {"limit": 0}, {"limit": 1001}])
def test_search_rejects_bad_filters(alerts, bad):
    with pytest.raises(ValueError):
        R.search_alerts(alerts, NOW, **bad)


def test_series_bounds(alerts):
    with pytest.raises(ValueError):
        R.rollup_series(R.alerts_5m(alerts), NOW, since_hours=169)
    with pytest.raises(ValueError):
        R.throughput_series(alerts, NOW, since_minutes=1441)
    with pytest.raises(ValueError):
        R.metrics_history(alerts, "m", NOW, since_hours=721)


def test_series_merges_partials_before_averaging(alerts):
    twice = R.alerts_5m(alerts).unionByName(R.alerts_5m(alerts))
    got = R.rollup_series(twice, NOW, since_hours=3).toPandas()
    assert got["alert_count"].sum() == 600 and got["bucket"].is_monotonic_increasing
    assert not got.duplicated(["bucket", "domain", "severity"]).any()
    assert got["avg_anomaly_score"].between(0, 1).all()


def test_causes(alerts):
    rollup = R.causes_1h(alerts)
    got = R.cause_breakdown(rollup, NOW, since_hours=1).toPandas()
    assert got["alert_count"].is_monotonic_decreasing
    assert R.causes_total(rollup).toPandas().set_index("probable_cause")["alert_count"].to_dict() == {
        "volume_spike": 150, "unknown": 150}


def test_pivots_fill_zeros(spark, alerts):
    wide = R.pivot_severity(R.alerts_5m(alerts.where("severity <> 'alert'"))).toPandas()
    assert (wide["alert"] == 0).all() and (wide["watch"] + wide["critical"] == wide["total"]).all()
    rollup = spark.createDataFrame([(at(0), "market", "a", 3), (at(0), "market", "b", 4), (at(60), "payments", "c", 5)],
                                   "bucket timestamp, domain string, entity_key string, events long")
    got = [(r["market"], r["payments"]) for r in R.pivot_domain(rollup).collect()]
    assert got == [(7, 0), (0, 5)]


def metrics(spark):
    rows = [("m1", at(i), bool(i % 2), i, float(i), 1.0, 2.0) for i in range(5)] + [("m2", at(9), False, 9, 0.5, 1.0, 2.0)]
    return spark.createDataFrame(rows, "model_id string, ts timestamp, drift_detected boolean, events_scored long, "
                                       "throughput_eps double, p50_inference_ms double, p99_inference_ms double")


def test_latest_and_history(spark):
    m = metrics(spark)
    assert {r["model_id"]: r["events_scored"] for r in R.latest_metrics(m).collect()} == {"m1": 4, "m2": 9}
    assert [r["events_scored"] for r in R.metrics_history(m, "m1", at(3600 + 2), since_hours=1).collect()] == [3, 4]


def test_kpis(spark, alerts):
    row = R.kpis(R.rollup_series(R.alerts_5m(alerts), NOW, 3), R.latest_metrics(metrics(spark))).first()
    pdf = alerts.toPandas()
    assert row["total"] == 300 and row["critical"] == (pdf.severity == "critical").sum()
    assert row["avg_latency_ms"] == pytest.approx(pdf["latency_ingest_to_alert_ms"].mean())
    assert row["throughput_eps"] == 4.5 and row["any_drift"] is False
    empty = R.kpis(R.rollup_series(R.alerts_5m(alerts.where("false")), NOW, 3), metrics(spark).where("false")).first()
    assert tuple(empty) == (0, 0, 0.0, 0.0, False)


def test_backlog_is_newest_in_time_order(alerts):
    got = [r["alert_id"] for r in R.backlog(alerts, 30).collect()]
    want = alerts.toPandas().sort_values(["ts", "alert_id"], ascending=[False, True])["alert_id"].head(30)
    assert got == list(want)[::-1]


def test_histogram_and_quantile(spark):
    values = [0.5] * 10 + [3.0] * 30 + [7.0] * 50 + [5000.0] * 10
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    cumulative = R.histogram(df, "v", ["k"])
    got = {r["le"]: r["cumulative"] for r in cumulative.collect()}
    assert (got[1.0], got[2.0], got[5.0], got[10.0], got[1000.0], got[float("inf")]) == (10, 10, 40, 90, 90, 100)
    assert R.histogram_quantile(cumulative, 0.5, ["k"]).first()["quantile"] == pytest.approx(5 + 5 * 10 / 50)
    assert R.histogram_quantile(cumulative, 0.99, ["k"]).first()["quantile"] == 1000.0
    assert R.histogram_quantile(R.histogram(df, "v"), 0.2).first()["quantile"] == pytest.approx(2 + 3 * 10 / 30)


def test_latency_quantiles_and_rates(spark, alerts):
    row = R.latency_quantiles(alerts, NOW, 3600).first()
    pdf = alerts.toPandas()
    recent = pdf[pdf.ts > NOW - timedelta(seconds=3600)]["latency_ingest_to_alert_ms"]
    assert row["n"] == len(recent) and row["p95"] == pytest.approx(np.quantile(recent, 0.95))
    rates = R.event_rate(alerts, "ts", ["domain"], NOW, 3600).toPandas()
    assert rates["per_second"].sum() == pytest.approx(len(recent) / 3600)
    raw = alerts.withColumn("ts_ingest", F.col("ts"))
    stages = R.stage_throughput(raw, alerts, alerts, NOW, 3600).toPandas().set_index("stage")["per_second"]
    assert stages["alerts"] == stages["raw_events"] == pytest.approx(len(recent) / 3600) and stages["features"] == 0


def test_entities_are_sorted(alerts):
    got = [tuple(r) for r in R.entities(alerts).collect()]
    assert got == sorted(set(got)) and len(got) == 8


def test_minute_throughput(spark):
    f = spark.createDataFrame([("market", "a", at(30), 3), ("market", "a", at(59), 4), ("market", "a", at(60), 5)],
                              "domain string, entity_key string, window_end timestamp, count long")
    rollup = R.throughput_1m(f)
    assert sorted(r["events"] for r in rollup.collect()) == [5, 7]
    assert [r["events"] for r in R.throughput_series(rollup, at(90), since_minutes=1).collect()] == [5]
