from __future__ import annotations

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import adapters, contracts, raw, tables

UID = "7c6f1a9e-2b3d-4f5c-8a1e-9d6b4c2f0e7a"
MARKET = {
    "event_id": UID, "domain": "market", "entity_key": "SYM-1", "source": "feed", "seq": 1,
    "ts_event": "2026-01-01T00:00:00.123456Z", "corrupted": False,
    "payload": {"symbol": "SYM-1", "price": 100.5, "size": 2.0, "side": "buy", "bid": 100.0, "ask": 101.0,
                "exchange_latency_ms": 1.5},
}
PAYMENT = {
    "event_id": UID, "domain": "payments", "entity_key": "m1", "source": "feed", "seq": 2,
    "ts_event": "2026-01-01T00:00:01Z", "corrupted": True, "scenario_label": "data_corruption", "unknown_key": 1,
    "payload": {"txn_id": UID, "merchant_id": "m1", "account_id_hash": "h", "amount": -45.0, "currency": "USD",
                "channel": "wire", "country": "US", "processing_latency_ms": 9.0, "status": "approved"},
}


def lines(spark, *items):
    return spark.createDataFrame([(i if isinstance(i, str) else json.dumps(i),) for i in items], "line string")


def changed(event, **payload):
    return {**event, "payload": {**event["payload"], **payload}}


def test_frames_split_trim_and_skip_blanks(spark):
    df = spark.createDataFrame([(1, "a\n b \r\n\n \t\n c"), (2, "\n\n")], "id int, frame string")
    got = [(r["id"], r["line"]) for r in raw.split_frames(df, "frame").collect()]
    assert got == [(1, "a"), (1, "b"), (1, "c")]


def test_parse_keeps_good_and_reports_bad(spark):
    missing = {k: v for k, v in MARKET.items() if k != "seq"}
    no_flag = {k: v for k, v in MARKET.items() if k != "corrupted"}
    text = lines(
        spark, MARKET, PAYMENT, no_flag, "{not valid json", missing, {**MARKET, "domain": "other"},
        {**MARKET, "seq": -1}, changed(PAYMENT, status="pending"), {**MARKET, "event_id": "x"}, "[1]",
    )
    good, bad = raw.parse_raw(text)
    got = good.orderBy("seq").collect()
    assert [g["domain"] for g in got] == ["market", "market", "payments"]
    assert got[-1]["corrupted"] and got[-1]["payload"]["amount"] == -45.0 and not got[0]["corrupted"]
    assert got[0]["ts_event"] == datetime(2026, 1, 1, 0, 0, 0, 123456)
    assert bad.count() == 7
    assert raw.parse_raw(lines(spark, {**MARKET, "event_id": "x"}), strict_ids=False)[0].count() == 1


def test_flatten_and_back(spark):
    good, _ = raw.parse_raw(lines(spark, MARKET, PAYMENT))
    wide = raw.flatten_raw(good).orderBy("seq").collect()
    assert wide[0]["m_symbol"] == "SYM-1" and wide[0]["p_status"] == "" and wide[0]["p_amount"] is None
    assert wide[1]["p_status"] == "approved" and wide[1]["m_symbol"] == "" and wide[1]["p_txn_id"] == UID
    assert wide[0]["scenario_label"] == "" and wide[0]["ts_ingest"] == wide[0]["ts_event"]
    assert wide[0]["ingest_date"] == date(2026, 1, 1)
    back = raw.unflatten_raw(raw.flatten_raw(good)).orderBy("seq").collect()
    orig = good.orderBy("seq").collect()
    for a, b in zip(back, orig):
        assert a["payload"] == b["payload"] and a["scenario_label"] == b["scenario_label"]


def test_stamp_ingest_uses_the_given_clock(spark):
    good, _ = raw.parse_raw(lines(spark, MARKET))
    now = datetime(2026, 1, 2)
    assert raw.stamp_ingest(good, F.lit(now)).first()["ts_ingest"] == now
    assert raw.stamp_ingest(good).first()["ts_ingest"] is not None


def test_contract_violations_name_path_and_rule(spark):
    good, _ = raw.parse_raw(lines(spark, MARKET, PAYMENT))
    assert contracts.validate_contract(good, contracts.raw_event_contract(), ["event_id"]).count() == 0
    broken = good.withColumn(
        "payload", F.col("payload").withField("currency", F.lit("US")).withField("side", F.lit("hold"))
    ).withColumn("entity_key", F.lit("")).withColumn("source", F.lit(None).cast("string"))
    got = {(r["seq"], r["path"], r["rule"]) for r in contracts.validate_contract(
        broken, contracts.raw_event_contract(), ["seq"]).collect()}
    assert got == {
        (1, "entity_key", "minLength"), (2, "entity_key", "minLength"), (1, "source", "required"),
        (2, "source", "required"), (1, "payload.side", "enum"), (2, "payload.currency", "minLength"),
    }


def test_table_write_prunes_dates_and_retention(spark, tmp_path):
    base = datetime(2026, 1, 10)
    rows = [("market", f"e{i % 3}", base - timedelta(days=i)) for i in range(12)]
    df = spark.createDataFrame(rows, "domain string, entity_key string, ts_ingest timestamp")
    path = str(tmp_path / "raw")
    tables.write_table(df, path, "raw_events")
    tables.write_table(df, path, "raw_events")
    stored = spark.read.parquet(path)
    assert stored.count() == 24
    recent = tables.since(stored, "ts_ingest", timedelta(days=3), base)
    assert recent.count() == 6
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(ingest_date" in plan
    assert tables.retain(stored, 7, F.lit(base.date())).count() == 14


def test_kafka_records_are_keyed_json(spark):
    df = spark.createDataFrame([("e1", 5)], "entity_key string, seq int")
    row = tables.to_kafka_records(df).first()
    assert row["key"] == "e1" and json.loads(row["value"]) == {"entity_key": "e1", "seq": 5}


def test_read_events_rejects_unknown_kind(spark):
    with pytest.raises(ValueError):
        tables.read_events(spark, "socket")


def alert_frame(spark):
    schema = (
        "alert_id string, entity_key string, domain string, ts timestamp, window_end timestamp, anomaly_score double, "
        "severity string, action string, detectors struct<zscore:double,ewma:double,cusum:double,"
        "isolation_forest:double,autoencoder:double,xgboost:double>, explanation struct<probable_cause:string,"
        "top_features:array<struct<feature:string,value:double,baseline:double,contribution:double>>>, "
        "model_version string, drift_flag boolean, latency_ingest_to_alert_ms double"
    )
    ts = datetime(2026, 1, 1)
    top = [("zscore", 5.0, 0.0, 5.0)]
    rows = [(UID, "e1", "market", ts, ts, 0.9, "critical", "alert", (1.0, 1.0, 1.0, 0.5, 0.5, None),
             ("volatility_spike", top), "v1", False, 2000.0)]
    return spark.createDataFrame(rows, schema)


def test_alert_rows_round_trip_and_satisfy_the_contract(spark):
    nested = alert_frame(spark)
    stored = tables.to_alert_table(nested)
    row = stored.first()
    assert "xgboost" not in row["detectors"] and json.loads(row["top_features"])[0]["feature"] == "zscore"
    assert tables.from_alert_table(stored).first() == nested.first()
    assert contracts.validate_contract(nested, contracts.alert_contract(), ["alert_id"]).count() == 0
    bad = nested.withColumn("severity", F.lit("huge")).withColumn("anomaly_score", F.lit(1.5))
    got = {(r["path"], r["rule"]) for r in contracts.validate_contract(bad, contracts.alert_contract(), []).collect()}
    assert got == {("severity", "enum"), ("anomaly_score", "maximum")}


def test_adapter_order_key_follows_the_rows(spark):
    df = adapters.market_events(spark, "/root/testdata/sf0.001")
    assert df.select("entity_key", "ts_event", "seq", "event_id").distinct().count() == df.count()


def test_since_reads_the_session_zone_not_the_drivers(spark, monkeypatch):
    import time

    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    try:
        rows = spark.sql("SELECT TIMESTAMP '2024-01-01 10:00:00' AS t UNION ALL SELECT TIMESTAMP '2024-01-01 11:30:00'")
        assert tables.since(rows, "t", timedelta(hours=1), datetime(2024, 1, 1, 12)).count() == 1
        assert tables.since(rows, "t", timedelta(hours=3), datetime(2024, 1, 1, 12)).count() == 2
    finally:
        monkeypatch.undo()
        time.tzset()
