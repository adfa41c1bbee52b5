"""Streams against the batch chain over several micro-batches, with repeats, restarts and folders that do not grow."""

from __future__ import annotations

import json
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import at, events, series, tick, txn
from pulsegrid.functions.scratch import drop_batches
from pulsegrid.operators.ewma import ewma_zscore
from pulsegrid.operators.scoring import Tier, build_alerts
from pulsegrid.operators.sequence import velocity
from pulsegrid.operators.windows import FEATURE_COLUMNS
from pulsegrid.plans.pipeline import score_windows, statistical_scores
from pulsegrid.plans.training import train_supervised
from pulsegrid.operators.supervised import param_grid
from pulsegrid.sources import tables
from pulsegrid.streaming import alerts, batches, streams
from pulsegrid.streaming import events as stream_events
from test_streaming import SIZES, drain, feed, transactions

RULES = {"default": [Tier(0.5, "critical", "block"), Tier(0.3, "alert", "alert"), Tier(0.1, "watch", "watch")]}


def window_rows(spark, n=260, entities=3):
    """Feature rows of three entities whose windows close together, with calm and wild stretches."""
    rng = np.random.default_rng(21)
    frames = [series(spark, np.where(np.arange(n) % 97 < 4, 90.0, 10.0) + rng.normal(size=n), f"e{k}") for k in range(entities)]
    base = frames[0]
    for f in frames[1:]:
        base = base.unionByName(f)
    extra = {c: F.rand(3) for c in FEATURE_COLUMNS if c not in base.columns}
    typed = {"distinct_accounts": F.lit(3).cast("long")}
    return statistical_scores(ewma_zscore(velocity(base.drop("zscore").withColumns(extra | typed))))


@pytest.fixture(scope="module")
def stated(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stated") / "table")
    window_rows(spark).write.parquet(path)
    return spark.read.parquet(path)


def stretches(df, n):
    """The table cut at n - 1 window ends."""
    ends = [r[0] for r in df.select("window_end").distinct().orderBy("window_end").collect()]
    cuts = [ends[len(ends) * i // n] for i in range(n)] + [None]
    return [df.where((F.col("window_end") >= F.lit(a)) & (F.lit(True) if b is None else F.col("window_end") < F.lit(b)))
            for a, b in zip(cuts, cuts[1:])]


def told(df):
    rows = df.select("alert_id", "severity", "anomaly_score", "detectors", "explanation", "drift_flag").collect()
    return {r["alert_id"]: r for r in rows}


def run(stream, tmp_path, **options):
    query = alerts.stream_alerts(stream, f"{tmp_path}/out", f"{tmp_path}/check", F.col("window_end"), rules=RULES, available_now=True, **options)
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{tmp_path}/out")


def test_stream_with_models_equals_batch_over_batches_and_a_restart(spark, stated, tmp_path):
    parts = stretches(stated, 5)
    supervised = train_supervised(
        stated.select("domain", "entity_key", "window_end", F.array(*[F.col(c).cast("double") for c in (
            "zscore", "mean_amount", "decline_rate", "distinct_accounts", "throughput_eps", "latency_p99_ms", "error_rate", "velocity_count")]).alias("vector"),
            (F.col("primary_metric") > 50).cast("int").alias("label")),
        ["payments"], grid=param_grid((2,), (0.2,), (1,)), rounds=5)
    assert supervised["payments"].model is not None
    run(feed(spark, str(tmp_path / "in"), parts[:3]), tmp_path, supervised=supervised)
    got = run(feed_more(spark, str(tmp_path / "in"), parts[3:], 3), tmp_path, supervised=supervised)
    want = build_alerts(score_windows(stated, RULES, supervised=supervised), F.col("window_end"), "v1")
    a, b = told(got), told(want)
    assert a.keys() == b.keys() and len(a) > 100
    for k in a:
        assert a[k]["severity"] == b[k]["severity"] and a[k]["explanation"] == b[k]["explanation"]
        for name in ("isolation_forest", "autoencoder", "xgboost"):
            assert a[k]["detectors"][name] == pytest.approx(b[k]["detectors"][name], abs=1e-12)
    assert {r["severity"] for r in a.values()} >= {"alert", "critical"}
    assert sum(r["detectors"]["isolation_forest"] > 0 for r in a.values()) > 50
    ring = spark.read.parquet(f"{tmp_path}/check-ring")
    assert ring.where("batch = 4").count() == alerts.RING and ring.select("batch").distinct().count() == batches.KEEP


def feed_more(spark, path, frames, first):
    for i, df in enumerate(frames, first):
        df.coalesce(1).write.mode("append").parquet(f"{path}/part={i:03d}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def test_a_check_flags_later_alerts_of_the_stream(spark, stated, tmp_path):
    parts = stretches(stated, 4)
    paths = {"checks_path": f"{tmp_path}/checks", "baseline_path": f"{tmp_path}/base"}
    assert alerts.check_drift(spark, f"{tmp_path}/check", paths["baseline_path"], paths["checks_path"], F.current_timestamp()).count() == 0
    run(feed(spark, str(tmp_path / "in"), parts[:2]), tmp_path, **paths)
    assert spark.read.parquet(paths["baseline_path"]).count() == 60
    cut = parts[2].agg(F.min("window_end")).first()[0]
    checked = alerts.check_drift(spark, f"{tmp_path}/check", paths["baseline_path"], paths["checks_path"], F.lit(cut)).collect()
    assert [r["drift_detected"] for r in checked] == [True]
    out = run(feed_more(spark, str(tmp_path / "in"), parts[2:], 2), tmp_path, **paths)
    flags = {bool(r["window_end"] >= cut): r["drift_flag"] for r in out.select("window_end", "drift_flag").collect()}
    assert flags == {False: False, True: True}


def test_a_repeated_batch_starts_from_the_same_ring(spark, stated, tmp_path):
    """The ring of the batch before is used again, whatever the first try left behind."""
    parts = stretches(stated, 3)
    vectors = [p.select("domain", "entity_key", "window_end", F.array(*[F.col("zscore")] * 8).alias("vector")) for p in parts]
    check = f"{tmp_path}/check"
    lines = []
    for batch_id, v in ((0, vectors[0]), (1, vectors[1]), (1, vectors[1]), (2, vectors[2])):
        line = alerts._numbered_with_ring(v, check, batch_id)
        alerts._write_ring(line, check, batch_id)
        lines.append(sorted(r["vector_no"] for r in line.where("is_new").select("vector_no").collect()))
    n = [p.count() for p in parts]
    assert lines[1] == lines[2] == list(range(n[0] + 1, n[0] + n[1] + 1)) and lines[3][-1] == sum(n)


def test_silent_entities_lose_their_state(spark, tmp_path):
    """After more than the limit an entity starts anew; one that stays within it goes on."""
    def frame(rows):
        return events(spark, rows)

    frames = [frame([tick("a", 1, 0, 10.0), tick("b", 2, 0, 20.0)]), frame([tick("b", 3, 90, 21.0)]),
              frame([tick("b", 4, 150, 22.0)]), frame([tick("c", 5, 151, 1.0)]), frame([tick("a", 6, 160, 11.0), tick("b", 7, 160, 23.0)])]
    query, got = drain(streams.add_prev_price(feed(spark, str(tmp_path / "in"), frames), idle_seconds=100.0), str(tmp_path))
    assert {r["seq"]: r["previous_price"] for r in got.collect()} == {1: None, 2: None, 3: 20.0, 4: 21.0, 5: None, 6: None, 7: 22.0}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    streams.stream_prev_price(
        feed(spark, str(tmp_path / "in2"), frames), f"{tmp_path}/sliced", f"{tmp_path}/check2", available_now=True, idle_seconds=100.0
    ).awaitTermination()
    again = spark.read.parquet(f"{tmp_path}/sliced")
    assert {r["seq"]: r["previous_price"] for r in again.collect()} == {1: None, 2: None, 3: 20.0, 4: 21.0, 5: None, 6: None, 7: 22.0}
    few = [series(spark, [5.0] * 4, "x"), series(spark, [5.0] * 60, "y"), series(spark, [6.0], "y").withColumn("window_end", F.lit(at(305)))]
    query, got = drain(streams.stream_state(feed(spark, str(tmp_path / "w"), [
        f.drop("zscore") for f in few]), idle_seconds=60.0), str(tmp_path), "state")
    assert got.count() == 65 and query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_state_over_batches_and_a_restart_equals_batch(spark, stated, tmp_path):
    slim = stated.drop(*streams.STATE_COLUMNS)
    parts = stretches(slim, 4)
    drain(streams.stream_state(feed(spark, str(tmp_path / "in"), parts[:2])), str(tmp_path), "s")
    _, got = drain(streams.stream_state(feed_more(spark, str(tmp_path / "in"), parts[2:], 2)), str(tmp_path), "s")
    a, b = (df.orderBy("entity_key", "window_end").toPandas() for df in (got, stated))
    assert len(a) == len(b)
    for c in streams.STATE_COLUMNS:
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), atol=1e-9, err_msg=c)


def test_repeated_alerts_change_no_rollup(spark, tmp_path):
    schema = "alert_id string, domain string, severity string, ts timestamp, anomaly_score double, latency_ingest_to_alert_ms double"
    rows = [(f"a{i}", "market", "watch", at(i * 40), 0.5, 10.0) for i in range(40)]
    frames = [spark.createDataFrame(rows[:20] + rows[:5], schema), spark.createDataFrame(rows[18:] + rows[30:], schema)]
    for once, most in ((None, 8), ((), 16)):
        stream = alerts.stream_rollup(feed(spark, str(tmp_path / f"in{most}"), frames), "alerts_5m", "60 seconds", once)
        _, got = drain(stream, str(tmp_path), f"r{most}")
        counts = {r["bucket"]: r["alert_count"] for r in got.collect()}
        assert max(counts.values()) == most, counts


def test_upsert_rewrites_touched_dates_only(spark, tmp_path):
    schema = "alert_id string, domain string, entity_key string, window_end timestamp, ts timestamp, v int"
    path = str(tmp_path / "alerts")
    first = [("a", "market", "e", at(0), at(1), 1), ("b", "market", "e", at(86_400), at(86_401), 1)]
    assert alerts.upsert_alerts(spark.createDataFrame(first, schema), path) == [date(2026, 1, 1), date(2026, 1, 2)]
    old = {p.name for p in (tmp_path / "alerts" / "alert_date=2026-01-01").iterdir()}
    second = spark.createDataFrame([("b", "market", "e", at(86_400), at(86_409), 2), ("c", "market", "e", at(86_400), at(86_405), 1)], schema)
    for _ in range(2):  # again: no change
        assert alerts.upsert_alerts(second, path) == [date(2026, 1, 2)]
        assert {r["alert_id"]: r["v"] for r in spark.read.parquet(path).collect()} == {"a": 1, "b": 2, "c": 1}
    assert {p.name for p in (tmp_path / "alerts" / "alert_date=2026-01-01").iterdir()} == old
    assert alerts.upsert_alerts(second.where("false"), path) == []


def test_bad_lines_are_kept_with_their_reason(spark, tmp_path):
    uid = "7c6f1a9e-2b3d-4f5c-8a1e-9d6b4c2f0e7a"
    good = {"event_id": uid, "domain": "market", "entity_key": "s", "source": "f", "seq": 1, "ts_event": "2026-01-01T00:00:00Z",
            "payload": {"symbol": "s", "price": 1.0, "size": 1.0, "side": "buy", "bid": 1.0, "ask": 1.0, "exchange_latency_ms": 1.0}}
    bad = ["{broken", json.dumps(good | {"domain": "weather"}), json.dumps(good | {"seq": None}), "", "[1]", json.dumps(good | {"event_id": "x"})]
    frames = [spark.createDataFrame([(x,) for x in lines], "value string") for lines in ([json.dumps(good), *bad[:3]], [*bad[3:], json.dumps(good)])]
    for _ in range(2):  # the second run has nothing new to read
        stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(
            str(tmp_path / "in")) if _ else feed(spark, str(tmp_path / "in"), frames)
        stream_events.stream_events(stream, f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/check", available_now=True).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2
    kept = spark.read.parquet(f"{tmp_path}/bad")
    assert sorted(r["line"] for r in kept.collect()) == sorted(bad)
    assert {r["reason"]: r["lines"] for r in stream_events.bad_counts(kept).collect()} == {"not_json": 2, "no_domain": 2, "incomplete": 2}


def test_late_events_are_kept_per_window(spark, tmp_path):
    frames = [events(spark, [txn("m", 1, 1, 1.0), txn("m", 2, 100, 1.0)]), events(spark, [txn("m", 3, 2, 1.0), txn("m", 4, 3, 1.0), txn("m", 5, 101, 1.0)]),
              events(spark, [txn("m", 6, 97, 1.0), txn("m", 7, 20, 1.0)])]
    stream_events.split_late(feed(spark, str(tmp_path / "in"), frames), SIZES, f"{tmp_path}/ok", f"{tmp_path}/late", f"{tmp_path}/check",
                             delay_seconds=5.0, available_now=True).awaitTermination()
    late = spark.read.parquet(f"{tmp_path}/late")
    assert {r["window_start"]: r["late_events"] for r in stream_events.late_counts(late).collect()} == {at(0): 2, at(20): 1}
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/ok").collect()) == [1, 2, 5, 6]


def test_folders_beside_checkpoints_do_not_grow(spark, tmp_path):
    rows = transactions(400)
    frames = [events(spark, rows[i:i + 20]) for i in range(0, 400, 20)]
    seen = batches.observed(feed(spark, str(tmp_path / "in"), frames), "seen")
    query = streams.stream_windows(seen, "payments", 5.0, f"{tmp_path}/out", f"{tmp_path}/check", "1 second", available_now=True)
    query.awaitTermination()
    assert batches.observed_counts(query, "seen")["rows"] == 400
    sizes = {p.name: len(list(p.glob("batch=*"))) for p in tmp_path.iterdir() if p.name.startswith("check-")}
    assert set(sizes) == {"check-cells", "check-done", "check-counts"} and max(sizes.values()) <= batches.KEEP


def test_counts_that_cannot_be_added_are_an_error(spark, tmp_path):
    named = feed(spark, str(tmp_path / "in"), [events(spark, transactions(5))]).observe("odd", F.first("entity_key").alias("text"))
    query, _ = drain(named, str(tmp_path))
    with pytest.raises(RuntimeError, match="incomplete"):
        batches.batch_counts(query)


def test_streamed_table_is_pruned_by_date(spark, tmp_path):
    df = spark.createDataFrame([(i, at(i * 43_200), date(2026, 1, 1 + i // 2)) for i in range(10)], "v int, ts timestamp, ingest_date date")
    query = batches.write_stream(feed(spark, str(tmp_path / "in"), [df]), f"{tmp_path}/out", f"{tmp_path}/check", True, ["ingest_date"])
    query.awaitTermination()
    recent = spark.read.parquet(f"{tmp_path}/out").where(F.col("ingest_date") >= F.lit(date(2026, 1, 4)))
    assert recent.count() == 4
    assert "PartitionFilters: [isnotnull(ingest_date" in recent._jdf.queryExecution().executedPlan().toString()


def test_old_dates_go_and_small_files_are_joined(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("e", at(i * 86_400), i) for i in range(5)], "entity_key string, window_end timestamp, v int")
    for _ in range(3):
        tables.write_table(df, path, "features")
    assert tables.expire(spark, path, 2, date(2026, 1, 4)) == [date(2026, 1, 1), date(2026, 1, 2)]
    assert tables.compact(spark, path, "features", date(2026, 1, 5)) == [date(2026, 1, 3), date(2026, 1, 4)]
    files = {p.name: len(list(p.glob("part-*"))) for p in (tmp_path / "t").glob("ingest_date=*")}
    assert files == {"ingest_date=2026-01-03": 1, "ingest_date=2026-01-04": 1, "ingest_date=2026-01-05": 3}
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [2] * 3 + [3] * 3 + [4] * 3
    assert tables.compact(spark, path, "features", date(2026, 1, 5)) == [] and drop_batches(spark, f"{path}/none", 3) == 0
