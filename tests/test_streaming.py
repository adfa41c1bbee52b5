from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from builders import at, events, rows_by, tick, txn
from pulsegrid.operators.ewma import ewma_zscore
from pulsegrid.operators.sequence import velocity
from pulsegrid.operators.windows import window_features
from pulsegrid.plans.pipeline import statistical_scores
from pulsegrid.sources.tables import read_events
from pulsegrid.streaming import alerts, batches, streams
from pulsegrid.streaming import events as stream_events

SIZES = {"market": 2.0, "payments": 5.0}


def feed(spark, path, frames):
    """One file per micro-batch, in order."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(f"{path}/part={i:03d}")
    return (
        spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True).parquet(path)
    )


def drain(df, path, name="q"):
    query = batches.write_stream(df, f"{path}/{name}/out", f"{path}/{name}/checkpoint", available_now=True)
    query.awaitTermination()
    return query, df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}/out")


def drain_windows(events_, path, domain, name="windows"):
    """Exact stream windows as a table."""
    at_ = f"{path}/{name}"
    query = streams.stream_windows(
        events_, domain, SIZES[domain], f"{at_}/out", f"{at_}/checkpoint", "1 second", available_now=True)
    query.awaitTermination()
    return query, events_.sparkSession.read.parquet(f"{at_}/out").drop("batch")


def transactions(n=400):
    rng = np.random.default_rng(14)
    return [txn("hot" if rng.random() < 0.7 else "b", i, i * 0.2 + float(rng.random()) * 0.1, float(rng.integers(1, 90)),
                ("approved", "declined", "error")[int(rng.integers(3))], f"acct{rng.integers(5)}",
                float(rng.integers(1, 100))) for i in range(n)]


def ticks(n=300):
    rng = np.random.default_rng(15)
    return [tick("s1" if rng.random() < 0.8 else "s2", i, i * 0.1, float(100 + rng.normal()),
                 float(rng.integers(1, 5)), ("buy", "sell")[int(rng.integers(2))]) for i in range(n)]


def assert_same(got, want, columns):
    got, want = rows_by(got, "entity_key", "window_end"), rows_by(want, "entity_key", "window_end")
    assert len(got) == len(want) > 5
    for c in columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_payment_stream_equals_batch(spark, tmp_path):
    rows = transactions()
    frames = [events(spark, rows[i:i + 100]) for i in range(0, 400, 100)]
    _, windows = drain_windows(feed(spark, str(tmp_path / "in"), frames), str(tmp_path), "payments")
    batch = window_features(events(spark, rows), SIZES, domains=("payments",))
    closed = batch.where(F.col("window_end") <= F.lit(max(r[4] for r in rows)) - F.expr("INTERVAL 1 SECOND"))
    assert_same(windows, closed, ["count", "latency_p50_ms", "latency_p99_ms", "error_rate", "mean_amount",
                                  "sum_amount", "decline_rate", "distinct_accounts", "primary_metric"])
    # Windows to state: two files, so state crosses a micro-batch.
    ordered = [windows.where(F.col("window_end") <= F.lit(at(40))), windows.where(F.col("window_end") > F.lit(at(40)))]
    _, stated = drain(streams.stream_state(feed(spark, str(tmp_path / "w"), ordered)), str(tmp_path), "state")
    want = statistical_scores(ewma_zscore(velocity(closed)))
    assert_same(stated, want, streams.STATE_COLUMNS)


def test_market_stream_carries_prices_over_batches(spark, tmp_path):
    rows = ticks()
    frames = [events(spark, rows[i:i + 75]) for i in range(0, 300, 75)]
    _, paired = drain(streams.add_prev_price(feed(spark, str(tmp_path / "in"), frames)), str(tmp_path), "paired")
    assert paired.where("previous_price IS NULL").count() == 2
    halves = [paired.where("seq < 150"), paired.where("seq >= 150")]
    _, got = drain_windows(feed(spark, str(tmp_path / "p"), halves), str(tmp_path), "market")
    batch = window_features(events(spark, rows), SIZES, domains=("market",))
    closed = batch.where(F.col("window_end") <= F.lit(rows[-1][4]) - F.expr("INTERVAL 1 SECOND"))
    assert_same(got, closed, ["count", "vwap", "spread_bps", "realized_vol", "order_imbalance", "latency_p99_ms"])


def test_both_price_streams_agree(spark, tmp_path):
    rows = ticks()
    frames = [events(spark, rows[i:i + 75]) for i in range(0, 300, 75)]
    _, one = drain(streams.add_prev_price(feed(spark, str(tmp_path / "a"), frames)), str(tmp_path), "one")
    streams.stream_prev_price(
        feed(spark, str(tmp_path / "b"), frames), str(tmp_path / "two"), str(tmp_path / "check"), available_now=True
    ).awaitTermination()
    got = rows_by(spark.read.parquet(str(tmp_path / "two")), "seq")
    want = rows_by(one, "seq")
    assert len(got) == 300 and got["previous_price"].isna().sum() == 2
    np.testing.assert_array_equal(got["previous_price"], want["previous_price"])


def test_ticks_move_in_packs(monkeypatch):
    monkeypatch.setattr(streams, "PACK_ROWS", 300)
    rng = np.random.default_rng(3)
    kinds = {"_bucket": pa.int64(), "entity_key": pa.string(), "ts_event": pa.timestamp("us", "UTC"), "seq": pa.int64(), "m_price": pa.float64()}
    columns = [rng.integers(0, 4, 1000).tolist(), [None if i % 9 == 0 else f"s{i % 5}" for i in range(1000)],
               rng.integers(0, 50, 1000).tolist(), list(range(1000)), [None if i % 7 == 0 else i / 3 for i in range(1000)]]
    ticks = pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
    packs = pa.Table.from_batches(list(streams._packed(iter(ticks.to_batches(max_chunksize=100)))))
    assert len(packs) == 4 * 4  # three packs of 300 rows and one of 100
    got = [(b.as_py(), streams._unpacked(t.as_py())) for b, t in zip(packs["_bucket"], packs["ticks"], strict=True)]
    assert all(set(t["_bucket"].to_pylist()) == {b} for b, t in got)
    assert pa.concat_tables([t for _b, t in got]).sort_by("seq").equals(ticks)


def test_previous_prices_with_missing_values(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "PACK_ROWS", 16)
    rows = events(spark, ticks(120)).withColumns({
        "entity_key": F.when(F.col("seq") % 11 != 0, F.col("entity_key")), "m_price": F.when(F.col("seq") % 7 != 0, F.col("m_price")),
        "ts_event": F.date_trunc("second", "ts_event")})
    _, got = drain(streams.add_prev_price(feed(spark, str(tmp_path / "in"), [rows])), str(tmp_path))
    order = Window.partitionBy("entity_key").orderBy("ts_event", "seq", "event_id")
    want = rows.withColumn("previous_price", F.lag("m_price").over(order)).select("seq", "m_price", "previous_price")
    assert sorted(map(tuple, got.select("seq", "m_price", "previous_price").collect())) == sorted(map(tuple, want.collect()))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    # Spark compares rows with the watermark of the batch before.
    frames = [events(spark, [txn("m", 1, 1, 1.0), txn("m", 2, 100, 1.0)]), events(spark, [txn("m", 6, 101, 1.0)]),
              events(spark, [txn("m", 3, 2, 1.0)]), events(spark, [txn("m", 5, 200, 1.0)])]
    query, got = drain_windows(feed(spark, str(tmp_path / "in"), frames), str(tmp_path), "payments")
    assert {r["window_start"]: r["count"] for r in got.collect()} == {at(0): 1, at(100): 2}
    assert batches.late_rows(query) == 1


def test_sketches_stay_close(spark, tmp_path):
    rows = transactions()
    stream = streams.stream_windows_approx(
        feed(spark, str(tmp_path / "in"), [events(spark, rows)]), "payments", 5.0, "1 second")
    _, got = drain(stream, str(tmp_path))
    batch = window_features(events(spark, rows), SIZES, domains=("payments",))
    both = got.alias("g").join(batch.alias("b"), ["entity_key", "window_start"]).selectExpr(
        "abs(g.distinct_accounts - b.distinct_accounts) d", "abs(g.latency_p50_ms - b.latency_p50_ms) l", "b.count n"
    ).toPandas()
    # With an odd count both rank conventions name the same middle value.
    assert len(both) > 10 and both["d"].max() <= 1 and both[both["n"] % 2 == 1]["l"].max() == 0


def test_alerts_are_written_once_when_a_batch_repeats(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    write = batches.write_batches(str(tmp_path / "alerts"))
    write(df, 0)
    write(df, 0)
    write(df, 1)
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 4


def test_a_reader_sees_a_repeated_batch_once(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    write = batches.write_batches(str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    seen = []
    for batch_id in (0, 0, 1, 0):
        write(df, batch_id)
        stream = spark.readStream.schema("v int").parquet(str(tmp_path / "out"))
        _, got = drain(stream, str(tmp_path), "reader")
        seen.append(got.count())
    assert seen == [2, 2, 4, 4]


def test_run_scores_over_cut_sequences(spark):
    rng = np.random.default_rng(3)
    z = pd.Series(np.round(rng.normal(0, 2, 200), 1))
    whole = streams.run_scores(z)
    for cut in (1, 3, 50):
        carried = z[max(0, cut - streams.RUN_ROWS + 1):]
        np.testing.assert_array_equal(streams.run_scores(carried)[-(200 - cut):], whole[cut:])
    # By hand: two of three above 2, four of five below -1, one beyond 3.
    assert streams.run_scores(pd.Series([2.5, 0.0, 2.5]))[-1] == 0.8
    assert streams.run_scores(pd.Series([-1.5, -1.5, 0.0, -1.5, -1.5]))[-1] == 0.6
    assert streams.run_scores(pd.Series([-3.5]))[-1] == 1.0
    assert streams.run_scores(pd.Series([2.5, 2.5]))[-1] < 0.5


def test_observed_counts(spark, tmp_path):
    stream = feed(spark, str(tmp_path / "in"), [events(spark, transactions(50) + ticks(20))])
    query, _ = drain(batches.observed(stream, "seen"), str(tmp_path))
    metrics = [p["observedMetrics"]["seen"] for p in query.recentProgress if "seen" in p["observedMetrics"]]
    assert sum(m["rows"] for m in metrics) == 70 and sum(m["market"] for m in metrics) == 20


def test_rollup_stream_emits_closed_buckets(spark, tmp_path):
    rows = [("market", "watch", at(t), 0.5, 10.0) for t in (1, 2, 301, 900)]
    df = spark.createDataFrame(rows, "domain string, severity string, ts timestamp, anomaly_score double, "
                                     "latency_ingest_to_alert_ms double")
    _, got = drain(alerts.stream_rollup(feed(spark, str(tmp_path / "in"), [df]), "alerts_5m"), str(tmp_path))
    assert {r["bucket"]: r["alert_count"] for r in got.collect()} == {at(0): 2, at(300): 1}


def test_text_lines_become_events(spark, tmp_path):
    uid = "7c6f1a9e-2b3d-4f5c-8a1e-9d6b4c2f0e7a"
    good = {"event_id": uid, "domain": "market", "entity_key": "s", "source": "f", "seq": 1,
            "ts_event": "2026-01-01T00:00:00Z", "corrupted": False,
            "payload": {"symbol": "s", "price": 1.0, "size": 1.0, "side": "buy", "bid": 1.0, "ask": 1.0,
                        "exchange_latency_ms": 1.0}}
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(good) + "\n{broken\n")
    stream = stream_events.parse_stream(read_events(spark, "files", path=str(folder)))
    _, got = drain(stream, str(tmp_path))
    assert [(r["m_price"], r["ts_ingest"] is not None) for r in got.collect()] == [(1.0, True)]


def test_unknown_rollup_is_an_error(spark, tmp_path):
    with pytest.raises(KeyError):
        alerts.stream_rollup(feed(spark, str(tmp_path / "in"), [events(spark, ticks(2))]), "alerts_1d")


def test_counts_cover_more_batches_than_progress_keeps(spark, tmp_path):
    frames = [events(spark, [txn("m", 1, 1, 1.0), txn("m", 2, 100, 1.0)]), events(spark, [txn("m", 6, 101, 1.0)]),
              *[events(spark, [txn("m", 10 + i, 2, 1.0)]) for i in range(3)], events(spark, [txn("m", 5, 200, 1.0)])]
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(kept, "2")
    try:
        seen = batches.observed(feed(spark, str(tmp_path / "in"), frames), "seen")
        query, _ = drain_windows(seen, str(tmp_path), "payments")
        assert len(query.recentProgress) <= 2
        assert batches.late_rows(query) == 3
        assert batches.observed_counts(query, "seen") == {"rows": 7, "market": 0, "payments": 7}
        # A restart goes on from the checkpoint and keeps the counts of earlier batches.
        feed(spark, str(tmp_path / "in"), [events(spark, [txn("m", 20, 3, 1.0)])])
        again = batches.observed(
            spark.readStream.schema(frames[0].schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), "seen")
        query, _ = drain_windows(again, str(tmp_path), "payments")
        assert batches.late_rows(query) == 4 and batches.observed_counts(query, "seen")["rows"] == 8
    finally:
        spark.conf.unset(kept)


def test_an_entity_is_paired_in_many_groups(spark, tmp_path):
    # Four instants of one entity, 60 ticks each; a batch of one instant only sets the watermark that drops the late ticks.
    rng = np.random.default_rng(16)
    frames = [[tick("s", 1000 * i + int(k), s, 100 + 10 * i + int(k)) for i in part for k, s in zip(rng.permutation(60), [at_s[i]] * 60)]
              for at_s in [(0, 0.0004, 50, 100)] for part in ((0, 1), (2,), (3,))]
    frames.append([tick("s", 5000 + k, k * 25, 1.0) for k in range(5)])
    stream = streams.add_prev_price(feed(spark, str(tmp_path / "in"), [events(spark, f) for f in frames]), 20.0)
    plan = stream._jdf.queryExecution().logical().toString()
    assert "FlatMapGroupsInPandas " in plan and "_bucket" in plan
    query, got = drain(stream, str(tmp_path))
    want = rows_by(events(spark, [r for f in frames[:3] for r in f]), "ts_event", "seq")["m_price"].tolist()
    got = rows_by(got, "ts_event", "seq")
    # At 50 s the watermark is 30 s: ticks at 0 and 25 s are dropped, those after it are paired with what came before.
    early, late = got[got["seq"] < 5000], got[got["seq"] >= 5000]
    assert early["m_price"].tolist() == want
    assert early["previous_price"].fillna(-1).tolist() == [-1, *want[:-1]]
    assert late["seq"].tolist() == [5002, 5003, 5004] and late["previous_price"].tolist() == [want[-1], 1.0, 1.0]
    assert batches.late_rows(query) == 2
