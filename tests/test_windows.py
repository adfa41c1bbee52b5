from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import at, events, rows_by, series, tick, txn
from pulsegrid.operators import windows
from pulsegrid.operators.ewma import ewma_zscore
from pulsegrid.operators.windows import TICK_ORDER, assign_windows, emit_lag, market_windows, window_features

SIZES = {"market": 2.0, "payments": 5.0}


def test_market_window_of_three_ticks(spark):
    df = events(spark, [tick("s", 1, 0.1, 100, side="buy"), tick("s", 2, 0.2, 102), tick("s", 3, 0.3, 98, side="sell")])
    row = window_features(df, SIZES).first()
    assert row["count"] == 3 and row["vwap"] == pytest.approx(100.0) and row["order_imbalance"] > 0
    assert row["throughput_eps"] == 1.5 and row["mean_amount"] is None and row["distinct_accounts"] is None
    assert row["primary_metric"] == row["realized_vol"]


def test_payments_window_of_two(spark):
    df = events(spark, [txn("m", 1, 0, 100), txn("m", 2, 1, 200, "declined", "b"), txn("m", 3, 2, 0, "error", "b")])
    row = window_features(df, SIZES).first()
    assert row["mean_amount"] == 100.0 and row["sum_amount"] == 300.0
    assert row["decline_rate"] == pytest.approx(1 / 3) and row["error_rate"] == pytest.approx(2 / 3)
    assert row["distinct_accounts"] == 2 and row["vwap"] is None


def test_price_is_carried_over_empty_windows(spark):
    df = events(spark, [tick("s", 1, 0.0, 100), tick("s", 2, 6.1, 101), tick("s", 3, 6.2, 102)])
    got = rows_by(window_features(df, SIZES), "window_start")
    assert len(got) == 2 and got.loc[0, "realized_vol"] == 0.0
    want = math.sqrt((math.log(1.01) ** 2 + math.log(102 / 101) ** 2) * 31_536_000 / 2.0)
    assert got.loc[1, "realized_vol"] == pytest.approx(want)


def test_bad_prices_break_returns_but_still_carry(spark):
    df = events(spark, [tick("s", 1, 0.0, 100), tick("s", 2, 0.1, -5), tick("s", 3, 0.2, 101), tick("s", 4, 0.3, 103),
                        tick("z", 5, 0.0, 7, size=0.0), tick("z", 6, 0.1, 8, size=0.0)])
    got = rows_by(window_features(df, SIZES), "entity_key").set_index("entity_key")
    want = math.sqrt(math.log(103 / 101) ** 2 * 31_536_000 / 2.0)
    assert got.loc["s", "realized_vol"] == pytest.approx(want)
    assert got.loc["z", "vwap"] == 8.0 and got.loc["z", "order_imbalance"] == 0.0


def test_nearest_rank_latencies(spark):
    df = events(spark, [txn("m", i, 0.1, 1.0, latency=float(i)) for i in range(1, 11)])
    row = window_features(df, SIZES).first()
    assert (row["latency_p50_ms"], row["latency_p99_ms"]) == (6.0, 10.0)


def brute_market(rows, size=2.0):
    last, out = {}, {}
    for r in sorted(rows, key=lambda r: (r[4], r[3], r[0])):
        key = (r[2], int(math.floor((r[4] - at(0)).total_seconds() / size)))
        ssq, pq, q = out.get(key, (0.0, 0.0, 0.0))
        prev = last.get(r[2])
        if prev is not None and prev > 0 and r[6] > 0:
            ssq += math.log(r[6] / prev) ** 2
        last[r[2]] = r[6]
        out[key] = (ssq, pq + r[6] * r[7], q + r[7])
    return {k: (math.sqrt(v[0] * 31_536_000 / size), v[1] / v[2]) for k, v in out.items()}


@pytest.mark.parametrize("split", ["time", "range"])
def test_hot_entity_with_tied_instants_matches_a_loop(spark, split):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(2000):
        entity = "hot" if rng.random() < 0.7 else f"s{rng.integers(4)}"
        seconds = float(rng.integers(0, 40)) / 4 if rng.random() < 0.5 else float(rng.random() * 10)
        rows.append(tick(entity, i, seconds, float(100 + rng.normal()), size=float(rng.integers(1, 9))))
    got = market_windows(assign_windows(events(spark, rows), SIZES), split).toPandas()
    want = brute_market(rows)
    assert len(got) == len(want)
    for _, r in got.iterrows():
        vol, vwap = want[(r["entity_key"], int((r["window_start"] - at(0)).total_seconds() / 2))]
        assert r["realized_vol"] == pytest.approx(vol) and r["vwap"] == pytest.approx(vwap)


def test_entity_origin_anchors_at_the_first_event(spark):
    df = events(spark, [txn("m", 1, 3, 1.0), txn("m", 2, 7.9, 1.0), txn("m", 3, 8.0, 1.0), txn("n", 4, 1, 1.0)])
    got = rows_by(window_features(df, SIZES, origin="entity", domains=("payments",)), "entity_key", "window_start")
    assert [(r.entity_key, r.window_start, r["count"]) for _, r in got.iterrows()] == [
        ("m", at(3), 2), ("m", at(8), 1), ("n", at(1), 1)]


def loop_ewma(xs, alpha=0.1):
    mean, var, out = None, 0.0, []
    for x in xs:
        if mean is None:
            mean = x
            out.append((x, 0.0, 0.0))
            continue
        floor, delta = max(var, 1e-9), x - mean
        out.append((mean, floor, delta / math.sqrt(floor)))
        mean, var = mean + alpha * delta, (1 - alpha) * (var + alpha * delta * delta)
    return np.array(out)


@pytest.mark.parametrize("alpha,segment,n", [(0.1, 16384, 300), (0.7, 8, 2000)])
def test_ewma_matches_the_recurrence_across_segments(spark, alpha, segment, n):
    rng = np.random.default_rng(4)
    xs = rng.normal(50, 5, n)
    xs[n // 3] = 5000.0
    df = series(spark, xs).unionByName(series(spark, xs[::-1], entity="e2")).drop("zscore")
    got = rows_by(ewma_zscore(df, alpha, segment), "entity_key", "window_end")
    assert len(got) == 2 * n
    for entity, values in (("e1", xs), ("e2", xs[::-1])):
        mine = got[got["entity_key"] == entity][["ewma_mean", "ewma_var", "zscore"]].to_numpy()
        assert not np.isnan(mine).any()
        np.testing.assert_allclose(mine, loop_ewma(values, alpha), rtol=1e-9, atol=1e-9)


def test_ewma_cases(spark):
    first = ewma_zscore(series(spark, [42.0]).drop("zscore")).first()
    assert (first["zscore"], first["ewma_mean"], first["ewma_var"]) == (0.0, 42.0, 0.0)
    flat = ewma_zscore(series(spark, [7.0] * 30).drop("zscore")).agg(F.max(F.abs("zscore"))).first()[0]
    assert flat == 0.0
    spike = rows_by(ewma_zscore(series(spark, [50.0, 51.0] * 10 + [5000.0] * 3).drop("zscore")), "window_end")
    assert spike.loc[20, "zscore"] > 5
    drift = rows_by(ewma_zscore(series(spark, [10.0] + [20.0] * 60).drop("zscore")), "window_end")
    assert abs(drift.iloc[-1]["ewma_mean"] - 20) < 0.5


def test_emit_lag_is_never_negative(spark):
    df = series(spark, [1.0, 1.0])
    got = rows_by(emit_lag(df, F.lit(at(7.5))), "window_end")
    assert list(got["emit_lag_ms"]) == [2500.0, 0.0]


def _window_inputs(plan):
    """Column names that go into the window nodes of a plan."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    found = {a for c in children for a in _window_inputs(c)}
    if plan.nodeName() == "Window":
        outputs = children[0].output()
        found |= {outputs.apply(i).name() for i in range(outputs.size())}
    return found


def test_only_prices_are_put_in_order(spark):
    rows = [tick("a", i, i * 0.3, 100 + i % 3, size=2.0) for i in range(20)]
    got = market_windows(assign_windows(events(spark, rows), {"market": 2.0}))
    ordered = _window_inputs(got._jdf.queryExecution().optimizedPlan())
    assert "m_price" in ordered and not ordered & {"m_size", "m_side", "m_bid", "m_ask", "corrupted"}


def test_a_window_without_entity_keeps_its_sums(spark):
    rows = [tick(e, i, i * 0.3, 100 + i % 3, size=2.0) for i, e in enumerate([None, "a"] * 6)]
    got = market_windows(assign_windows(events(spark, rows), {"market": 2.0})).groupBy("entity_key").sum("count").collect()
    assert {tuple(r) for r in got} == {(None, 6), ("a", 6)}


def test_event_ids_stay_out_of_the_tick_order(spark, monkeypatch):
    stored, store = [], windows.materialize
    monkeypatch.setattr(windows, "materialize", lambda df: stored.append(df) or store(df))
    rows = [tick("a", i, i * 0.3, 100 + i % 3) for i in range(20)]
    market_windows(assign_windows(events(spark, rows), SIZES))
    ordered = _window_inputs(stored[0]._jdf.queryExecution().optimizedPlan())
    assert "m_price" in ordered and "event_id" not in ordered


def test_ids_decide_between_ticks_of_one_position(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in rng.permutation(1500):
        row = list(tick(f"s{rng.integers(3)}", int(i), int(rng.integers(0, 24)) / 4, float(100 + rng.integers(0, 4))))
        row[3] = int(rng.integers(0, 6))  # few numbers, so that many ticks share a position
        rows.append(tuple(row))
    got = market_windows(assign_windows(events(spark, rows), SIZES)).toPandas()
    want = brute_market(rows)
    assert len(got) == len(want)
    for _, r in got.iterrows():
        vol, vwap = want[(r["entity_key"], int((r["window_start"] - at(0)).total_seconds() / 2))]
        assert r["realized_vol"] == pytest.approx(vol) and r["vwap"] == pytest.approx(vwap)


def test_runs_by_position_equal_runs_in_full_order(spark):
    rng = np.random.default_rng(12)

    def some(value):
        return None if rng.random() < 0.2 else value

    rows = [(int(rng.integers(4)), some("a"), some(at(0)), some(int(rng.integers(0, 12))), f"e{i}", some(float(rng.integers(-1, 4))))
            for i in rng.permutation(400)]
    rows += rows[:100]  # repeats
    runs = spark.createDataFrame(rows, "_run long, entity_key string, ts_event timestamp, seq long, event_id string, m_price double")
    full = windows._with_neighbours(runs.withColumn("_open", F.lit(False)), ["_run", "entity_key"], TICK_ORDER)
    want = full.groupBy("_run", "entity_key").agg(*windows._pair_sums(F.lit(True), F.lit(True)))
    got = windows._runs_by_position(runs, ["entity_key"])
    assert got.columns == want.columns

    def rounded(df):
        return sorted((tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)

    assert rounded(got) == rounded(want)


def test_ticks_of_a_run_are_gathered_in_fine_partitions_before_they_are_ordered(spark):
    run = ["_run", "window_start", "entity_key"]
    ticks = spark.range(3000).select(
        (F.col("id") * 7919 % 60).alias("_run"), F.lit(at(0)).alias("window_start"),
        F.concat(F.lit("s"), F.col("id") % 5).alias("entity_key"), F.col("id").alias("seq"))
    got = windows._gathered(ticks, run).rdd.glom().collect()
    assert len(got) == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r["seq"] for part in got for r in part) == list(range(3000))
    homes = {}
    for i, part in enumerate(got):
        assert [r["_run"] for r in part] == sorted(r["_run"] for r in part)
        for r in part:
            assert homes.setdefault((r["_run"], r["entity_key"]), i) == i


def test_more_ticks_go_to_more_partitions_of_the_tick_order(spark, monkeypatch):
    monkeypatch.setattr(windows, "_TICKS_PER_PARTITION", 50, raising=False)
    run = ["_run", "window_start", "entity_key"]
    ticks = spark.range(3000).select(
        (F.col("id") * 7919 % 600).alias("_run"), F.lit(at(0)).alias("window_start"), F.lit("s").alias("entity_key"), F.col("id").alias("seq"))
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for n, want in ((0, least), (50 * least, least), (2000, 40), (2001, 41), (3000, 60)):
        got = windows._gathered(ticks.where(F.col("seq") < n), run).rdd.glom().collect()
        assert len(got) == want
        assert sorted(r["seq"] for part in got for r in part) == list(range(n))
        homes = {(r["_run"], i) for i, part in enumerate(got) for r in part}
        assert len(homes) == len({r for r, _i in homes})


def test_a_position_is_open_by_all_its_prices_and_not_by_neighbours_alone(spark):
    # Three ticks of one position, of which two have one price; the ids put the other between them.
    rows = [tick("s", 1, 0.1, 100.0), tick("s", 2, 0.2, 100.0), tick("s", 3, 0.2, 104.0), tick("s", 4, 0.2, 100.0),
            tick("s", 9, 0.3, 101.0)]
    df = events(spark, rows).withColumn("seq", F.when(F.col("seq").isin(2, 3, 4), F.lit(2)).otherwise(F.col("seq")))
    got = market_windows(assign_windows(df, SIZES)).first()["realized_vol"]
    steps = [100.0, 100.0, 104.0, 100.0, 101.0]
    ssq = sum(math.log(b / a) ** 2 for a, b in zip(steps, steps[1:], strict=False))
    assert got == pytest.approx(math.sqrt(ssq * 31_536_000 / 2.0))
