from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import events, rows_by, series, tick, txn
from pulsegrid.functions.expr import squash
from pulsegrid.operators.sequence import corruption_audit, cusum, feature_vector, run_rules, seq_gaps, velocity


def test_velocity_sums_the_last_twenty_windows(spark):
    counts = list(range(1, 31))
    df = series(spark, [0.0] * 30, counts=counts).unionByName(series(spark, [0.0], entity="e2", counts=[7]))
    got = rows_by(velocity(df), "entity_key", "window_end")["velocity_count"]
    assert list(got) == [float(sum(counts[max(0, i - 19):i + 1])) for i in range(30)] + [7.0]


def test_squash_saturates(spark):
    row = spark.range(1).select(squash(F.lit(0.0)).alias("a"), squash(F.lit(-4.0)).alias("b"),
                                squash(F.lit(100.0)).alias("c")).first()
    assert row["a"] == 0.0 and row["b"] == pytest.approx(1 - np.exp(-1)) and 0.99 < row["c"] <= 1.0


def rules_loop(zs):
    out = []
    for i, z in enumerate(zs):
        three, five = zs[max(0, i - 2):i + 1], zs[max(0, i - 4):i + 1]

        def most(part, limit):
            return max(sum(v > limit for v in part), sum(v < -limit for v in part))

        if abs(z) > 3:
            out.append(1.0)
        elif len(three) == 3 and most(three, 2.0) >= 2:
            out.append(0.8)
        elif len(five) == 5 and most(five, 1.0) >= 4:
            out.append(0.6)
        else:
            out.append(0.5 * (1 - np.exp(-abs(z) / 6)))
    return out


def cusum_loop(zs, k=0.5, h=5.0):
    up = down = 0.0
    out = []
    for z in zs:
        up, down = max(0.0, up + z - k), min(0.0, down + z + k)
        out.append(min(max(up, -down) / h, 1.0))
    return out


def test_run_rules_and_cusum_match_loops(spark):
    rng = np.random.default_rng(5)
    zs = np.concatenate([rng.normal(0, 1.6, 200), rng.normal(1.5, 0.6, 40), rng.normal(-2, 1, 40)])
    df = series(spark, zs, zscores=zs)
    got = rows_by(cusum(run_rules(df)), "window_end")
    assert len(got) == len(zs) and set(np.round(rules_loop(zs), 9)) >= {1.0, 0.8, 0.6}
    np.testing.assert_allclose(got["ewma_score"], rules_loop(list(zs)), atol=1e-12)
    np.testing.assert_allclose(got["cusum_score"], cusum_loop(zs), atol=1e-9)


def test_two_shifted_points_need_three_in_the_window(spark):
    got = rows_by(run_rules(series(spark, [0, 0], zscores=[2.5, 2.5])), "window_end")["ewma_score"]
    assert got.max() < 0.5
    got = rows_by(run_rules(series(spark, [0] * 3, zscores=[0.0, 2.5, 2.5])), "window_end")["ewma_score"]
    assert got.iloc[-1] == 0.8
    got = rows_by(run_rules(series(spark, [0] * 3, zscores=[0.0, 2.5, -2.5])), "window_end")["ewma_score"]
    assert got.iloc[-1] < 0.5


def test_vector_is_null_free_and_ordered(spark):
    schema = (
        "domain string, zscore double, realized_vol double, spread_bps double, order_imbalance double, "
        "mean_amount double, decline_rate double, distinct_accounts long, throughput_eps double, "
        "latency_p99_ms double, error_rate double, velocity_count double"
    )
    rows = [("market", 1.0, 2.0, None, 4.0, None, None, None, 5.0, 6.0, 7.0, 8.0),
            ("payments", 1.0, None, None, None, -3.0, 0.2, 3, 5.0, 6.0, 7.0, 8.0)]
    got = {r["domain"]: r["vector"] for r in feature_vector(spark.createDataFrame(rows, schema)).collect()}
    assert got["market"] == [1.0, 2.0, 0.0, 4.0, 5.0, 6.0, 7.0, 8.0]
    assert got["payments"] == [1.0, 0.0, 0.2, 3.0, 5.0, 6.0, 7.0, 8.0]


def test_gaps_and_reorders(spark):
    df = events(spark, [txn("m", s, i, 1.0) for i, s in enumerate([1, 2, 5, 6, 4, 5])] + [txn("n", 9, 0, 1.0)])
    got = [(r["seq"], r["step"], r["kind"]) for r in seq_gaps(df).orderBy("ts_event").collect()]
    assert got == [(5, 3, "gap"), (4, -2, "reorder")]


def test_audit_names_every_trait(spark):
    rows = [tick("s", 1, 0, -5.0, size=0.0, latency=9_000.0), txn("m", 2, 0, -1.0, account="", latency=20_000.0),
            txn("m", 3, 0, 1.0), txn("m", 4, 0, 1.0, latency=6_000.0)]
    df = events(spark, rows).withColumn("p_currency", F.when(F.col("seq") == 2, "XXX").otherwise("USD"))
    df = df.withColumn("m_bid", F.when(F.col("seq") == 1, 9.0))
    got = {r["seq"]: r["reasons"] for r in corruption_audit(df).collect()}
    assert got[1] == ["negative_price", "crossed_book", "zero_size", "extreme_latency"]
    assert got[2] == ["extreme_latency", "negative_amount", "bad_currency", "empty_hash"]
    assert got[3] == got[4] == []
