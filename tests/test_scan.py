from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulsegrid.functions.quantile import exact_quantiles
from pulsegrid.functions.scan import BLOCK, FINE_BLOCKS, numbered, range_blocks, running, segments_with_halo, value_block
from pulsegrid.functions.scratch import scratch_root


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows belong to one key."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({
        "k": np.where(rng.random(3000) < 0.66, "hot", rng.choice(["a", "b", "c"], 3000)),
        "t": rng.permutation(3000), "v": rng.normal(size=3000).round(3),
    })
    pdf.loc[pdf.index % 7 == 0, "v"] = np.nan
    return pdf


def test_running_measures_match_a_loop(spark, hot):
    df = spark.createDataFrame(hot).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    blocked = range_blocks(df, ["k"], ["t"], partitions=7)
    got = running(blocked, ["k"], ["t"], {
        "s": ("sum", F.coalesce("v", F.lit(0.0))), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")),
        "seen": ("last", F.col("v")), "before": ("previous", F.col("v")), "n": ("total", F.lit(1)),
    }).toPandas().sort_values(["k", "t"], ignore_index=True)
    want = hot.sort_values(["k", "t"], ignore_index=True)
    g = want.groupby("k")["v"]
    assert len(got) == len(want)
    np.testing.assert_allclose(got["s"], want["v"].fillna(0).groupby(want["k"]).cumsum(), atol=1e-9)
    np.testing.assert_allclose(got["lo"], g.cummin().groupby(want["k"]).ffill())
    np.testing.assert_allclose(got["hi"], g.cummax().groupby(want["k"]).ffill())
    np.testing.assert_allclose(got["seen"], g.ffill())
    np.testing.assert_allclose(got["before"].astype(float), g.shift(1))
    assert (got["n"] == g.transform("size")).all()


def test_hot_key_is_spread_over_blocks(spark, hot):
    blocked = range_blocks(spark.createDataFrame(hot), ["k"], ["t"], partitions=8)
    sizes = blocked.where("k = 'hot'").groupBy(BLOCK).count().toPandas()["count"]
    assert len(sizes) >= 4 and sizes.max() < 0.4 * sizes.sum()


def test_numbered_is_row_number(spark, hot):
    got = numbered(spark.createDataFrame(hot), ["k"], ["t"], "no").toPandas()
    want = got.groupby("k")["t"].rank().astype(int)
    assert (got["no"] == want).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=2, max_size=2))
def test_value_block_formula_is_monotone(pair):
    # The same formula as the column expression, on plain floats.
    def block(x):
        if x == 0:
            return 0
        scaled = int(np.floor(np.log2(abs(x)) * 64)) + 1100 * 64
        return scaled if x > 0 else -scaled

    low, high = sorted(pair)
    assert block(low) <= block(high)


def test_value_block_column_is_monotone(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=500), rng.normal(size=500) * 1e9, [0.0, 1e-300, -1e-300]])
    got = spark.createDataFrame(pd.DataFrame({"x": x})).withColumn("b", value_block(F.col("x"))).toPandas()
    assert got.sort_values("x")["b"].is_monotonic_increasing


@pytest.mark.parametrize("kind", ["nearest", "floor", "linear"])
def test_quantiles_match_sorting(spark, hot, kind):
    pdf = hot.dropna()
    got = exact_quantiles(
        spark.createDataFrame(pdf), ["k"], "v", {"p50": 0.5, "p99": 0.99}, kind, count="n"
    ).toPandas().set_index("k")
    for key, part in pdf.groupby("k"):
        s, n = np.sort(part["v"]), len(part)
        for name, p in (("p50", 0.5), ("p99", 0.99)):
            want = {
                "nearest": s[int(np.floor((n - 1) * p + 0.5))], "floor": s[min(int(n * p), n - 1)],
                "linear": np.quantile(s, p),
            }[kind]
            assert got.loc[key, name] == pytest.approx(want, abs=1e-12)
        assert got.loc[key, "n"] == n


def test_quantile_of_no_rows_is_one_null_row(spark):
    row = exact_quantiles(spark.createDataFrame([], "v double"), [], "v", {"p50": 0.5}, "linear", count="n").first()
    assert row["p50"] is None and row["n"] == 0


def test_segments_repeat_only_the_halo(spark):
    df = spark.range(1, 26).withColumnRenamed("id", "no")
    cut = segments_with_halo(df, "no", 10, 3).toPandas()
    assert sorted(cut.loc[~cut["_halo"], "no"]) == list(range(1, 26))
    assert sorted(cut.loc[cut["_halo"], "no"]) == [8, 9, 10, 18, 19, 20]


def test_scratch_folder_is_the_configured_one(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_value_blocks_take_infinities_and_nan(spark):
    values = [float("-inf"), -1e308, -1.0, 0.0, 1e-320, 1.0, 1e308, float("inf"), float("nan")]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["b"] for r in frame.select("i", value_block(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


def test_close_values_of_a_domain_fall_into_many_blocks(spark):
    values = [20.0 + 0.2 * i / 1000 for i in range(1000)]
    extremes = [float("-inf"), -1e308, -20.1, -5e-324, 0.0, 5e-324, *values, 1e308, float("inf"), float("nan")]
    df = spark.createDataFrame([(x,) for x in extremes], "x double").select("x", value_block(F.col("x"), FINE_BLOCKS).alias("b"))
    blocks = [r["b"] for r in df.collect()]
    assert blocks == sorted(blocks) and len(set(blocks[6:-3])) > 40
    df = spark.createDataFrame([(x,) for x in values], "x double")
    fine, coarse = (exact_quantiles(df, [], "x", {"p": 0.37, "q": 0.99}, "linear", per_power=n).first() for n in (FINE_BLOCKS, 64))
    assert fine == coarse
