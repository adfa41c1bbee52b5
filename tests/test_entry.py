from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_point
from checks.verify import TABLES, compare

SF = "/root/testdata/sf0.001"
# A spread of operators; ``python -m checks.verify`` runs them all.
SAMPLE = [
    "s1_split_frames", "s2_parse_good", "s6_validate_contract", "w4_latency_quantiles", "w7_market_windows_range",
    "w13_ewma_zscore", "v3_seq_gaps", "d3_cusum", "d8_refit_groups", "e3_top_features", "e5_alert_id",
    "e9_drift_asof", "m1_psi", "m2_ks", "t2_label_first", "t7_average_precision", "t15_evaluation_report",
    "r6_rollup_series", "r11_latency_quantiles", "x2_stream_state",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["bucket", "domain", "severity", "alert_count", "sum_anomaly_score", "sum_latency_ms"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert len(entry_point.queries()) > 80


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql_twin(spark, duck, name):
    got = entry_point.queries()[name](spark, SF).toPandas()
    assert compare(got, duck.execute(entry_point.oracle_sql()[name]).df()) == "ok"
    assert len(got)


def test_scans_read_only_the_columns_they_need(spark):
    plan = entry_point.queries()["w4_latency_quantiles"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and not any("l_extendedprice" in s or "value#" in s for s in scans)


def test_no_query_plans_a_cross_join(spark):
    for name in ("w1_window_counts", "e9_drift_asof", "m1_psi", "t1_label_any", "r11_latency_quantiles", "r16_kpis"):
        plan = entry_point.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
