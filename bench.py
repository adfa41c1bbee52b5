"""Time the headline queries and print one JSON line.

The chain from raw events to rollup runs once on a small table first, untimed, so
that the numbers show a running service and not the start of its JVM.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks import tables
from checks.catalog import QUERIES
from pulsegrid.operators.rollups import alerts_5m
from pulsegrid.plans.pipeline import feature_table, score_pipeline
from pulsegrid.sources.adapters import SIZES, all_events

HEADLINES = [
    "s2_parse_good", "s6_validate_contract", "w1_window_counts", "w4_latency_quantiles", "w5_market_windows",
    "w10_payment_windows", "w13_ewma_zscore", "v3_seq_gaps", "d2_run_rules", "d3_cusum", "d4_rolling_iforest",
    "d5_rolling_pca_error", "e1_ensemble", "e3_top_features", "e6_build_alerts", "e9_drift_asof", "m1_psi", "m2_ks",
    "t1_label_any", "t7_average_precision", "t13_episodes", "r1_alerts_5m", "r6_rollup_series", "r11_latency_quantiles",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pulsegrid-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    timings: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        timings[name] = round(time.perf_counter() - start, 3)

    def end_to_end(folder):
        # Nothing is reused here: raw events to alert rollup in one plan.
        _run(alerts_5m(score_pipeline(feature_table(all_events(spark, folder), SIZES), tables.closing_time())))

    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    end_to_end(small if os.path.isdir(small) else sf_dir)
    events = all_events(spark, sf_dir).count()
    timed("raw_to_rollup", lambda: end_to_end(sf_dir))
    # Stored tables, as in production: later queries read them.
    timed("build_windows", lambda: tables.windows(spark, sf_dir))
    timed("build_features", lambda: tables.features(spark, sf_dir))
    timed("build_scored", lambda: tables.scored(spark, sf_dir))
    timed("build_alerts", lambda: tables.alerts(spark, sf_dir))
    timed("build_marked", lambda: tables.marked(spark, sf_dir))
    timed("build_metrics", lambda: tables.metrics(spark, sf_dir))
    for name in HEADLINES:
        timed(name, lambda n=name: _run(QUERIES[n](spark, sf_dir)))
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")), "events": events,
        "events_per_s_raw_to_rollup": round(events / timings["raw_to_rollup"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
