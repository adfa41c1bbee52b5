"""Rollups, searches and dashboard aggregates over alerts, features and metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.quantile import exact_quantiles
from pulsegrid.functions.scan import FINE_BLOCKS
from pulsegrid.sources.contracts import DOMAINS, SEVERITIES
from pulsegrid.sources.tables import since

# Histogram edges in ms and request limits.
LAG_EDGES_MS = [1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 250.0, 500.0, 1000.0]
ALERT_COLUMNS = [
    "alert_id", "entity_key", "domain", "ts", "window_end", "anomaly_score", "severity", "action", "detectors",
    "probable_cause", "top_features", "model_version", "drift_flag", "latency_ingest_to_alert_ms",
]
_ROLLUP_KEYS = {
    "alerts_5m": ["bucket", "domain", "severity"],
    "throughput_1m": ["bucket", "domain", "entity_key"],
    "causes_1h": ["bucket", "domain", "probable_cause"],
}


def bucket(ts: str, seconds: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``ts``."""
    width = seconds * 1_000_000
    return F.timestamp_micros(F.floor(F.unix_micros(ts) / F.lit(width)).cast("long") * width)


def _alert_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("alert_count"), F.sum("anomaly_score").alias("sum_anomaly_score"),
            F.sum("latency_ingest_to_alert_ms").alias("sum_latency_ms")]


#: Per rollup: time column, bucket width in words, dimensions, aggregates. Shared with the streams.
ROLLUPS: dict[str, tuple[str, str, list[str], Callable[[], list[Column]]]] = {
    "alerts_5m": ("ts", "300 seconds", ["domain", "severity"], _alert_sums),
    "throughput_1m": ("window_end", "60 seconds", ["domain", "entity_key"], lambda: [F.sum("count").alias("events")]),
    "causes_1h": ("ts", "3600 seconds", ["domain", "probable_cause"], lambda: [F.count(F.lit(1)).alias("alert_count")]),
}


def _rollup(df: DataFrame, name: str) -> DataFrame:
    ts, width, dims, aggs = ROLLUPS[name]
    return df.groupBy(bucket(ts, int(width.split(" ")[0])).alias("bucket"), *dims).agg(*aggs())


def alerts_5m(alerts: DataFrame) -> DataFrame:
    """Alert count, score sum and latency sum per five minutes; sums merge, averages do not."""
    return _rollup(alerts, "alerts_5m")


def throughput_1m(features: DataFrame) -> DataFrame:
    """Events per entity and minute of window end."""
    return _rollup(features, "throughput_1m")


def causes_1h(alerts: DataFrame) -> DataFrame:
    """Alerts per probable cause and hour (storage rows, with a flat ``probable_cause``)."""
    return _rollup(alerts, "causes_1h")


def merge_rollup(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up partial rollup rows of the same key."""
    measures = [c for c in partials.columns if c not in keys]
    return partials.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in measures])


def _check(name: str, value, low, high) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")


def search_alerts(
    alerts: DataFrame, now: datetime, domain: str | None = None, severity: str | None = None,
    entity_key: str | None = None, since_minutes: int = 60, limit: int = 100,
) -> DataFrame:
    """Newest alerts that match the given filters."""
    if domain is not None and domain not in DOMAINS:
        raise ValueError(f"domain must be one of {DOMAINS}")
    if severity is not None and severity not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}")
    _check("since_minutes", since_minutes, 1, 10_080)
    _check("limit", limit, 1, 1000)
    found = since(alerts, "ts", timedelta(minutes=since_minutes), now)
    for name, wanted in (("domain", domain), ("severity", severity), ("entity_key", entity_key)):
        if wanted:
            found = found.where(F.col(name) == wanted)
    return found.select(*ALERT_COLUMNS).orderBy(F.desc("ts"), "alert_id").limit(limit)


def rollup_series(rollup: DataFrame, now: datetime, since_hours: int = 6) -> DataFrame:
    """Five-minute series with averages, oldest first."""
    _check("since_hours", since_hours, 1, 168)
    recent = since(rollup, "bucket", timedelta(hours=since_hours), now)
    merged = merge_rollup(recent.drop("ingest_date"), _ROLLUP_KEYS["alerts_5m"])
    return merged.select(
        "bucket", "domain", "severity", "alert_count",
        F.try_divide("sum_anomaly_score", "alert_count").alias("avg_anomaly_score"),
        F.try_divide("sum_latency_ms", "alert_count").alias("avg_latency_ms"),
    ).orderBy("bucket", "domain", "severity")


def cause_breakdown(rollup: DataFrame, now: datetime, since_hours: int = 6) -> DataFrame:
    """Alerts per domain and cause since then, most frequent first."""
    _check("since_hours", since_hours, 1, 168)
    recent = since(rollup, "bucket", timedelta(hours=since_hours), now)
    return recent.groupBy("domain", "probable_cause").agg(F.sum("alert_count").alias("alert_count")).orderBy(
        F.desc("alert_count"), "domain", "probable_cause"
    )


def latest_metrics(metrics: DataFrame) -> DataFrame:
    """Newest metrics row per model; older rows are dropped before the shuffle."""
    w = Window.partitionBy("model_id").orderBy(F.desc("ts"))
    return metrics.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def metrics_history(metrics: DataFrame, model_id: str, now: datetime, since_hours: int = 24) -> DataFrame:
    """One model's metrics, oldest first."""
    _check("since_hours", since_hours, 1, 720)
    recent = since(metrics.where(F.col("model_id") == model_id), "ts", timedelta(hours=since_hours), now)
    return recent.select(
        "ts", "drift_detected", "events_scored", "throughput_eps", "p50_inference_ms", "p99_inference_ms"
    ).orderBy("ts")


def throughput_series(rollup: DataFrame, now: datetime, since_minutes: int = 30) -> DataFrame:
    """Per-minute events, oldest first."""
    _check("since_minutes", since_minutes, 1, 1440)
    recent = since(rollup, "bucket", timedelta(minutes=since_minutes), now)
    return merge_rollup(
        recent.select(*_ROLLUP_KEYS["throughput_1m"], "events"), _ROLLUP_KEYS["throughput_1m"]
    ).orderBy("bucket", "domain", "entity_key")


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), edges: Sequence[float] = LAG_EDGES_MS) -> DataFrame:
    """Cumulative counts per upper edge ``le`` (the last edge is infinity).

    Each row is counted once in its own bucket before the shuffle; the running sum
    is then over at most ``len(edges) + 1`` rows per key.
    """
    bounds = [float(e) for e in edges] + [float("inf")]
    le = F.lit(bounds[-1])
    for edge in reversed(bounds[:-1]):
        le = F.when(F.col(value) <= edge, F.lit(edge)).otherwise(le)
    own = df.where(F.col(value).isNotNull()).groupBy(*keys, le.alias("le")).agg(F.count(F.lit(1)).alias("_n"))
    # Edges nobody fell into still need a row.
    all_edges = own.select(*keys).distinct() if keys else own.select(F.lit(1).alias("_one")).distinct()
    grid = all_edges.withColumn("le", F.explode(F.array(*[F.lit(b) for b in bounds]))).drop("_one")
    filled = grid.join(own, [*keys, "le"], "left")
    w = Window.partitionBy(*keys).orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*keys, "le", F.sum(F.coalesce("_n", F.lit(0))).over(w).cast("long").alias("cumulative"))


def histogram_quantile(cumulative: DataFrame, q: float, keys: Sequence[str] = ()) -> DataFrame:
    """Quantile estimate from cumulative buckets, linear inside a bucket.

    A quantile that falls in the infinite bucket gives the highest finite edge.
    """
    w = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    ranked = cumulative.withColumns({
        "_lower": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
        "_below": F.coalesce(F.lag("cumulative").over(w), F.lit(0)),
        "_rank": F.max("cumulative").over(whole) * F.lit(float(q)),
    })
    inside = F.col("_lower") + (F.col("le") - F.col("_lower")) * F.try_divide(
        F.col("_rank") - F.col("_below"), F.col("cumulative") - F.col("_below")
    )
    estimate = F.when(F.col("le") == float("inf"), F.col("_lower")).otherwise(inside)
    hit = ranked.where((F.col("cumulative") >= F.col("_rank")) & (F.col("cumulative") > 0))
    agg = F.min_by(estimate, "le").alias("quantile")
    return (hit.groupBy(*keys) if keys else hit.groupBy()).agg(agg)


def event_rate(df: DataFrame, ts: str, labels: Sequence[str], now: datetime, seconds: int) -> DataFrame:
    """Rows per second by label over the last ``seconds``."""
    recent = since(df, ts, timedelta(seconds=seconds), now)
    return recent.groupBy(*labels).agg((F.count(F.lit(1)) / F.lit(float(seconds))).alias("per_second"))


def latency_quantiles(alerts: DataFrame, now: datetime, seconds: int) -> DataFrame:
    """Exact p50 / p95 / p99 of alert latency and the row count since then."""
    recent = since(alerts, "ts", timedelta(seconds=seconds), now)
    probs = {"p50": 0.50, "p95": 0.95, "p99": 0.99}
    return exact_quantiles(recent, [], "latency_ingest_to_alert_ms", probs, "linear", count="n", per_power=FINE_BLOCKS)


def stage_throughput(
    raw: DataFrame, features: DataFrame, alerts: DataFrame, now: datetime, seconds: int
) -> DataFrame:
    """Rows per second of each stage since then."""
    parts = []
    for stage, df, ts in (("raw_events", raw, "ts_ingest"), ("features", features, "window_end"),
                          ("alerts", alerts, "ts")):
        recent = since(df, ts, timedelta(seconds=seconds), now)
        parts.append(recent.agg(
            F.lit(stage).alias("stage"), (F.count(F.lit(1)) / F.lit(float(seconds))).alias("per_second")
        ))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pivot_severity(rollup: DataFrame) -> DataFrame:
    """One row per bucket with a zero-filled count per severity and their total."""
    wide = rollup.groupBy("bucket").pivot("severity", list(SEVERITIES)).agg(F.sum("alert_count"))
    counts = [F.coalesce(F.col(s), F.lit(0)).alias(s) for s in SEVERITIES]
    total = sum((F.coalesce(F.col(s), F.lit(0)) for s in SEVERITIES), F.lit(0)).cast("long")
    return wide.select("bucket", *counts, total.alias("total")).orderBy("bucket")


def pivot_domain(rollup: DataFrame) -> DataFrame:
    """One row per bucket with zero-filled events per domain."""
    wide = rollup.groupBy("bucket").pivot("domain", list(DOMAINS)).agg(F.sum("events"))
    return wide.select("bucket", *[F.coalesce(F.col(d), F.lit(0)).alias(d) for d in DOMAINS]).orderBy("bucket")


def causes_total(rollup: DataFrame) -> DataFrame:
    """Alerts per cause over all domains, most frequent first."""
    return rollup.groupBy("probable_cause").agg(F.sum("alert_count").alias("alert_count")).orderBy(
        F.desc("alert_count"), "probable_cause"
    )


def kpis(series: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row of headline numbers from a rollup series and the latest model metrics."""
    rows = series.select(
        "alert_count", F.when(F.col("severity") == "critical", F.col("alert_count")).alias("critical"),
        (F.col("avg_latency_ms") * F.col("alert_count")).alias("weighted"),
    ).unionByName(metrics.select("throughput_eps", "drift_detected"), allowMissingColumns=True)
    total = F.coalesce(F.sum("alert_count"), F.lit(0))
    return rows.agg(
        total.alias("total"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"),
        F.coalesce(F.try_divide(F.sum("weighted"), total), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.sum("throughput_eps"), F.lit(0.0)).alias("throughput_eps"),
        F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("any_drift"),
    )


def backlog(alerts: DataFrame, n: int = 30) -> DataFrame:
    """The newest ``n`` alerts, oldest first."""
    newest = alerts.select(*ALERT_COLUMNS).orderBy(F.desc("ts"), "alert_id").limit(n)
    return newest.orderBy("ts", F.desc("alert_id"))


def entities(events: DataFrame) -> DataFrame:
    """Distinct entities per domain, sorted."""
    return events.select("domain", "entity_key").distinct().orderBy("domain", "entity_key")
