"""Stateful feature rows to alerts and rollups as streams, with all detectors of the batch chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.functions.expr import squash
from pulsegrid.functions.scratch import drop_batches, file_system, materialize
from pulsegrid.operators.detectors import rolling_detectors
from pulsegrid.operators.drift import drift_check, freeze_baseline
from pulsegrid.operators.refit import BUFFER, FIRST_FIT, REFIT_EVERY, domain_order
from pulsegrid.operators.rollups import ROLLUPS
from pulsegrid.operators.scoring import Tier, build_alerts, drift_asof, latest_alerts
from pulsegrid.operators.sequence import feature_vector
from pulsegrid.plans.pipeline import explain_windows
from pulsegrid.plans.training import Trained
from pulsegrid.streaming.batches import KEEP, newest_before, start, stored, write_batches

#: Vectors of a domain kept for the next micro-batch: a fit may be up to ``REFIT_EVERY - 1`` vectors old and needs ``BUFFER`` before it.
RING = BUFFER + REFIT_EVERY
CHECK_SCHEMA = "domain string, ts timestamp, drift_detected boolean, psi_by_feature map<string,double>, ks_stat_by_feature map<string,double>"
_KEYS = ["domain", "entity_key", "window_end"]


def _numbered_with_ring(vectors: DataFrame, checkpoint: str, batch_id: int) -> DataFrame:
    """New vectors numbered on from the ring before this batch, and the ring: ``is_new`` tells them apart."""
    spark = vectors.sparkSession
    before = newest_before(spark, f"{checkpoint}-ring", batch_id)
    fresh = domain_order(vectors).withColumn("is_new", F.lit(True))
    if before is None:
        return materialize(fresh)
    ring = spark.read.schema(fresh.schema).parquet(f"{checkpoint}-ring/batch={before}")
    last = ring.groupBy("domain").agg(F.max("vector_no").alias("_last"))  # one row per domain
    moved = fresh.join(F.broadcast(last), "domain", "left").withColumn(
        "vector_no", F.col("vector_no") + F.coalesce("_last", F.lit(0))).select(*ring.columns)
    return materialize(ring.unionByName(moved))


def _write_ring(line: DataFrame, checkpoint: str, batch_id: int) -> None:
    newest = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("vector_no")))  # RING rows a task are shuffled
    ring = line.withColumn("_rank", newest).where(F.col("_rank") <= RING).drop("_rank").withColumn("is_new", F.lit(False))
    ring.coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}-ring/batch={batch_id}")
    drop_batches(line.sparkSession, f"{checkpoint}-ring", batch_id - KEEP + 1)


def _freeze(line: DataFrame, baseline_path: str) -> None:
    """Freeze the baseline of domains that have none yet: their first vectors are still in the line then."""
    fs, top = file_system(line.sparkSession, baseline_path)
    waiting = [r["domain"] for r in line.select("domain").distinct().collect() if not fs.exists(top.suffix(f"/domain={r['domain']}"))]
    if waiting:
        freeze_baseline(line.where(F.col("domain").isin(waiting)).where(F.col("vector_no") <= FIRST_FIT), baseline_path)


def read_checks(spark: SparkSession, path: str) -> DataFrame:
    """Drift checks so far; none before the first."""
    try:
        return spark.read.schema(CHECK_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CHECK_SCHEMA)


def check_drift(spark: SparkSession, checkpoint: str, baseline_path: str, checks_path: str, now: Column) -> DataFrame:
    """One periodic check: the latest vectors of the alert stream against the frozen baseline, appended to ``checks_path``.

    The stream flags alerts from ``now`` on by it. Run it from a timer; it reads one small folder of the stream.
    """
    newest = newest_before(spark, f"{checkpoint}-ring")
    if newest is None:
        return spark.createDataFrame([], CHECK_SCHEMA)
    ring = spark.read.parquet(f"{checkpoint}-ring/batch={newest}")
    last = ring.groupBy("domain").agg(F.max("vector_no").alias("_last"))
    live = ring.join(F.broadcast(last), "domain").where(F.col("vector_no") > F.col("_last") - BUFFER)
    checked = drift_check(freeze_baseline(ring.limit(0), baseline_path), live.select("domain", "entity_key", "window_end", "vector"))
    rows = materialize(checked.withColumn("ts", now).select(*[f.split(" ")[0] for f in CHECK_SCHEMA.split(", ")]))
    rows.coalesce(1).write.mode("append").parquet(checks_path)
    return rows


def stream_alerts(
    stated: DataFrame, path: str, checkpoint: str, now: Column, model_version: str = "v1",
    rules: dict[str, list[Tier]] | None = None, available_now: bool = False, models: bool = True,
    supervised: dict[str, Trained] | None = None, checks_path: str | None = None, baseline_path: str | None = None,
) -> StreamingQuery:
    """Score a stateful feature stream with the whole batch chain and write alerts once, also after a restart.

    The rolling detectors fit on a numbered ring of each domain's last ``RING`` vectors, kept per batch id: a repeated batch
    starts from the ring it started from before. Windows must reach the stream in order of their end over batches, as
    ``stream_windows`` writes them; inside a batch they are put in order. ``models``, ``supervised`` are those of ``score_windows``.
    Alerts take their drift flag from the checks at ``checks_path``; ``baseline_path`` freezes each domain's first vectors.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = stored(batch, f"{checkpoint}-stated", batch_id)
        if rows.isEmpty():
            return
        ready = feature_vector(rows).withColumn("zscore_score", squash(F.col("zscore")))
        if models:
            line = _numbered_with_ring(ready.select(*_KEYS, "vector"), checkpoint, batch_id)
            scores = rolling_detectors(line).select(*_KEYS, "isolation_forest", "autoencoder", "base_mean", "base_std")
            ready = ready.join(scores, _KEYS)
        else:
            none = F.lit(None).cast("array<double>")
            ready = ready.withColumns({
                "isolation_forest": F.lit(0.0), "autoencoder": F.lit(0.0), "base_mean": none, "base_std": none})
        alerts = build_alerts(explain_windows(ready, rules, supervised), now, model_version)
        if checks_path:
            alerts = drift_asof(alerts, read_checks(batch.sparkSession, checks_path))
        write_batches(path, checkpoint)(alerts, batch_id)
        if models:
            _write_ring(line, checkpoint, batch_id)
            if baseline_path:
                _freeze(line, baseline_path)

    return start(stated.sparkSession, stated.writeStream.foreachBatch(write), checkpoint, available_now)


#: What makes a row of a rollup's input the same row again.
ONCE = {
    "alerts_5m": ["alert_id"], "throughput_1m": ["domain", "entity_key", "window_end"], "causes_1h": ["alert_id"],
}


def stream_rollup(rows: DataFrame, rollup: str, watermark: str = "10 seconds", once: Sequence[str] | None = None) -> DataFrame:
    """One of the three rollups, each bucket emitted once its watermark has passed.

    A row that comes again within the watermark counts once: alerts by id, windows by key, or the columns ``once``. Rows without
    these columns cannot be told apart and all count, as with ``once=()``.
    """
    ts, width, dims, aggs = ROLLUPS[rollup]
    keys = list(once) if once is not None else [c for c in ONCE[rollup] if set(ONCE[rollup]) <= set(rows.columns)]
    marked = rows.withWatermark(ts, watermark)
    unique = marked.dropDuplicatesWithinWatermark(keys) if keys else marked
    grouped = unique.groupBy(F.window(ts, width), *dims).agg(*aggs())
    return grouped.withColumn("bucket", F.col("window.start")).drop("window")


def upsert_alerts(alerts: DataFrame, path: str) -> list:
    """Merge alerts into a table partitioned by the date of their window; the newest version of each id stays.

    An id belongs to one window and so to one date: only the dates at hand are read and rewritten, each as a whole
    folder. One writer at a time; the same alerts again change nothing. Returns the dates.
    """
    spark = alerts.sparkSession
    dated = materialize(alerts.withColumn("alert_date", F.to_date("window_end")))
    dates = [r["alert_date"] for r in dated.select("alert_date").distinct().collect()]  # as many as the batch has
    if not dates:
        return []
    try:
        old = spark.read.schema(dated.schema).parquet(path).where(F.col("alert_date").isin(dates)).select(*dated.columns)
        dated = materialize(latest_alerts(old.unionByName(dated)))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        dated = latest_alerts(dated)
    dated.hint("rebalance", "alert_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "alert_date").parquet(path)
    return sorted(dates)


def stream_upsert(alerts: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """``upsert_alerts`` for every micro-batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_alerts(stored(batch, f"{checkpoint}-alerts", batch_id), path)

    return start(alerts.sparkSession, alerts.writeStream.foreachBatch(write), checkpoint, available_now)
