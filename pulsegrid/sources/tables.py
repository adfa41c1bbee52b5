"""Partitioned tables, event sources and alert storage rows."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.scratch import file_system, materialize
from pulsegrid.sources.contracts import DETECTORS, TOP_FEATURES

# Days each table is kept.
RETENTION_DAYS = {"raw_events": 7, "features": 30, "alerts": 365, "model_metrics": 365}
_TIME_COLUMN = {"raw_events": "ts_ingest", "features": "window_end", "alerts": "ts", "model_metrics": "ts"}


def since(df: DataFrame, col: str, interval: timedelta, now: datetime) -> DataFrame:
    """Rows newer than ``now - interval``; also prunes ``ingest_date`` partitions if present.

    A ``now`` without a zone is read in the session's zone, never in the driver's.
    """
    start = _instant(now - interval)
    recent = df.where(F.col(col) > start)
    if "ingest_date" in df.columns:
        recent = recent.where(F.col("ingest_date") >= F.to_date(start))
    return recent


def _instant(at: datetime) -> Column:
    if at.tzinfo is None:
        return F.lit(at.isoformat(sep=" ")).cast("timestamp")
    return F.timestamp_micros(F.lit((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)))


def write_table(df: DataFrame, path: str, table: str, mode: str = "append") -> None:
    """Append to a date-partitioned table, clustered so scans of one entity skip files.

    Rows are spread by date *and* entity hash, so one busy day is not one task;
    Spark's optimizer may split what is still too large.
    """
    ts = _TIME_COLUMN[table]
    dated = df.withColumn("ingest_date", F.to_date(ts))
    keys = [c for c in ("domain", "entity_key") if c in df.columns]
    (
        dated.hint("rebalance", "ingest_date", *keys)
        .sortWithinPartitions("ingest_date", *keys, ts)
        .write.mode(mode).partitionBy("ingest_date").parquet(path)
    )


def retain(df: DataFrame, days: int, today: Column | None = None) -> DataFrame:
    """Keep rows whose ``ingest_date + days`` is still in the future."""
    current = F.current_date() if today is None else today
    return df.where(F.date_add("ingest_date", days) > current)


def expire(spark: SparkSession, path: str, days: int, today: date) -> list[date]:
    """Delete the date folders of a table whose ``ingest_date + days`` is not in the future; returns their dates."""
    old = [d for d in _dates(spark, path) if d + timedelta(days=days) <= today]
    fs, top = file_system(spark, path)
    for d in old:
        fs.delete(top.suffix(f"/ingest_date={d}"), True)
    return old


def compact(spark: SparkSession, path: str, table: str, today: date, most_files: int = 1, file_bytes: int = 1 << 29) -> list[date]:
    """Rewrite past dates that hold more than ``most_files`` files, and more than their bytes need; returns their dates.

    A date is read, written to scratch in files of about ``file_bytes`` and put in place of its folder by one overwrite of that partition.
    Dates that still grow (``today`` on) are left alone. One writer at a time; not for folders with a stream's commit log.
    """
    fs, top = file_system(spark, path)
    done = []
    for d in _dates(spark, path):
        folder = top.suffix(f"/ingest_date={d}")
        files = [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
        needed = max(most_files, -(-sum(s.getLen() for s in files) // file_bytes))
        if d >= today or len(files) <= needed:
            continue
        rows = spark.read.parquet(folder.toString()).withColumn("ingest_date", F.lit(d))
        keys = [c for c in ("domain", "entity_key") if c in rows.columns]
        dealt = rows.repartitionByRange(needed, *keys, _TIME_COLUMN[table]) if needed > 1 else rows.coalesce(1)
        stored = materialize(dealt.sortWithinPartitions(*keys, _TIME_COLUMN[table]))
        stored.coalesce(needed).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "ingest_date").parquet(path)
        done.append(d)
    return done


def _dates(spark: SparkSession, path: str) -> list[date]:
    fs, top = file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return sorted(date.fromisoformat(n.removeprefix("ingest_date=")) for n in names if n.startswith("ingest_date=2"))


def read_events(
    spark: SparkSession, kind: str = "files", *, path: str | None = None, servers: str | None = None,
    topic: str | None = None, files_per_trigger: int = 100,
) -> DataFrame:
    """Streaming text lines of events from files or from a Kafka topic."""
    if kind == "files":
        return (
            spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger)
            .format("text").load(path)
        )
    if kind == "kafka":
        return (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("subscribe", topic)
            .option("startingOffsets", "latest").load()
            .select(F.col("value").cast("string").alias("value"))
        )
    raise ValueError("kind must be 'files' or 'kafka'")


def to_kafka_records(df: DataFrame, key: str = "entity_key") -> DataFrame:
    """Key/value rows for a Kafka sink: JSON value, entity as key."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Start a stream to Kafka (needs the public Kafka connector on the class path)."""
    return (
        to_kafka_records(df).writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers).option("topic", topic)
        .option("kafka.compression.type", "lz4").option("checkpointLocation", checkpoint).start()
    )


def to_alert_table(df: DataFrame) -> DataFrame:
    """Nested alert to its storage row: score map without nulls, features as JSON text."""
    scores = F.map_from_arrays(
        F.array(*[F.lit(d) for d in DETECTORS]), F.array(*[F.col(f"detectors.{d}") for d in DETECTORS])
    )
    return df.select(
        "alert_id", "entity_key", "domain", "ts", "window_end", "anomaly_score", "severity", "action",
        F.map_filter(scores, lambda _, v: v.isNotNull()).alias("detectors"),
        F.col("explanation.probable_cause").alias("probable_cause"),
        F.to_json("explanation.top_features").alias("top_features"),
        "model_version", "drift_flag", "latency_ingest_to_alert_ms",
    )


def from_alert_table(df: DataFrame) -> DataFrame:
    """Storage row back to the nested alert; a missing supervised score becomes null."""
    scores = F.struct(*[F.try_element_at("detectors", F.lit(d)).alias(d) for d in DETECTORS])
    explanation = F.struct(
        F.col("probable_cause"), F.from_json("top_features", TOP_FEATURES).alias("top_features")
    )
    return df.select(
        "alert_id", "entity_key", "domain", "ts", "window_end", "anomaly_score", "severity", "action",
        scores.alias("detectors"), explanation.alias("explanation"),
        "model_version", "drift_flag", "latency_ingest_to_alert_ms",
    )
