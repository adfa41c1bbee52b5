"""Text lines to events as a stream, with everything that does not get through kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pulsegrid.functions.scratch import drop_batches
from pulsegrid.sources.raw import bad_reason, flatten_raw, parse_raw, stamp_ingest
from pulsegrid.streaming.batches import KEEP, newest_before, start, stored, write_batches


def parse_stream(lines: DataFrame, col: str = "value", strict_ids: bool = True) -> DataFrame:
    """Text lines to wide event rows; malformed lines are dropped. ``stream_events`` keeps them."""
    good, _bad = parse_raw(lines, col, strict_ids)
    return flatten_raw(stamp_ingest(good))


def stream_events(
    lines: DataFrame, path: str, bad_path: str, checkpoint: str, col: str = "value", strict_ids: bool = True,
    now: Column | None = None, available_now: bool = False,
) -> StreamingQuery:
    """Events to ``path/batch=N``, malformed lines with their reason to ``bad_path/batch=N``; neither is written twice."""
    def write(batch: DataFrame, batch_id: int) -> None:
        mine = stored(batch, f"{checkpoint}-lines", batch_id)
        good, bad = parse_raw(mine, col, strict_ids)
        write_batches(bad_path, f"{checkpoint}-bad")(bad.select(F.col(col).alias("line"), bad_reason(F.col(col)).alias("reason")), batch_id)
        write_batches(path, checkpoint)(flatten_raw(stamp_ingest(good, now)), batch_id)

    return start(lines.sparkSession, lines.writeStream.foreachBatch(write), checkpoint, available_now)


def bad_counts(bad: DataFrame) -> DataFrame:
    """Dead letters per reason."""
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


def split_late(
    events: DataFrame, sizes: dict[str, float], path: str, late_path: str, checkpoint: str, delay_seconds: float = 10.0,
    available_now: bool = False,
) -> StreamingQuery:
    """Events in time to ``path/batch=N``; those whose window is closed already to ``late_path/batch=N`` instead of nowhere.

    A window (``sizes``, seconds per domain) is closed when its end is at or before the latest event time of earlier batches
    less ``delay_seconds``, the rule of Spark's watermark; the latest time is kept per batch and domain. Late rows carry
    ``window_start`` so that they can be counted or added to their window later.
    """
    clock_path = f"{checkpoint}-clock"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        mine = stored(batch, f"{checkpoint}-events", batch_id)
        reached = mine.groupBy("domain").agg(F.max("ts_event").alias("reached"))
        before = newest_before(spark, clock_path, batch_id)
        clock = reached.limit(0) if before is None else spark.read.schema(reached.schema).parquet(f"{clock_path}/batch={before}")
        size = F.lit(None).cast("double")
        for domain, seconds in sizes.items():
            size = F.when(F.col("domain") == domain, F.lit(float(seconds))).otherwise(size)
        micros = (size * 1_000_000).cast("long")
        window_start = F.timestamp_micros(F.floor(F.unix_micros("ts_event") / micros).cast("long") * micros)
        closed = F.unix_micros("window_start") + micros <= F.unix_micros("reached") - int(delay_seconds * 1_000_000)
        # The clock is one row per domain.
        timed = mine.withColumn("window_start", window_start).join(F.broadcast(clock), "domain", "left").withColumn(
            "_late", F.coalesce(closed, F.lit(False)))
        write_batches(late_path, f"{checkpoint}-late")(timed.where("_late").drop("_late", "reached"), batch_id)
        write_batches(path, checkpoint)(timed.where("NOT _late").drop("_late", "reached", "window_start"), batch_id)
        newest = clock.unionByName(reached).groupBy("domain").agg(F.max("reached").alias("reached"))
        newest.coalesce(1).write.mode("overwrite").parquet(f"{clock_path}/batch={batch_id}")
        drop_batches(spark, clock_path, batch_id - KEEP + 1)

    return start(events.sparkSession, events.writeStream.foreachBatch(write), checkpoint, available_now)


def late_counts(late: DataFrame) -> DataFrame:
    """Late events per entity and window."""
    return late.groupBy("domain", "entity_key", "window_start").agg(F.count(F.lit(1)).alias("late_events"))
