"""Sinks, hand-over folders and counts that streams keep beside their checkpoints."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from pulsegrid.functions.scratch import drop_batches, file_system

#: Hand-over folders and notes kept: Spark repeats no batch but the last.
KEEP = 3


def stored(batch: DataFrame, path: str, batch_id: int) -> DataFrame:
    """A micro-batch written to ``path/batch=N`` and read from there, so that it is computed once; older ones are dropped."""
    spark = batch.sparkSession
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    drop_batches(spark, path, batch_id - KEEP + 1)
    return spark.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}")


def newest_before(spark: SparkSession, path: str, batch_id: int | None = None) -> int | None:
    """The largest finished ``batch=N`` below ``path`` with ``N`` below ``batch_id`` (any, if None)."""
    fs, top = file_system(spark, path)
    if not fs.exists(top):
        return None
    names = [s.getPath().getName().removeprefix("batch=") for s in fs.listStatus(top)]
    numbers = sorted((int(n) for n in names if n.isdigit() and (batch_id is None or int(n) < batch_id)), reverse=True)
    return next((n for n in numbers if fs.exists(top.suffix(f"/batch={n}/_SUCCESS"))), None)


def write_batches(path: str, checkpoint: str | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink whose replays overwrite the same batch folder.

    With the ``checkpoint`` of its stream, finished batches are noted beside it and a replay leaves
    them as they are: a stream that reads the folder would take new files for new rows. Only a
    batch lost between its last file and its note is written again.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        if checkpoint:
            fs, note = file_system(df.sparkSession, f"{checkpoint}-done/batch={batch_id}")
            if fs.exists(note):
                return
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if checkpoint:
            fs.create(note, True).close()
            drop_batches(df.sparkSession, f"{checkpoint}-done", batch_id - KEEP + 1)

    return write


def start(spark: SparkSession, writer, checkpoint: str, available_now: bool) -> StreamingQuery:
    """Start a stream with its counts beside its checkpoint."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")
    counts = BatchCounts(spark, f"{checkpoint}-counts")
    spark.streams.addListener(counts)
    try:
        query = writer.start()
        counts.run_id = str(query.runId)
        _counts[str(query.id)] = counts
        return query
    finally:
        counts.started.set()
        if counts.run_id is None:
            spark.streams.removeListener(counts)


class BatchCounts(StreamingQueryListener):
    """Late and observed counts of one query beside its checkpoint: a small file per batch with the totals up to it.

    Query progress itself only keeps its last records. A batch that is run again, also after a restart, starts from the totals
    of the one before it. Files are written without a Spark job; the last ``KEEP`` stay.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.run_id = spark, path, None
        self.started, self.ended = threading.Event(), threading.Event()
        self.error: Exception | None = None

    def _mine(self, run_id) -> bool:
        self.started.wait()
        return str(run_id) == self.run_id

    def onQueryStarted(self, event) -> None:
        pass  # called before the run id is known

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if not self._mine(progress.runId):
            return
        try:
            counts = {"late_rows": sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)}
            for name, row in progress.observedMetrics.items():
                counts |= {f"{name}.{k}": int(v or 0) for k, v in row.asDict().items()}
            self._add(progress.batchId, counts)
        except Exception as e:  # Spark only logs what a listener raises; readers raise it instead
            self.error = e

    def onQueryTerminated(self, event) -> None:
        if self._mine(event.runId):
            self.spark.streams.removeListener(self)
            self.ended.set()

    def _stored(self) -> list[int]:
        fs, top = file_system(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.removeprefix("batch=").isdigit())

    def totals(self, before: int | None = None) -> dict[str, int]:
        """Totals up to the newest stored batch, or the newest one below ``before``."""
        numbers = [n for n in self._stored() if before is None or n < before]
        if not numbers:
            return {}
        fs, path = file_system(self.spark, f"{self.path}/batch={numbers[-1]}")
        source = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _add(self, batch_id: int, counts: dict[str, int]) -> None:
        old = self.totals(batch_id)
        new = {k: old.get(k, 0) + counts.get(k, 0) for k in {*old, *counts}}
        fs, path = file_system(self.spark, f"{self.path}/batch={batch_id}")
        hidden = path.getParent().suffix(f"/_new-{batch_id}")
        out = fs.create(hidden, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        fs.delete(path, True)
        fs.rename(hidden, path)
        drop_batches(self.spark, self.path, batch_id - KEEP + 1)


_counts: dict[str, BatchCounts] = {}


def batch_counts(query: StreamingQuery, wait: float = 60.0) -> dict[str, int]:
    """Counts of a query of this package summed over all its batches so far, also those before a restart.

    They are complete once the query has ended; its last batches are waited for.
    """
    counts = _counts[str(query.id)]
    if not query.isActive and not counts.ended.wait(wait):
        raise TimeoutError(f"counts of query {query.id} are not written after {wait} s")
    if counts.error:
        raise RuntimeError(f"counts of query {query.id} are incomplete") from counts.error
    return counts.totals()


def observed(df: DataFrame, name: str, col: str = "domain", values: Sequence[str] = ("market", "payments")) -> DataFrame:
    """Count rows, in total and per value of ``col``, while they pass; read them with ``observed_counts``."""
    counts = [F.count(F.when(F.col(col) == v, 1)).alias(v) for v in values]
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *counts)


def observed_counts(query: StreamingQuery, name: str) -> dict[str, int]:
    """Counts of ``observed`` over all batches so far."""
    return {k.removeprefix(f"{name}."): n for k, n in batch_counts(query).items() if k.startswith(f"{name}.")}


def late_rows(query: StreamingQuery) -> int:
    """Rows the watermark dropped so far, over all batches."""
    return batch_counts(query).get("late_rows", 0)


def write_stream(
    df: DataFrame, path: str, checkpoint: str, available_now: bool = False, partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Append a stream to a files table (the hand-off between two stateful steps).

    Spark's file sink keeps a log of committed files, so each batch counts once also after a restart. ``partition_by``
    (``ingest_date``) lets ``since`` prune.
    """
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    return start(df.sparkSession, writer, checkpoint, available_now)
