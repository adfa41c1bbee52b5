"""Isotonic calibration: pools of adjacent violators block by block, and a curve that is a table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scan import BLOCK, running, value_block
from pulsegrid.functions.scratch import materialize

#: Up to so many pools are merged in one block.
BLOCK_POOLS = 1 << 16
#: Slots of the score range in which scores and segments of the curve meet.
SLOTS = 4096
_POOL = "lo double, hi double, s double, w double, block int"


def pool_violators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge adjacent pools (``lo, hi, s, w`` in order) until their means ``s / w`` rise."""
    kept: list[list[float]] = []
    for batch in batches:
        for lo, hi, s, w in zip(*(batch.column(c).to_pylist() for c in ("lo", "hi", "s", "w")), strict=True):
            while kept and kept[-1][2] * w >= s * kept[-1][3]:
                before = kept.pop()
                lo, s, w = before[0], before[2] + s, before[3] + w
            kept.append([lo, hi, s, w])
    part = TaskContext.get().partitionId()
    for at in range(0, len(kept), 10_000):
        some = kept[at:at + 10_000]
        columns = [pa.array([r[i] for r in some], pa.float64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(some), pa.int32())], ["lo", "hi", "s", "w", "block"])


def isotonic_pools(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Pools of the isotonic fit: score range ``lo`` to ``hi``, sum of labels ``s``, rows ``w``.

    Equal scores are one pool from the start. Pools are merged inside score ranges, in any order the result is the same. While the
    last pool of a range is not below the first one of the next, ranges are dealt anew: other bounds, and fewer of them as
    pools become fewer. Rows without a score take no part.
    """
    x = F.col(score).cast("double")
    pools = df.where(x.isNotNull()).groupBy(x.alias("lo")).agg(
        F.sum(F.col(label).cast("double")).alias("s"), F.count(F.lit(1)).cast("double").alias("w")
    ).select("lo", F.col("lo").alias("hi"), "s", "w")
    ranged, turn = pools.repartitionByRange("lo"), 0
    while True:
        pools = materialize(ranged.sortWithinPartitions("lo").mapInArrow(pool_violators, _POOL))
        # One row per range.
        pool = F.struct("lo", "s", "w")
        ends = sorted(pools.groupBy("block").agg(F.min(pool).alias("a"), F.max(pool).alias("b"), F.count(F.lit(1)).alias("n")).collect())
        if all(x["b"]["s"] * y["a"]["w"] < y["a"]["s"] * x["b"]["w"] for x, y in zip(ends, ends[1:])):
            return pools.drop("block")
        turn += 1
        left = sum(r["n"] for r in ends)
        parts = 1 if left <= BLOCK_POOLS else min(len(ends), -(-left // BLOCK_POOLS)) + 1 + turn % 2
        ranged = pools.drop("block").repartitionByRange(parts, "lo")


def fit_isotonic(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Isotonic calibration as a table of breakpoints ``x``, ``y``: both ends of every pool, its mean clipped to [0, 1]."""
    y = F.least(F.greatest(F.col("s") / F.col("w"), F.lit(0.0)), F.lit(1.0))
    return isotonic_pools(df, score, label).select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("x"), y.alias("y"))


def _slot(x: Column) -> Column:
    return F.least(F.greatest(F.floor(x * SLOTS), F.lit(0)), F.lit(SLOTS - 1)).cast("int")


def calibrate(
    df: DataFrame, curve: DataFrame | None, score: str = "score", out: str = "calibrated", keys: Sequence[str] = ()
) -> DataFrame:
    """Piecewise-linear calibration by a table of breakpoints ``x, y`` (one curve per ``keys``), flat beyond the ends.

    Scores and segments meet in slots of the range 0 to 1 (the end slots take what lies beyond); each score lies in one segment.
    No curve, or one without breakpoints, keeps the score; a null score stays null.
    """
    if curve is None:
        return df.withColumn(out, F.col(score))
    keys = list(keys)
    points = curve.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn(
        BLOCK, value_block(F.col("x")))
    spans = running(points, keys, ["x"], {"_x0": ("previous", F.col("x")), "_y0": ("previous", F.col("y"))}).select(
        *keys, "_x0", "_y0", F.col("x").alias("_x1"), F.col("y").alias("_y1"))
    end = points.groupBy(*keys).agg(F.max(F.struct("x", "y")).alias("p")).where("p is not null").select(
        *keys, F.col("p.x").alias("_x0"), F.col("p.y").alias("_y0"), F.lit(float("inf")).alias("_x1"), F.col("p.y").alias("_y1"))
    segments = spans.unionByName(end).withColumn(
        "_slot", F.explode(F.sequence(F.coalesce(_slot(F.col("_x0")), F.lit(0)), _slot(F.col("_x1")))))
    segments = segments.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    s = F.col("_score")
    meet = (F.col("_at") == F.col("_slot")) & (F.col("_x0").isNull() | (s > F.col("_x0"))) & (s <= F.col("_x1"))
    for k in keys:
        meet &= F.col(k) == F.col(f"_key_{k}")
    scored = df.withColumn("_score", F.col(score).cast("double")).withColumn("_at", _slot(F.col("_score")))
    flat = F.col("_x0").isNull() | (F.col("_x1") == float("inf"))
    line = F.col("_y0") + (F.col("_y1") - F.col("_y0")) * (s - F.col("_x0")) / (F.col("_x1") - F.col("_x0"))
    return scored.join(segments, meet, "left").withColumn(
        "_new", F.coalesce(F.when(flat, F.col("_y1")).otherwise(line), s)).select(
        *[c for c in df.columns if c != out], F.col("_new").alias(out))
