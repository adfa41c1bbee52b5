"""Ordered scans (running sum, rank, previous row, ...) that survive hot keys.

A plain ``Window.partitionBy(key).orderBy(...)`` puts a whole key in one task.
Here every key is cut into consecutive *blocks*; the window runs inside a block,
and a small per-block table carries the state from earlier blocks forward.
A block column must never decrease along the order columns. It comes either from
the order value itself (``time_block``, ``value_block``: lazy, no extra job) or,
when ties can be heavy, from a range partitioning (``range_blocks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scratch import materialize

BLOCK = "_block"
#: Blocks per power of two: for the many small groups of windows, and for whole domains, whose values may lie close together.
BLOCKS, FINE_BLOCKS = 64, 4096


def value_block(x: Column, per_power: int = BLOCKS) -> Column:
    """Monotone bucket of a double: ``per_power`` buckets per power of two, sign aware.

    Infinities have end blocks of their own; NaN, which sorts last, has the last.
    Never null, so that both sides of the carry join keep the same plan and share
    one exchange.
    """
    infinite = F.abs(x) == float("inf")
    offset = 1100 * per_power  # above 1074 powers, so every positive double maps to a positive block
    scaled = F.floor(F.log2(F.when(infinite | F.isnan(x), None).otherwise(F.abs(x))) * per_power) + F.lit(offset)
    end = F.lit(4 * offset)
    bucket = F.when(F.isnan(x), end + 1).when(infinite, F.when(x > 0, end).otherwise(-end)).when(
        x == 0, F.lit(0)).when(x > 0, scaled).otherwise(-scaled).cast("long")
    return F.coalesce(bucket, F.lit(0).cast("long"))


def time_block(ts: Column, seconds: Column | float) -> Column:
    """Consecutive blocks of ``seconds`` length on a timestamp column."""
    width = F.lit(seconds) if isinstance(seconds, (int, float)) else seconds
    return F.coalesce(F.floor(F.unix_micros(ts) / (width * 1_000_000)).cast("long"), F.lit(0).cast("long"))


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add ``_block`` from a range partitioning on ``keys + order`` and write it out.

    Range bounds come from sampled rows, so a key holding a third of the data is
    spread over a third of the partitions.
    """
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    return materialize(ranged.withColumn(BLOCK, F.spark_partition_id().cast("long")))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    measures: dict[str, tuple[str, Column]],
    block: str = BLOCK,
) -> DataFrame:
    """Add inclusive running values per ``keys`` in ``order`` (ascending).

    ``measures`` maps a new column to ``(kind, value)`` where kind is one of
    ``sum``, ``min``, ``max``, ``last`` (ignores nulls), ``previous`` (value of
    the row before, null for the first row) or ``total`` (sum over the whole key).
    """
    keys, order = list(keys), list(order)
    bkeys = [block, *keys]  # a number first: sorts then rarely compare text
    ordered = Window.partitionBy(*bkeys).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    position = F.struct(*order)
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)

    local, summary, carry, result = {}, [], {}, {}
    for name, (kind, value) in measures.items():
        part, seen = f"_part_{name}", f"_seen_{name}"
        if kind in ("sum", "min", "max"):
            agg = getattr(F, kind)
            local[name] = agg(value).over(upto)
            summary.append(agg(value).alias(part))
            carry[seen] = agg(F.col(part)).over(earlier)
            if kind == "sum":
                result[name] = F.col(name) + F.coalesce(F.col(seen), F.lit(0))
            else:
                result[name] = (F.least if kind == "min" else F.greatest)(F.col(name), F.col(seen))
        elif kind == "last":
            local[name] = F.last(value, ignorenulls=True).over(upto)
            summary.append(F.max_by(value, F.when(value.isNotNull(), position)).alias(part))
            carry[seen] = F.last(F.col(part), ignorenulls=True).over(earlier)
            result[name] = F.coalesce(F.col(name), F.col(seen))
        elif kind == "previous":
            boxed = F.struct(value.alias("v"))
            local[name] = F.lag(boxed).over(ordered)
            summary.append(F.max_by(boxed, position).alias(part))
            carry[seen] = F.last(F.col(part)).over(earlier)
            result[name] = F.coalesce(F.col(name), F.col(seen))["v"]
        elif kind == "total":
            local[name] = F.lit(0)
            summary.append(F.sum(value).alias(part))
            carry[seen] = F.sum(F.col(part)).over(whole)
            result[name] = F.col(seen)
        else:
            raise ValueError(f"unknown running measure {kind!r}")

    carried = df.groupBy(*bkeys).agg(*summary).select(*bkeys, *[c.alias(n) for n, c in carry.items()])
    return (
        df.withColumns(local)
        .join(carried, bkeys)
        .withColumns(result)
        .select(*df.columns, *measures)
    )


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, block: str | None = None
) -> DataFrame:
    """Exact 1-based ``row_number`` per ``keys``; range-partitioned unless ``block`` is given."""
    blocked = df if block else range_blocks(df, keys, order)
    ranked = running(blocked, keys, order, {name: ("sum", F.lit(1).cast("long"))}, block or BLOCK)
    return ranked if block else ranked.drop(BLOCK)


def segments_with_halo(df: DataFrame, position: str, length: int, halo: int) -> DataFrame:
    """Cut sequences numbered by ``position`` (1-based) into segments of ``length``.

    Each segment also receives the ``halo`` rows before it, so a look-back of up
    to ``halo`` rows is exact inside ``(keys, _segment)``. Drop rows where
    ``_halo`` is true afterwards.
    """
    own = F.floor((F.col(position) - 1) / length).cast("long")
    last = F.floor((F.col(position) - 1 + halo) / length).cast("long")
    return df.withColumn("_segment", F.explode(F.sequence(own, last))).withColumn("_halo", F.col("_segment") != own)
