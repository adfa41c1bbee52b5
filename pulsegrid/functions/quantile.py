"""Exact grouped quantiles without collecting a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scan import BLOCK, BLOCKS, running, value_block


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], kind: str = "nearest",
    count: str | None = None, weight: Column | None = None, per_power: int = BLOCKS,
) -> DataFrame:
    """One row per ``keys`` with the quantiles named in ``probs``.

    ``kind``: ``nearest`` takes sorted[round((n-1)p)] (half away from zero),
    ``floor`` takes sorted[min(floor(n p), n-1)], ``linear`` interpolates.
    ``count`` names an extra column with the number of values; ``weight`` says how
    many values a row stands for. ``per_power`` is the fineness of ``value_block``.
    Equal values are counted before the shuffle, then ranked block by block.
    """
    keys = list(keys)
    histogram = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
        .withColumn(BLOCK, value_block(F.col("_value"), per_power))
    )
    ranked = running(
        histogram, keys, ["_value"], {"_upto": ("sum", F.col("_n")), "_total": ("total", F.col("_n"))}
    )

    def at(rank):
        return F.min(F.when(F.col("_upto") > rank, F.col("_value")))

    last = F.col("_total") - 1
    aggs, final = [], []
    for name, p in probs.items():
        if kind == "nearest":
            aggs.append(at(F.floor(last * F.lit(float(p)) + 0.5)).alias(name))
            final.append(F.col(name))
        elif kind == "floor":
            aggs.append(at(F.least(F.floor(F.col("_total") * F.lit(float(p))), last)).alias(name))
            final.append(F.col(name))
        elif kind == "linear":
            spot = last * F.lit(float(p))
            aggs += [
                at(F.floor(spot)).alias(f"_lo_{name}"),
                at(F.ceil(spot)).alias(f"_hi_{name}"),
                F.max(spot - F.floor(spot)).alias(f"_frac_{name}"),
            ]
            lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            final.append((lo + (hi - lo) * F.col(f"_frac_{name}")).alias(name))
        else:
            raise ValueError(f"unknown quantile kind {kind!r}")
    if count:
        aggs.append(F.coalesce(F.max("_total"), F.lit(0)).alias(count))
        final.append(F.col(count))
    grouped = ranked.groupBy(*keys) if keys else ranked.groupBy()
    return grouped.agg(*aggs).select(*keys, *final)
