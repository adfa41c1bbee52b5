"""Drift of model inputs: PSI, two-sample KS, drift checks and metrics events."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.quantile import exact_quantiles
from pulsegrid.functions.scan import BLOCK, FINE_BLOCKS, running, value_block
from pulsegrid.functions.scratch import publish_once
from pulsegrid.operators.refit import BUFFER, FIRST_FIT
from pulsegrid.operators.sequence import feature_names_of

# Bins, thresholds and the least live rows of a check.
BINS = 10
PSI_LIMIT = 0.2
KS_P_LIMIT = 0.01
MIN_LIVE = 10

_KEYS = ["domain", "feature"]


def long_features(vectors: DataFrame) -> DataFrame:
    """One row per input value: ``domain, feature, value``."""
    pairs = F.arrays_zip(feature_names_of(F.col("domain")).alias("feature"), F.col("vector").alias("value"))
    return vectors.select("domain", F.explode(pairs).alias("p")).select("domain", "p.feature", "p.value")


def baseline_vectors(vectors: DataFrame, n: int = FIRST_FIT) -> DataFrame:
    """The first ``n`` vectors of each domain: what its first fit saw."""
    return _edge_rows(vectors, n, F.col("window_end").asc(), F.col("entity_key").asc())


def live_vectors(vectors: DataFrame, n: int = BUFFER) -> DataFrame:
    """The latest ``n`` vectors of each domain."""
    return _edge_rows(vectors, n, F.col("window_end").desc(), F.col("entity_key").desc())


def _edge_rows(vectors: DataFrame, n: int, *order: Column) -> DataFrame:
    # Spark keeps only n rows per domain in each task before it shuffles.
    rank = F.row_number().over(Window.partitionBy("domain").orderBy(*order))
    return vectors.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def psi(baseline: DataFrame, live: DataFrame, bins: int = BINS) -> DataFrame:
    """Population stability index per (domain, feature) of long-form values.

    Edges are the distinct interpolated quantiles of the baseline; live values
    outside them are ignored; fewer than three edges give 0. Every feature of the baseline has a row.
    """
    probs = {f"q{i}": i / bins for i in range(bins + 1)}
    edges = exact_quantiles(baseline, _KEYS, "value", probs, "linear", per_power=FINE_BLOCKS).select(
        *_KEYS, F.array_distinct(F.array(*probs)).alias("edges")
    )

    counted = _side_counts(baseline, live)
    reached = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    last = F.size("edges")
    slot = F.when((reached == last) & (F.col("value") == F.element_at("edges", -1)), last - 1).otherwise(reached)
    # A bin without rows on either side adds nothing, so only filled bins are kept.
    filled = (
        counted.join(edges, _KEYS)
        .withColumns({"bin": slot, "_edges": last})
        .where((F.col("bin") >= 1) & ((F.col("bin") < F.col("_edges")) | (F.col("_edges") < 3)))
        .groupBy(*_KEYS, "bin").agg(F.sum("b").alias("b"), F.sum("l").alias("l"), F.max("_edges").alias("_edges"))
    )
    whole = Window.partitionBy(*_KEYS)  # at most ``bins`` rows each

    def share(side: str) -> Column:
        return F.col(side) / F.greatest(F.sum(side).over(whole), F.lit(1)) + 1e-6

    parts = filled.withColumns({"_b": share("b"), "_l": share("l")})
    index = F.sum((F.col("_l") - F.col("_b")) * F.log(F.col("_l") / F.col("_b")))
    found = parts.groupBy(*_KEYS).agg(
        F.when(F.max("_edges") < 3, 0.0).otherwise(index).alias("psi")
    )
    return edges.select(*_KEYS).join(found, _KEYS, "left").select(*_KEYS, F.coalesce("psi", F.lit(0.0)).alias("psi"))


def _side_counts(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """Rows per distinct value on each side: ``b`` of the baseline, ``l`` live."""
    tagged = baseline.select(*_KEYS, "value", F.lit(1).alias("b"), F.lit(0).alias("l")).unionByName(
        live.select(*_KEYS, "value", F.lit(0).alias("b"), F.lit(1).alias("l"))
    )
    return tagged.groupBy(*_KEYS, "value").agg(F.sum("b").alias("b"), F.sum("l").alias("l"))


def ks_two_sample(baseline: DataFrame, live: DataFrame, method: str = "exact") -> DataFrame:
    """KS statistic and p-value per (domain, feature) of long-form values.

    ``method`` is ``exact`` (time grows with the product of the sample sizes: for samples
    of a frozen baseline and a live buffer) or ``limit`` (Kolmogorov's law, for any size).

    Both samples are counted per distinct value, then run through value blocks, so
    one feature of a whole table is never sorted in one task.
    """
    counted = _side_counts(baseline, live).withColumn(BLOCK, value_block(F.col("value"), FINE_BLOCKS))
    steps = running(counted, _KEYS, ["value"], {
        "upto_b": ("sum", F.col("b")), "upto_l": ("sum", F.col("l")),
        "n_b": ("total", F.col("b")), "n_l": ("total", F.col("l")),
    })
    gap = F.abs(F.try_divide("upto_b", "n_b") - F.try_divide("upto_l", "n_l"))
    stats = steps.groupBy(*_KEYS).agg(
        F.max(gap).alias("ks_stat"), F.max("n_b").alias("n_b"), F.max("n_l").alias("n_l")
    )
    d, n, m = F.col("ks_stat"), F.col("n_b"), F.col("n_l")
    # One row per feature is left here.
    if method not in ("exact", "limit"):
        raise ValueError(f"unknown method {method!r}")
    return stats.withColumn("ks_pvalue", _exact_pvalues(d, n, m) if method == "exact" else ks_pvalue_limit(d, n, m))


def ks_pvalue_limit(d: Column, n: Column, m: Column) -> Column:
    """Kolmogorov's limiting survival function at ``sqrt(n m / (n + m)) d``.

    The alternating series converges fast for large arguments, its theta-function
    twin for small ones.
    """
    x = F.sqrt(n * m / (n + m)) * d
    large = small = F.lit(0.0)
    for i in range(1, 11):
        large = large + F.lit(2.0 * (-1.0) ** (i - 1)) * F.exp(-2.0 * (i * i) * x * x)
        small = small + F.exp(-((2 * i - 1) ** 2) * F.lit(math.pi**2) / (F.lit(8.0) * x * x))
    small = F.lit(1.0) - F.sqrt(F.lit(2.0 * math.pi)) / x * small
    return F.when(x <= 0, 1.0).when(x < 1.0, small).otherwise(F.least(F.greatest(large, F.lit(0.0)), F.lit(1.0)))


def exact_ks_pvalue(d: float, n: int, m: int) -> float:
    """Chance of a gap of at least ``d`` between samples of ``n`` and ``m`` equal draws.

    Sums lattice paths from (0, 0) to (n, m) that stay inside the gap, one row of
    the lattice at a time, scaled so that all paths weigh one. Rows are kept near
    one and their scale is kept apart, or long lattices would underflow.
    """
    gap = (0.5 + np.floor(d * n * m - 1e-7)) / (n * m)
    across = np.arange(n + 1) / n
    inside, scale = np.where(across > gap, 0.0, 1.0), 0.0
    for step in range(1, m + 1):
        open_cells = np.abs(step / m - across) <= gap
        inside = np.where(open_cells, np.cumsum(np.where(open_cells, step / (step + n) * inside, 0.0)), 0.0)
        peak = inside.max()
        if peak == 0.0:
            return 1.0
        inside, scale = inside / peak, scale + math.log(peak)
    return float(min(max(1.0 - inside[-1] * math.exp(scale), 0.0), 1.0))


@F.pandas_udf(T.DoubleType())
def _exact_pvalues(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([
        exact_ks_pvalue(a, int(b), int(c)) if b > 0 and c > 0 else None for a, b, c in zip(d, n, m)
    ], dtype=float)


def drift_features(baseline: DataFrame, live: DataFrame, min_live: int = MIN_LIVE) -> DataFrame:
    """PSI, KS and p-value per (domain, feature) of two vector frames.

    A domain without a baseline or with fewer than ``min_live`` live rows, also one that has fallen silent, reports
    zeros and a p-value of 1.
    """
    # One row per domain of either side.
    enough = live.groupBy("domain").agg(F.count(F.lit(1)).alias("_live")).join(
        baseline.select("domain").distinct().withColumn("_based", F.lit(True)), "domain", "full"
    ).na.fill(0, ["_live"])
    base, now = long_features(baseline), long_features(live)
    measured = psi(base, now).join(ks_two_sample(base, now), _KEYS, "full")
    valid = F.coalesce("_based", F.lit(False)) & (F.col("_live") >= min_live)
    names = enough.withColumn("feature", F.explode(feature_names_of(F.col("domain"))))
    return names.join(measured, _KEYS, "left").select(
        *_KEYS,
        F.when(valid, F.col("psi")).otherwise(0.0).alias("psi"),
        F.when(valid, F.col("ks_stat")).otherwise(0.0).alias("ks_stat"),
        F.when(valid, F.col("ks_pvalue")).otherwise(1.0).alias("ks_pvalue"),
    )


def drift_check(
    baseline: DataFrame, live: DataFrame, psi_limit: float = PSI_LIMIT, p_limit: float = KS_P_LIMIT,
    min_live: int = MIN_LIVE,
) -> DataFrame:
    """One row per domain: values by feature and whether any feature drifted."""
    per_feature = drift_features(baseline, live, min_live)
    drifted = (F.col("psi") > psi_limit) | (F.col("ks_pvalue") < p_limit)

    def by_feature(col: str) -> Column:  # eight features per domain
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", col))))

    return per_feature.groupBy("domain").agg(
        by_feature("psi").alias("psi_by_feature"),
        by_feature("ks_stat").alias("ks_stat_by_feature"),
        F.bool_or(drifted).alias("drift_detected"),
    )


def model_metrics(
    scored: DataFrame, drift: DataFrame, elapsed_s: float, ts: Column, model_version: str = "v1",
    timing: str = "inference_ms",
) -> DataFrame:
    """Metrics event per domain from scored windows with a timing column.

    Quality columns stay null: they need labels, which a live check has not.
    """
    elapsed = max(elapsed_s, 1e-6)
    probs = {"p50_inference_ms": 0.50, "p99_inference_ms": 0.99}
    times = exact_quantiles(scored, ["domain"], timing, probs, "floor", per_power=FINE_BLOCKS)
    counts = scored.groupBy("domain").agg(F.count(F.lit(1)).alias("events_scored"))
    none = F.lit(None).cast("double")
    return drift.join(counts, "domain", "left").join(times, "domain", "left").select(
        F.concat(F.lit("ensemble-"), "domain").alias("model_id"),
        F.lit(model_version).alias("model_version"),
        ts.alias("ts"),
        F.lit(float(elapsed)).alias("eval_window_s"),
        *[none.alias(n) for n in ("precision", "recall", "f1", "false_positive_rate")],
        "psi_by_feature", "ks_stat_by_feature", "drift_detected",
        F.coalesce("events_scored", F.lit(0)).alias("events_scored"),
        (F.coalesce("events_scored", F.lit(0)) / F.lit(float(elapsed))).alias("throughput_eps"),
        F.coalesce("p50_inference_ms", F.lit(0.0)).alias("p50_inference_ms"),
        F.coalesce("p99_inference_ms", F.lit(0.0)).alias("p99_inference_ms"),
    )


def freeze_baseline(vectors: DataFrame, path: str, n: int = FIRST_FIT) -> DataFrame:
    """The saved baseline of each domain; domains that have none yet get their first ``n`` vectors.

    A stored baseline never moves: drift against a refreshed one could not be seen.
    Each domain has a folder of its own that is written once: of two runs at the same time one writes, the other takes what it finds.
    """
    spark = vectors.sparkSession
    slim = vectors.select("domain", "entity_key", "window_end", "vector")

    def stored() -> DataFrame:
        try:
            return spark.read.schema(slim.schema).parquet(path).select(*slim.columns)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return slim.limit(0)

    # Few rows: at most n per domain, and a domain counts once its buffer is full.
    full = Window.partitionBy("domain")
    fresh = baseline_vectors(slim.join(stored().select("domain").distinct(), "domain", "left_anti"), n)
    fresh = fresh.withColumn("_n", F.count(F.lit(1)).over(full)).where(F.col("_n") == n).drop("_n")
    for row in fresh.select("domain").distinct().collect():
        mine = fresh.where(F.col("domain") == row["domain"]).drop("domain").coalesce(1)
        publish_once(mine, f"{path.rstrip('/')}/domain={row['domain']}")
    return stored()
