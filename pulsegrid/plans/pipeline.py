"""From raw events to scored windows and alerts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.expr import squash
from pulsegrid.operators.detectors import rolling_detectors
from pulsegrid.operators.ewma import ewma_zscore
from pulsegrid.operators.scoring import (
    Tier, apply_rules, build_alerts, drift_asof, ensemble, probable_cause, top_features,
)
from pulsegrid.operators.sequence import cusum, feature_vector, run_rules, velocity
from pulsegrid.operators.supervised import attributions, supervised_scores
from pulsegrid.operators.windows import window_features
from pulsegrid.plans.training import Trained


def feature_table(events: DataFrame, sizes: dict[str, float] | None = None, origin: str = "epoch") -> DataFrame:
    """Raw wide events to feature rows with z-score and velocity."""
    return ewma_zscore(velocity(window_features(events, sizes, origin)))


def statistical_scores(features: DataFrame) -> DataFrame:
    """Add the three detectors that need no training."""
    scored = cusum(run_rules(features))
    return scored.withColumn("zscore_score", squash(F.col("zscore")))


def score_windows(
    features: DataFrame, rules: dict[str, list[Tier]] | None = None, models: bool = True,
    supervised: dict[str, Trained] | None = None,
) -> DataFrame:
    """Score every window: detectors, ensemble, rules, explanation.

    ``models=False`` leaves the rolling detectors at their value before a first
    fit (0). ``supervised`` maps a domain to what ``train_supervised`` made of it; a domain without a model keeps null scores. Attributions are computed for windows that reach a rule tier only.
    """
    scored = feature_vector(statistical_scores(features))
    if models:
        scored = rolling_detectors(scored)
    else:
        scored = scored.withColumns({
            "isolation_forest": F.lit(0.0), "autoencoder": F.lit(0.0),
            "base_mean": F.lit(None).cast("array<double>"), "base_std": F.lit(None).cast("array<double>"),
        })
    return explain_windows(scored, rules, supervised)


def explain_windows(
    scored: DataFrame, rules: dict[str, list[Tier]] | None = None, supervised: dict[str, Trained] | None = None
) -> DataFrame:
    """Windows with all detector scores to ensemble, rules, attributions and cause; nothing here needs another window."""
    boosters = {d: m.model for d, m in (supervised or {}).items() if m.model is not None}
    curves = [m.calibration.select(F.lit(d).alias("domain"), "x", "y") for d, m in (supervised or {}).items() if m.calibration is not None]
    scored = supervised_scores(scored, boosters, functools.reduce(DataFrame.unionByName, curves) if curves else None)
    ruled = apply_rules(ensemble(scored), rules)
    explained = attributions(ruled, boosters, where=F.col("severity").isNotNull()).drop("shap_bias")
    return probable_cause(top_features(explained))


def score_pipeline(
    features: DataFrame, now: Column, model_version: str = "v1", rules: dict[str, list[Tier]] | None = None,
    models: bool = True, supervised: dict[str, Trained] | None = None, drift_checks: DataFrame | None = None,
) -> DataFrame:
    """Feature rows to nested alerts."""
    alerts = build_alerts(score_windows(features, rules, models, supervised), now, model_version)
    return alerts if drift_checks is None else drift_asof(alerts, drift_checks)
