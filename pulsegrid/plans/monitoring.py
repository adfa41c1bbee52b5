"""Periodic drift check and metrics job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from pulsegrid.operators.drift import drift_check, freeze_baseline, live_vectors, model_metrics


def monitor(
    scored: DataFrame, baseline_path: str, elapsed_s: float, now: Column, model_version: str = "v1",
    timing: str = "inference_ms",
) -> DataFrame:
    """Metrics events of one interval: latest vectors against the frozen baseline.

    ``scored`` holds ``domain, entity_key, window_end, vector`` and a timing column.
    """
    baseline = freeze_baseline(scored, baseline_path)
    checks = drift_check(baseline, live_vectors(scored))
    return model_metrics(scored, checks, elapsed_s, now, model_version, timing)
