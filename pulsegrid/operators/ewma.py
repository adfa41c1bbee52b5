"""Exponentially weighted baseline and z-score per entity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pulsegrid.functions.scan import segments_with_halo
from pulsegrid.operators.windows import with_sequence

# Smoothing factor and variance floor.
ALPHA = 0.1
MIN_VARIANCE = 1e-9

_SEGMENT = 16384
_FORGOTTEN = 1e-60  # weight of state older than the halo


def ewma_columns(x: pd.Series, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-update mean, floored pre-update variance and z-score of an ordered series."""
    value = x.to_numpy(dtype=float)
    mean_after = x.astype(float).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    mean = np.concatenate([value[:1], mean_after[:-1]])
    delta = value - mean
    spread = pd.Series((1.0 - alpha) * delta * delta)
    var_after = spread.ewm(alpha=alpha, adjust=False).mean().to_numpy()
    var = np.maximum(np.concatenate([[0.0], var_after[:-1]]), MIN_VARIANCE)
    z = delta / np.sqrt(var)
    return mean, var, z


def ewma_carried(
    x: pd.Series, alpha: float, start: tuple[float, float] | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[float, float]]:
    """As ``ewma_columns`` with the variance not floored, going on from ``start``; also mean and variance after the last value.

    Both recurrences are linear filters, so carried state is one more value in front of the series.
    """
    value = x.to_numpy(dtype=float)
    begin = (value[0], 0.0) if start is None else start
    mean = pd.Series(np.concatenate([[begin[0]], value])).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    delta = value - mean[:-1]
    spread = np.concatenate([[begin[1]], (1.0 - alpha) * delta * delta])
    var = pd.Series(spread).ewm(alpha=alpha, adjust=False).mean().to_numpy()
    z = delta / np.sqrt(np.maximum(var[:-1], MIN_VARIANCE))
    return mean[:-1], var[:-1], z, (float(mean[-1]), float(var[-1]))


def ewma_zscore(features: DataFrame, alpha: float = ALPHA, segment: int = _SEGMENT) -> DataFrame:
    """Add ``ewma_mean``, ``ewma_var`` and ``zscore`` of ``primary_metric``.

    Sequences are cut into segments that start with enough earlier windows for the
    state before them to weigh less than 1e-60, which a double cannot show; an
    entity of any length is therefore spread over many bounded groups.
    """
    halo = math.ceil(math.log(_FORGOTTEN) / math.log(1.0 - alpha))
    segment = max(segment, 4 * halo)
    numbered = features if "window_no" in features.columns else with_sequence(features)
    cut = segments_with_halo(numbered, "window_no", segment, halo)
    out = [f for f in numbered.schema.fields] + [
        T.StructField(n, T.DoubleType()) for n in ("ewma_mean", "ewma_var", "zscore")
    ]
    names = [f.name for f in out]

    def per_segment(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("window_no", ignore_index=True)
        mean, var, z = ewma_columns(pdf["primary_metric"], alpha)
        if pdf["window_no"].iloc[0] == 1:  # nothing to compare the first window with
            var[0], z[0] = 0.0, 0.0
        pdf["ewma_mean"], pdf["ewma_var"], pdf["zscore"] = mean, var, z
        return pdf.loc[~pdf["_halo"], names]

    return cut.groupBy("domain", "entity_key", "_segment").applyInPandas(per_segment, T.StructType(out))
