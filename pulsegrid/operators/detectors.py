"""Rolling model detectors, refitted per (domain, epoch) group."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators.refit import BUFFER, FIRST_FIT, REFIT_EVERY, domain_order, refit_groups

# Fixed values of the two detectors.
TREES = 100
CONTAMINATION = 0.05
SEED = 42
SUBSAMPLE = 256
FOREST_SLOPE = 6.0
COMPONENTS = 3
RECONSTRUCTION_SLOPE = 1.5
_EULER = 0.5772156649015329


def standardize(train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation per column; a constant column gets deviation 1."""
    mean, std = train.mean(axis=0), train.std(axis=0)
    return mean, np.where(std < 1e-9, 1.0, std)


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    harmonic = 2.0 * (np.log(np.maximum(n - 1.0, 1.0)) + _EULER) - 2.0 * (n - 1.0) / np.maximum(n, 1.0)
    return np.where(n > 2, harmonic, np.where(n == 2, 1.0, 0.0))


def isolation_depths(train: np.ndarray, probe: np.ndarray, trees: int, rng: np.random.Generator) -> np.ndarray:
    """Mean isolation depth of each probe row over random trees grown on ``train``.

    All trees grow together, level by level; probe rows walk down with the tree's
    own subsample, so no tree structure has to be kept.
    """
    size = min(SUBSAMPLE, len(train))
    limit = int(np.ceil(np.log2(max(size, 2))))
    chosen = rng.random((trees, len(train))).argsort(axis=1)[:, :size]
    points, tree = train[chosen.ravel()], np.repeat(np.arange(trees), size)
    row, walker = np.tile(np.arange(len(probe)), trees), np.repeat(np.arange(trees), len(probe))
    node, spot = np.zeros(len(points), dtype=np.int64), np.zeros(len(row), dtype=np.int64)
    total = np.zeros(len(probe))
    for depth in range(limit + 1):
        # Number the nodes that still hold points; a split leaves points on both sides.
        cells, cell = np.unique((tree << depth) + node, return_inverse=True)
        at = np.searchsorted(cells, (walker << depth) + spot)
        order = np.argsort(cell, kind="stable")
        starts = np.searchsorted(cell[order], np.arange(len(cells)))
        low = np.minimum.reduceat(points[order], starts)
        high = np.maximum.reduceat(points[order], starts)
        count = np.bincount(cell)
        varies = high > low
        closed = ~varies.any(axis=1) | (depth == limit)
        done = closed[at]
        total += np.bincount(row[done], depth + _average_path(count[at[done]]), len(probe))
        if closed.all():
            break
        feature = np.where(varies, rng.random(varies.shape), -1.0).argmax(axis=1)
        span = np.arange(len(cells))
        base = low[span, feature]
        cut = base + rng.random(len(cells)) * (high[span, feature] - base)
        keep = ~closed[cell]
        points, tree, node, cell = points[keep], tree[keep], node[keep], cell[keep]
        node = 2 * node + (points[np.arange(len(cell)), feature[cell]] > cut[cell])
        row, walker, spot, at = row[~done], walker[~done], spot[~done], at[~done]
        spot = 2 * spot + (probe[row, feature[at]] > cut[at])
    return total / trees


def isolation_scores(
    train: np.ndarray, probe: np.ndarray, seed: int, trees: int = TREES, contamination: float = CONTAMINATION
) -> np.ndarray:
    """Scores in (0, 1); the training set's contamination quantile sits at 0.5."""
    mean, std = standardize(train)
    both = np.vstack([(train - mean) / std, (probe - mean) / std])
    depth = isolation_depths(both[: len(train)], both, trees, np.random.default_rng(seed))
    normality = -np.power(2.0, -depth / _average_path(np.array(min(SUBSAMPLE, len(train)))))
    offset = np.quantile(normality[: len(train)], contamination)
    return 1.0 / (1.0 + np.exp(-FOREST_SLOPE * (offset - normality[len(train):])))


def reconstruction_scores(train: np.ndarray, probe: np.ndarray, k: int = COMPONENTS) -> np.ndarray:
    """Scores in (0, 1) from the error left after projecting on ``k`` principal axes."""
    mean, std = standardize(train)
    z, p = (train - mean) / std, (probe - mean) / std
    axes = np.linalg.eigh(z.T @ z / len(z))[1][:, -k:]

    def error(x: np.ndarray) -> np.ndarray:
        return np.mean((x - x @ axes @ axes.T) ** 2, axis=1)

    fitted = error(z)
    standard = (error(p) - fitted.mean()) / max(fitted.std(), 1e-6)
    return 1.0 / (1.0 + np.exp(-RECONSTRUCTION_SLOPE * standard))


def _per_epoch(groups: DataFrame, scorers: dict[str, Callable], with_baseline: bool) -> DataFrame:
    names = list(scorers)
    schema = "domain string, vector_no long, epoch long, " + ", ".join(f"{n} double" for n in names)
    if with_baseline:
        schema += ", base_mean array<double>, base_std array<double>"

    def fit_and_score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        domain, epoch = key
        pdf = pdf.sort_values("vector_no")
        probes = pdf[pdf["role"] == "score"]
        train = np.vstack(pdf.loc[pdf["role"] == "train", "vector"].to_list())
        out = pd.DataFrame({"domain": domain, "vector_no": probes["vector_no"].to_numpy(), "epoch": epoch})
        if len(out):
            probe = np.vstack(probes["vector"].to_list())
            for name, scorer in scorers.items():
                out[name] = scorer(train, probe, zlib.crc32(f"{domain}/{epoch}".encode()))
        else:
            out[names] = 0.0
        if with_baseline:
            mean, std = standardize(train)
            out["base_mean"] = [mean.tolist()] * len(out)
            out["base_std"] = [std.tolist()] * len(out)
        return out

    slim = groups.select("domain", "epoch", "role", "vector_no", "vector")
    # A fixed partition count keeps small, compute-heavy groups from being coalesced.
    width = int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = slim.repartition(width, "domain", "epoch")
    return spread.groupBy("domain", "epoch").applyInPandas(fit_and_score, schema)


def _score(vectors: DataFrame, scorers: dict[str, Callable], first: int, every: int, buffer: int,
           with_baseline: bool = False) -> DataFrame:
    ordered = vectors if "vector_no" in vectors.columns else domain_order(vectors)
    scores = _per_epoch(refit_groups(ordered, first, every, buffer), scorers, with_baseline)
    keep = [c for c in ordered.columns if c not in scorers and c != "is_new"]
    asked = ordered.where("is_new") if "is_new" in ordered.columns else ordered
    return asked.select(*keep).join(scores.drop("epoch"), ["domain", "vector_no"], "left").withColumns(
        {n: F.coalesce(n, F.lit(0.0)) for n in scorers}  # 0 until the first fit
    )


def rolling_iforest(
    vectors: DataFrame, buffer: int = BUFFER, first: int = FIRST_FIT, every: int = REFIT_EVERY,
    trees: int = TREES, contamination: float = CONTAMINATION, seed: int = SEED,
) -> DataFrame:
    """Add ``isolation_forest``: forest refitted every ``every`` vectors of a domain."""
    def scorer(train, probe, salt):
        return isolation_scores(train, probe, seed + salt, trees, contamination)

    return _score(vectors, {"isolation_forest": scorer}, first, every, buffer)


def rolling_pca_error(
    vectors: DataFrame, k: int = COMPONENTS, buffer: int = BUFFER, first: int = FIRST_FIT, every: int = REFIT_EVERY
) -> DataFrame:
    """Add ``autoencoder``: linear reconstruction error, refitted like the forest."""
    def scorer(train, probe, salt):
        return reconstruction_scores(train, probe, k)

    return _score(vectors, {"autoencoder": scorer}, first, every, buffer)


def rolling_detectors(
    vectors: DataFrame, buffer: int = BUFFER, first: int = FIRST_FIT, every: int = REFIT_EVERY,
    trees: int = TREES, seed: int = SEED,
) -> DataFrame:
    """Both rolling scores and each row's fit baseline (``base_mean``, ``base_std``) in one pass.

    Rows that are numbered already and marked ``is_new = false`` train only.
    """
    def forest(train, probe, salt):
        return isolation_scores(train, probe, seed + salt, trees)

    def linear(train, probe, salt):
        return reconstruction_scores(train, probe)

    return _score(vectors, {"isolation_forest": forest, "autoencoder": linear}, first, every, buffer, True)
