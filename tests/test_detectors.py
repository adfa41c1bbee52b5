from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from builders import at
from pulsegrid.operators.detectors import (
    isolation_scores, reconstruction_scores, rolling_detectors, rolling_iforest, rolling_pca_error, standardize,
)
from pulsegrid.operators.refit import domain_order, refit_epochs, refit_groups


def vectors(spark, n, domain="market", seed=0, outliers=()):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    for i in outliers:
        x[i] = 12.0
    rows = [(domain, f"e{i % 3}", at(i // 3), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "domain string, entity_key string, window_end timestamp, vector array<double>"), x


def epochs_loop(n, first=60, every=50, buffer=500):
    """A rolling buffer, one vector at a time: epoch and training range of each."""
    out, kept, since, epoch, span = [], [], 0, -1, None
    for i in range(1, n + 1):
        kept = (kept + [i])[-buffer:]
        since += 1
        if len(kept) >= first and (epoch < 0 or since >= every):
            epoch, since, span = epoch + 1, 0, (kept[0], kept[-1])
        out.append((epoch if epoch >= 0 else None, span))
    return out


def test_refit_schedule_matches_a_rolling_buffer(spark):
    df, _ = vectors(spark, 700)
    got = refit_epochs(domain_order(df)).orderBy("vector_no").collect()
    for row, (epoch, span) in zip(got, epochs_loop(700)):
        assert row["epoch"] == epoch
        assert (row["train_from"], row["train_to"]) == (span or (None, None))


def test_refit_groups_hold_the_buffer_of_each_epoch(spark):
    df, _ = vectors(spark, 700)
    got = refit_groups(domain_order(df)).toPandas()
    for epoch, part in got[got["role"] == "train"].groupby("epoch"):
        last = 60 + 50 * epoch
        assert sorted(part["vector_no"]) == list(range(max(last - 500, 0) + 1, last + 1))
    scored = got[got["role"] == "score"]
    assert sorted(scored["vector_no"]) == list(range(60, 701))
    assert got.groupby(["domain", "epoch"]).size().max() <= 550


def test_too_few_vectors_score_zero(spark):
    df, _ = vectors(spark, 59)
    got = rolling_detectors(df).toPandas()
    assert len(got) == 59 and (got["isolation_forest"] == 0).all() and (got["autoencoder"] == 0).all()
    assert got["base_mean"].isna().all()


def test_forest_flags_outliers_and_repeats(spark):
    df, _ = vectors(spark, 200, outliers=(150, 180))
    first = rolling_iforest(df, trees=50).toPandas().sort_values("vector_no", ignore_index=True)
    again = rolling_iforest(df, trees=50).toPandas().sort_values("vector_no", ignore_index=True)
    pd.testing.assert_series_equal(first["isolation_forest"], again["isolation_forest"])
    score = first["isolation_forest"]
    assert (score[:59] == 0).all() and score[59:].between(0, 1).all()
    assert score[[150, 180]].min() > score.drop([150, 180])[59:].quantile(0.95)


def test_reconstruction_matches_numpy_per_epoch(spark):
    df, x = vectors(spark, 220, outliers=(200,))
    order = sorted(range(220), key=lambda i: (i // 3, i % 3))
    ordered = x[order]
    got = rolling_pca_error(df).toPandas().sort_values("vector_no", ignore_index=True)["autoencoder"].to_numpy()
    for no in (60, 61, 109, 110, 200, 201, 220):
        last = 60 + 50 * ((no - 60) // 50)
        train = ordered[max(last - 500, 0):last]
        mean, std = train.mean(0), train.std(0)
        z, p = (train - mean) / std, (ordered[no - 1] - mean) / std
        _, _, axes = np.linalg.svd(z, full_matrices=False)
        keep = axes[:3]
        fit = np.mean((z - z @ keep.T @ keep) ** 2, axis=1)
        err = np.mean((p - p @ keep.T @ keep) ** 2)
        want = 1 / (1 + np.exp(-1.5 * (err - fit.mean()) / max(fit.std(), 1e-6)))
        assert got[no - 1] == pytest.approx(want, abs=1e-9)


def test_baseline_travels_with_the_row(spark):
    df, x = vectors(spark, 120)
    row = rolling_detectors(df, trees=5).where("vector_no = 60").first()
    np.testing.assert_allclose(row["base_mean"], x[:60].mean(0))
    np.testing.assert_allclose(row["base_std"], x[:60].std(0))


def test_forest_offset_puts_the_contaminated_share_above_half():
    x = np.random.default_rng(6).normal(size=(400, 8))
    assert (isolation_scores(x, x, 1) > 0.5).mean() == pytest.approx(0.05, abs=0.01)


def test_constant_columns_do_not_break_the_models():
    x = np.zeros((100, 8))
    x[:, 0] = np.arange(100)
    assert standardize(x)[1][1] == 1.0
    assert np.isfinite(isolation_scores(x, x, 1, trees=10)).all()
    assert np.isfinite(reconstruction_scores(x, x)).all()
    assert np.isfinite(isolation_scores(np.ones((60, 8)), np.ones((2, 8)), 1, trees=10)).all()
