from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import at
from checks import catalog
from pulsegrid.operators import booster
from pulsegrid.operators.evaluation import average_precision, ts_folds
from pulsegrid.operators.supervised import (
    as_booster, attributions, fit_boosters, load_model, margins, param_grid, save_model, supervised_score, supervised_scores,
)
from pulsegrid.plans.training import best_points, grid_search, train_supervised

SCHEMA = "domain string, entity_key string, window_end timestamp, vector array<double>, label int"
SMALL = param_grid(depths=(2, 3), steps=(0.2,), children=(1,))


def labelled(spark, n=240, positives=True, domain="payments", seed=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    y = ((x[:, 0] + x[:, 3] > 1.2) if positives else np.zeros(n)).astype(int)
    return spark.createDataFrame(
        [(domain, "e", at(i), x[i].tolist(), int(y[i])) for i in range(n)], SCHEMA)


@pytest.fixture(scope="module")
def trained(spark):
    df = labelled(spark).unionByName(labelled(spark, domain="market", seed=5)).cache()
    return df, train_supervised(df, ["payments", "market"], min_rows=100, grid=SMALL, rounds=30)


def tree(seed=0, depth=4, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    x[:, 4] = rng.integers(0, 3, n)  # ties
    y = ((x[:, 0] * x[:, 1] + x[:, 4] + rng.normal(size=n)) > 1.5).astype(float)
    edges = [np.unique(np.quantile(x[:, f], np.arange(1, 256) / 256)) for f in range(5)]
    held_out = np.arange(n) >= n * 3 // 4
    return x, y, held_out, edges, booster.fit(booster.to_bins(x, edges), y, held_out, edges, depth, 0.3, 1, 12)


def plain_fit(x, y, train, edges, depth, step, min_child, rounds):
    """Trees by trying every edge of every feature in every node."""
    share = y[train].mean()
    base = math.log(share / (1 - share))
    margin = np.full(len(x), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows, level, g=g, h=h):
            mine = rows & train
            worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
            options = [
                (worth(mine & (x[:, f] <= e)) + worth(mine & (x[:, f] > e)) - worth(mine), -f, -e)
                for f in range(x.shape[1]) for e in edges[f]
                if min(h[mine & (x[:, f] <= e)].sum(), h[mine & (x[:, f] > e)].sum()) >= min_child
            ] if level < depth else []
            if not options or max(options)[0] <= 1e-6:
                out = np.zeros(len(x))
                out[rows] = -step * g[mine].sum() / (h[mine].sum() + 1)
                return out
            top = max(o[0] for o in options)
            _, f, e = max(o for o in options if o[0] > top - 1e-9)
            return grow(rows & (x[:, -f] <= -e), level + 1) + grow(rows & (x[:, -f] > -e), level + 1)

        margin = margin + grow(np.ones(len(x), bool), 0)
    return margin


def test_trees_equal_a_plain_fit():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 3)).round(1)
    y = ((x[:, 0] + 0.5 * rng.normal(size=120)) > 0.4).astype(float)
    edges = [np.unique(x[:, f])[:-1] for f in range(3)]
    nobody = np.zeros(120, bool)
    model, rounds, _ = booster.fit(booster.to_bins(x, edges), y, nobody, edges, 3, 0.2, 2, 4)
    assert rounds == 4
    np.testing.assert_allclose(model.margin(x), plain_fit(x, y, ~nobody, edges, 3, 0.2, 2, 4), atol=1e-9)


def test_attributions_equal_the_mean_over_all_orders():
    x, _, _, _, (model, _, _) = tree()

    def expected(node, row, seen):
        f = model.feature[node]
        if f < 0:
            return model.value[node]
        low, high = model.left[node], model.right[node]
        if f in seen:
            return expected(low if row[f] <= model.threshold[node] else high, row, seen)
        return sum(model.cover[k] * expected(k, row, seen) for k in (low, high)) / model.cover[node]

    got = model.attributions(x[:6])
    for row, values in zip(x[:6], got, strict=True):
        worth = {c: model.base + sum(expected(r, row, c) for r in model.roots)
                 for k in range(6) for c in itertools.combinations(range(5), k)}
        for f in range(5):
            share = sum(
                math.factorial(len(c)) * math.factorial(4 - len(c)) / math.factorial(5) * (worth[tuple(sorted((*c, f)))] - v)
                for c, v in worth.items() if f not in c)
            assert values[f] == pytest.approx(share, abs=1e-10)
        assert values[-1] == pytest.approx(worth[()], abs=1e-10)


def test_early_stopping_keeps_the_best_round():
    x, y, held_out, edges, (model, best, score) = tree()
    bins = booster.to_bins(x, edges)
    scores = []
    for rounds in range(1, 13):
        part = booster.fit(bins[~held_out], y[~held_out], np.zeros((~held_out).sum(), bool), edges, 4, 0.3, 1, rounds)[0]
        scores.append(booster.average_precision(part.margin(x[held_out]), y[held_out]))
    assert best == int(np.argmax(scores)) + 1 and score == pytest.approx(max(scores)) and len(model.roots) == best
    patient = booster.fit(bins, y, held_out, edges, 4, 0.3, 1, 12, patience=1)
    drop = next((i for i in range(1, 12) if scores[i] <= max(scores[:i])), 12)
    assert patient[1] == int(np.argmax(scores[:drop])) + 1


def test_average_precision_equals_the_table_version(spark):
    rng = np.random.default_rng(8)
    score, label = rng.integers(0, 20, 300) / 20, rng.integers(0, 2, 300)
    df = spark.createDataFrame(list(zip(score.tolist(), label.tolist())), "score double, label int")
    assert booster.average_precision(score, label) == pytest.approx(average_precision(df).first()[0])


def test_no_model_gives_nulls(spark):
    df = labelled(spark, 5)
    assert supervised_score(df, None).where("xgboost is not null").count() == 0
    assert attributions(df, {}).where("shap is not null").count() == 0
    assert supervised_scores(df.withColumn("domain", F.lit("other")), {"payments": tree()[4][0]}).where("xgboost is not null").count() == 0


def test_scores_are_probabilities_and_rank(trained, spark):
    df, done = trained
    mine = df.where("domain = 'payments'")
    got = supervised_score(mine, done["payments"].model).toPandas()
    assert got["xgboost"].between(0, 1).all() and set(got["domain"]) == {"payments"}
    assert got[got.label == 1]["xgboost"].mean() > got[got.label == 0]["xgboost"].mean() + 0.3
    flat = spark.createDataFrame([(0.0, 0.2), (1.0, 0.2)], "x double, y double")
    assert supervised_score(mine, done["payments"].model, flat).agg(F.min("xgboost"), F.max("xgboost")).first() == (0.2, 0.2)


def test_attributions_add_up_to_the_margin_and_spare_other_rows(trained):
    df, done = trained
    models = {d: t.model for d, t in done.items()}
    got = attributions(margins(df, models), models, where=F.col("label") == 1).toPandas()
    told = got[got["shap"].notna()]
    assert len(told) == (got.label == 1).sum() > 0 and (told.label == 1).all()
    total = np.vstack(told["shap"].to_list()).sum(axis=1) + told["shap_bias"].astype(float)
    np.testing.assert_allclose(total, told["margin"], atol=1e-9)
    assert np.abs(np.vstack(told["shap"].to_list()))[:, [0, 3]].mean() > 0.1


def test_fits_do_not_depend_on_the_partitioning(spark, trained):
    df, _ = trained
    one, many = (fit_boosters(ts_folds(df.repartition(n)), SMALL, rounds=10).orderBy("domain", "fold", "point").collect() for n in (1, 7))
    assert one == many and len(one) == 2 * 3 * len(SMALL)
    assert len(as_booster(one[0]).roots) == one[0]["best_round"]


def test_a_large_domain_is_fitted_on_a_bounded_sample(spark, trained):
    df, _ = trained
    fits = fit_boosters(ts_folds(df), SMALL[:1], rounds=3, fit_rows=120).where("fold = 2").collect()
    assert all(60 <= r["train_rows"] + r["test_rows"] <= 180 for r in fits)


def test_fits_of_all_tasks_equal_those_of_one(spark):
    folds = ts_folds(labelled(spark, 600).unionByName(labelled(spark, 400, domain="market", seed=5)))
    points = [*SMALL, {"max_depth": 1, "step_size": 0.5, "min_child": 5}]

    def fits(df, task_rows):
        found = fit_boosters(df, points, rounds=6, patience=2, task_rows=task_rows)
        return [r.asDict() for r in found.orderBy("domain", "fold", "point").collect()]

    one, some, every = fits(folds, 600), fits(folds.repartition(3), 250), fits(folds.repartition(7), 0)
    real = ("aucpr", "base", "threshold", "value", "cover")
    for a, b, c in zip(one, some, every, strict=True):
        assert b == c or (b["fold"], b["domain"]) == (0, "market")  # 200 rows: one task the first time
        for other in (b, c):
            assert all(a[k] == other[k] for k in a if k not in real)
            assert all(a[k] == pytest.approx(other[k], abs=1e-6) for k in real)


def test_joint_fits_without_positives_have_no_trees(spark):
    fits = fit_boosters(ts_folds(labelled(spark, positives=False)), SMALL, rounds=1, task_rows=0)
    assert fits.count() == 3 * len(SMALL) and fits.where("aucpr is not null or roots is not null").count() == 0


def test_a_large_domain_is_searched_on_all_rows(spark):
    n = 104_000
    x = [F.rand(i) for i in range(8)]
    rows = spark.range(n).select(
        F.lit("payments").alias("domain"), F.lit("e").alias("entity_key"), F.timestamp_seconds("id").alias("window_end"),
        F.array(*x).alias("vector"), (x[0] + x[3] > 1.4).cast("int").alias("label"))
    _best, fits = grid_search(ts_folds(rows), SMALL[:1], rounds=2)
    got = {r["fold"]: (r["train_rows"], r["test_rows"], len(r["roots"]) > 0) for r in fits.collect()}
    assert got == {f: (n * (f + 1) // 4, n // 4, True) for f in range(3)}


def test_grid_has_every_combination():
    assert len(param_grid()) == 18 and param_grid()[0] == {"max_depth": 3, "step_size": 0.05, "min_child": 1}


def test_training_reports_and_skips(spark, trained):
    _, done = trained
    row = done["payments"].report.first()
    curve = done["payments"].calibration.orderBy("x").collect()
    assert done["payments"].model is not None and row["skipped"] is None
    assert (row["train_rows"], row["held_out_rows"]) == (180, 60) and 1 <= row["best_round"] <= 30
    assert row["brier_score_after_calibration"] <= row["brier_score_before_calibration"]
    assert 0 < row["held_out_aucpr"] <= 1 and [r["y"] for r in curve] == sorted(r["y"] for r in curve)
    both = labelled(spark).unionByName(labelled(spark, 400, False, "market"))
    got = {d: t.report.first()["skipped"] for d, t in train_supervised(both, ["payments", "market", "none"], min_rows=300).items()}
    assert got == {"payments": "too few rows", "market": "no positives", "none": "too few rows"}
    late = labelled(spark).withColumn("label", F.when(F.col("window_end") < F.lit(at(100)), F.col("label")).otherwise(0))
    assert train_supervised(late, ["payments"], grid=SMALL, rounds=2)["payments"].report.first()["skipped"] == "no positives in the final split"


def test_search_without_usable_folds_keeps_the_first_choice(spark):
    best, fits = grid_search(ts_folds(labelled(spark, positives=False)), SMALL, rounds=1)
    assert best == {"payments": (0, -1.0)} and fits.where("aucpr is not null or size(roots) > 0").count() == 0


def test_the_first_of_equal_points_wins(spark):
    rows = [("d", 0, 0, 0.5), ("d", 1, 0, None), ("d", 0, 1, 0.75), ("d", 0, 2, 0.75)]
    fits = spark.createDataFrame(rows, "domain string, fold int, point int, aucpr double")
    assert best_points(fits, SMALL) == {"d": (1, 0.75)}


def test_models_are_saved_and_loaded(spark, trained, tmp_path):
    df, done = trained
    path = str(tmp_path)
    assert load_model(spark, path, "payments") == (None, None)
    t = done["payments"]
    assert save_model(spark, path, "payments", done["market"].model) == "v000001"
    assert save_model(spark, path, "payments", t.model, t.calibration) == "v000002"
    (tmp_path / "payments" / "v000009").mkdir()  # a version that was not written to the end
    model, curve = load_model(spark, path, "payments")
    mine = df.where("domain = 'payments'").orderBy("window_end")
    want = supervised_score(mine, t.model, t.calibration).orderBy("window_end").collect()
    assert supervised_score(mine, model, curve).orderBy("window_end").collect() == want
    assert load_model(spark, path, "market") == (None, None)


def test_both_domains_are_searched(spark):
    sf = "/root/testdata/sf0.001"
    rows = catalog._training_rows(spark, sf)
    counts = {r["domain"]: (r["n"], r["p"]) for r in rows.groupBy("domain").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).collect()}
    assert set(counts) == {"market", "payments"} and all(0 < p < n for n, p in counts.values())
    got = catalog.QUERIES["t5_grid_search"](spark, sf).collect()
    assert {r["domain"] for r in got} == {"market", "payments"}
