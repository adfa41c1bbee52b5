from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from builders import at, events, rows_by, txn
from pulsegrid.operators.evaluation import (
    average_precision, brier, confusion, confusion_by, episodes, evaluation_report, label_windows_any,
    label_windows_first, mark_alerted, mean_delay, ts_folds,
)
from pulsegrid.operators import calibration
from pulsegrid.operators.calibration import calibrate, fit_isotonic

SCHEMA = ("entity_key string, domain string, window_start timestamp, window_end timestamp, window_size_s double, "
          "scenario_label string, alerted boolean")


def windows(spark, *rows, step=2.0):
    return spark.createDataFrame(
        [(e, "market", at(i * step), at((i + 1) * step), step, label, hit) for e, i, label, hit in rows], SCHEMA)


def test_confusion_quadrants(spark):
    df = windows(spark, ("e1", 0, "volatility_spike", True), ("e1", 1, "volatility_spike", False),
                 ("e1", 2, None, True), ("e1", 3, "", False))
    row = confusion(df).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 1, 1, 1)
    assert row["precision"] == row["recall"] == row["f1"] == row["false_positive_rate"] == 0.5


def test_empty_denominators_are_null(spark):
    row = confusion(windows(spark, ("e1", 0, None, False))).first()
    assert row["precision"] is None and row["recall"] is None and row["f1"] is None
    assert row["false_positive_rate"] == 0.0


def test_confusion_by_label(spark):
    df = windows(spark, ("e1", 0, "fraud_pattern", True), ("e1", 1, "fraud_pattern", False),
                 ("e2", 0, "latency_incident", True), ("e2", 1, None, True))
    got = {r["scenario_label"]: r["recall"] for r in confusion_by(df).collect()}
    assert got == {"fraud_pattern": 0.5, "latency_incident": 1.0}


def test_touching_windows_make_one_episode(spark):
    df = windows(spark, ("e1", 0, "regime_change", False), ("e1", 1, "regime_change", True),
                 ("e1", 2, "regime_change", False), ("e1", 3, None, False))
    (ep,) = episodes(df).collect()
    assert (ep["start"], ep["end"], ep["detected_at"]) == (at(0), at(6), at(4))


def test_gaps_labels_and_entities_split_episodes(spark):
    df = windows(
        spark, ("e1", 0, "volume_spike", False), ("e1", 1, None, False), ("e1", 2, "volume_spike", True),
        ("e1", 4, "volume_spike", False), ("e1", 5, "fraud_pattern", False), ("e2", 0, "volume_spike", True))
    got = rows_by(episodes(df), "entity_key", "start")
    assert list(got["scenario_label"]) == ["volume_spike"] * 3 + ["fraud_pattern", "volume_spike"]
    assert list(got["detected_at"].notna()) == [False, True, False, False, True]


def test_mean_delay_and_report(spark):
    df = windows(spark, ("e1", 0, "fraud_pattern", False), ("e1", 1, "fraud_pattern", True),
                 ("e2", 0, "fraud_pattern", True), ("e3", 0, "data_corruption", False))
    assert {r[0]: r[1] for r in mean_delay(episodes(df)).collect()} == {"fraud_pattern": 3.0}
    report = {r["scenario_label"]: r for r in evaluation_report(df).collect()}
    fraud, missed = report["fraud_pattern"], report["data_corruption"]
    assert (fraud["episodes"], fraud["episodes_detected"], fraud["episode_detection_rate"]) == (2, 2, 1.0)
    assert fraud["window_recall"] == pytest.approx(2 / 3) and fraud["mean_detection_delay_s"] == 3.0
    assert missed["episode_detection_rate"] == 0.0 and missed["mean_detection_delay_s"] is None


@pytest.mark.parametrize("offset,slots", [(0.0, None), (1.3, None), (1.3, {"payments": 1.7})])
def test_interval_labels_match_brute_force(spark, offset, slots):
    rng = np.random.default_rng(9)
    size = 5.0
    wins = [("payments", e, at(offset + i * size), at(offset + (i + 1) * size), size)
            for e in ("hot", "a") for i in range(40) if rng.random() < 0.8]
    rows = [txn("hot" if rng.random() < 0.8 else "a", i, float(rng.integers(0, 400)) / 2, 1.0) for i in range(300)]
    labels = {r[0]: (f"l{i % 3}" if rng.random() < 0.3 else ("" if i % 2 else None)) for i, r in enumerate(rows)}
    w = spark.createDataFrame(wins, "domain string, entity_key string, window_start timestamp, window_end timestamp, window_size_s double")
    lab = spark.createDataFrame(list(labels.items()), "event_id string, scenario_label string")
    ev = events(spark, rows).join(lab, "event_id")
    any_ = {(r["entity_key"], r["window_start"]): r["label"] for r in label_windows_any(w, ev, slots).collect()}
    first = {(r["entity_key"], r["window_start"]): r["scenario_label"] for r in label_windows_first(w, ev, slots).collect()}
    assert len(any_) == len(first) == len(wins) and sum(any_.values()) > 5
    for _, entity, start, end, _ in wins:
        hits = sorted((r[4], r[0]) for r in rows if r[2] == entity and start <= r[4] < end and labels[r[0]])
        assert any_[entity, start] == int(bool(hits))
        assert first[entity, start] == (labels[hits[0][1]] if hits else None)


def test_alert_mark_is_a_set(spark):
    df = windows(spark, ("e1", 0, None, False), ("e1", 1, None, False)).drop("alerted")
    alerts = spark.createDataFrame([("e1", at(2)), ("e1", at(2)), ("e2", at(4))], "entity_key string, window_end timestamp")
    got = rows_by(mark_alerted(df, alerts), "window_start")
    assert list(got["alerted"]) == [True, False]


def test_folds_expand_and_test_later_rows(spark):
    rows = [("market", f"e{i % 2}", at(i // 2)) for i in range(43)]
    got = ts_folds(spark.createDataFrame(rows, "domain string, entity_key string, window_end timestamp")).toPandas()
    for fold, (train, test) in enumerate([(13, 10), (23, 10), (33, 10)]):
        part = got[got["fold"] == fold]
        a, b = part[part.role == "train"]["row_no"], part[part.role == "test"]["row_no"]
        assert (len(a), len(b), a.max(), b.min()) == (train, test, train, train + 1)


def ap_loop(score, label):
    out, before, positives = 0.0, 0.0, label.sum()
    for t in np.unique(score)[::-1]:
        kept = score >= t
        recall = label[kept].sum() / positives
        out, before = out + (recall - before) * label[kept].mean(), recall
    return out


def test_average_precision_and_brier(spark):
    rng = np.random.default_rng(10)
    score, label = rng.random(500).round(2), (rng.random(500) < 0.2).astype(int)
    df = spark.createDataFrame(list(zip(score.tolist(), label.tolist())), "score double, label int")
    assert average_precision(df).first()[0] == pytest.approx(ap_loop(score, label), abs=1e-12)
    assert brier(df).first()[0] == pytest.approx(np.mean((score - label) ** 2), abs=1e-12)
    assert average_precision(df.withColumn("label", F.lit(0))).first()[0] == 0.0


def curve_of(spark, xs, ys):
    return spark.createDataFrame(list(zip(xs, ys)), "x double, y double")


def test_calibration_interpolates_and_clamps(spark):
    knots, values = [0.1, 0.2, 0.20001, 0.6, 0.9], [0.0, 0.3, 0.31, 0.31, 1.0]
    xs = np.concatenate([np.linspace(0, 1, 41), knots, [-1.0, 2.0]])
    df = spark.createDataFrame([(float(x),) for x in xs], "score double")
    got = calibrate(df, curve_of(spark, knots, values)).toPandas()
    assert len(got) == len(xs)
    np.testing.assert_allclose(got["calibrated"], np.interp(got["score"], knots, values), atol=1e-12)
    assert calibrate(df.limit(1), None).first()["calibrated"] == calibrate(df.limit(1), curve_of(spark, [], [])).first()["calibrated"] == 0.0
    nulls = calibrate(spark.createDataFrame([(None,)], "score double"), curve_of(spark, knots, values)).first()
    assert nulls["calibrated"] is None
    one = calibrate(df, curve_of(spark, [0.5], [0.7])).agg(F.min("calibrated"), F.max("calibrated")).first()
    assert tuple(one) == (0.7, 0.7)


def test_calibration_keeps_one_curve_per_key(spark):
    curves = curve_of(spark, [0.0, 1.0], [0.0, 0.5]).withColumn("domain", F.lit("a")).unionByName(
        curve_of(spark, [0.0, 1.0], [0.5, 1.0]).withColumn("domain", F.lit("b")))
    df = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("c", 0.5, 3)], "domain string, score double, y int")
    got = {r["domain"]: (r["calibrated"], r["y"]) for r in calibrate(df, curves, keys=["domain"]).collect()}
    assert got == {"a": (0.25, 1), "b": (0.75, 2), "c": (0.5, 3)}


def isotonic_loop(score, label):
    """Breakpoints by the largest least mean."""
    xs = np.unique(score)
    s, w = np.array([label[score == x].sum() for x in xs]), np.array([(score == x).sum() for x in xs])
    y = [max(min(s[j:k + 1].sum() / w[j:k + 1].sum() for k in range(i, len(xs))) for j in range(i + 1)) for i in range(len(xs))]
    ends = [i for i in range(len(xs)) if i in (0, len(xs) - 1) or y[i] != y[i - 1] or y[i] != y[i + 1]]
    return [(float(xs[i]), float(y[i])) for i in ends]


@pytest.mark.parametrize("block", [1, 4, 1 << 16])
@pytest.mark.parametrize("shape", ["rising", "falling", "flat", "noise"])
def test_isotonic_equals_the_largest_least_mean(spark, shape, block, monkeypatch):
    """Ranges of few pools, so that pools span many of them, against the definition."""
    monkeypatch.setattr(calibration, "BLOCK_POOLS", block)
    rng = np.random.default_rng(13)
    score = rng.random(150).round(2)
    chance = {"rising": score, "falling": 1 - score, "flat": np.full(150, 0.5), "noise": rng.random(150)}[shape]
    label = (rng.random(150) < chance).astype(int)
    df = spark.createDataFrame(list(zip(score.tolist(), label.tolist())) + [(None, 1)], "score double, label int")
    assert sorted(map(tuple, fit_isotonic(df).collect())) == isotonic_loop(score, label)


def test_isotonic_of_no_rows_has_no_breakpoints(spark):
    assert fit_isotonic(spark.createDataFrame([], "score double, label int")).collect() == []


def test_isotonic_is_monotone_and_lowers_brier(spark):
    rng = np.random.default_rng(11)
    p = rng.random(500) * 0.5
    rows = [(float(v + 0.3), int(rng.random() < v)) for v in p]
    df = spark.createDataFrame(rows, "score double, label int")
    curve = fit_isotonic(df)
    after = brier(calibrate(df, curve), "calibrated").first()[0]
    assert after < brier(df).first()[0]
