"""Offline training of the supervised detector on labelled windows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scratch import materialize
from pulsegrid.operators.booster import Booster
from pulsegrid.operators.calibration import fit_isotonic
from pulsegrid.operators.evaluation import CV_FOLDS, average_precision, brier, ts_folds
from pulsegrid.operators.supervised import as_booster, fit_boosters, param_grid, supervised_score

MIN_ROWS = 200
REPORT_SCHEMA = (
    "domain string, skipped string, train_rows long, held_out_rows long, held_out_positive_rows long, "
    "max_depth int, step_size double, min_child int, best_round int, cv_mean_val_aucpr double, held_out_aucpr double, "
    "brier_score_before_calibration double, brier_score_after_calibration double"
)


@dataclass(frozen=True)
class Trained:
    """One domain's model and calibration curve (None where training was skipped) and its one-row report."""

    model: Booster | None
    calibration: DataFrame | None
    report: DataFrame


def best_points(fits: DataFrame, grid: Sequence[dict]) -> dict[str, tuple[int, float]]:
    """Per domain the grid point with the best mean held-out average precision, and that mean.

    Folds without positives on either side do not count; the first of equal points wins, and point 0 at -1 where none counts.
    """
    # One row per domain and grid point.
    means = fits.groupBy("domain", "point").agg(F.avg("aucpr").alias("mean")).collect()
    best: dict[str, tuple[int, float]] = {}
    for r in sorted(means, key=lambda r: (r["domain"], r["point"])):
        best.setdefault(r["domain"], (0, -1.0))
        if r["mean"] is not None and r["mean"] > best[r["domain"]][1]:
            best[r["domain"]] = r["point"], r["mean"]
    return best


def grid_search(
    folds: DataFrame, grid: list[dict] | None = None, rounds: int = 300, fit_rows: int | None = None
) -> tuple[dict[str, tuple[int, float]], DataFrame]:
    """Every grid point on every fold of every domain in one job: the best points, and the table of fits.

    ``folds`` comes from ``ts_folds``. Early stopping watches the held-out rows of the fold.
    """
    grid = grid or param_grid()
    fits = fit_boosters(folds, grid, rounds, fit_rows=fit_rows)
    return best_points(fits, grid), fits


def _sizes(df: DataFrame, *keys: str) -> dict[tuple, tuple[int, int]]:
    """Rows and positives per key: a few rows reach the driver."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("p")).collect()
    return {tuple(r[k] for k in keys): (r["n"], r["p"]) for r in counted}


def train_supervised(
    vectors: DataFrame, domains: Sequence[str], min_rows: int = MIN_ROWS, grid: list[dict] | None = None, rounds: int = 300,
    fit_rows: int | None = None,
) -> dict[str, Trained]:
    """Train all domains: search, take the best point's fit of the last fold, calibrate and report on all its held-out rows.

    ``vectors`` has ``domain, window_end, entity_key, vector, label``. A domain with too few rows, no positives, or none
    on either side of the last split is skipped, and its report says why.
    """
    spark, grid = vectors.sparkSession, grid or param_grid()
    rows = vectors.where(F.col("domain").isin(list(domains))).select("domain", "entity_key", "window_end", "vector", "label")
    totals = _sizes(rows, "domain")

    def skip(domain: str, reason: str) -> Trained:
        return Trained(None, None, spark.createDataFrame([{"domain": domain, "skipped": reason}], REPORT_SCHEMA))

    done: dict[str, Trained] = {}
    for d in domains:
        n, p = totals.get((d,), (0, 0))
        if n < min_rows or not p:
            done[d] = skip(d, "too few rows" if n < min_rows else "no positives")
    usable = [d for d in domains if d not in done]
    if not usable:
        return done
    folds = materialize(ts_folds(rows.where(F.col("domain").isin(usable))))  # read by the search and by every report
    last = CV_FOLDS - 1
    sizes = _sizes(folds.where(F.col("fold") == last), "domain", "role")
    points, fits = grid_search(folds, grid, rounds, fit_rows)
    for d in usable:
        point, mean = points.get(d, (0, -1.0))
        fitted = fits.where((F.col("domain") == d) & (F.col("fold") == last) & (F.col("point") == point)).first()
        if fitted is None or fitted["aucpr"] is None:
            done[d] = skip(d, "no positives in the final split")
            continue
        model = as_booster(fitted)
        held = folds.where((F.col("domain") == d) & (F.col("fold") == last) & (F.col("role") == "test"))
        scored = materialize(supervised_score(held, model, out="score").select("vector", "score", "label"))
        curve = materialize(fit_isotonic(scored))
        after = supervised_score(scored, model, curve, out="score")
        report = {
            "domain": d, "skipped": None, "train_rows": sizes[d, "train"][0], "held_out_rows": sizes[d, "test"][0],
            "held_out_positive_rows": sizes[d, "test"][1], **grid[point], "best_round": fitted["best_round"], "cv_mean_val_aucpr": mean,
            "held_out_aucpr": average_precision(scored).first()["average_precision"],
            "brier_score_before_calibration": brier(scored).first()["brier_score"],
            "brier_score_after_calibration": brier(after).first()["brier_score"],
        }
        done[d] = Trained(model, curve, spark.createDataFrame([report], REPORT_SCHEMA))
    return done
