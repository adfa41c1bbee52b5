"""Supervised detector: boosted trees fitted side by side, their scores, attributions and storage."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.scratch import file_system, materialize
from pulsegrid.operators import booster
from pulsegrid.operators.booster import Booster
from pulsegrid.operators.calibration import calibrate
from pulsegrid.operators.joint_fits import fit_jointly

#: Rounds without a better hold-out score after which boosting ends.
PATIENCE = 15
#: Rows of a fold up to which one task makes a whole fit; all tasks together make the fits of larger folds.
TASK_ROWS = 100_000
_ACCURACY = 10_000
_NODES = "feature array<int>, threshold array<double>, left array<int>, right array<int>, value array<double>, cover array<double>, roots array<int>"
FITS_SCHEMA = (
    "domain string, fold int, point int, train_rows long, train_positives long, test_rows long, test_positives long, "
    f"best_round int, aucpr double, base double, {_NODES}"
)
#: Parameters of a grid point.
POINT = "max_depth int, step_size double, min_child int"


def param_grid(
    depths: Sequence[int] = (3, 4, 5), steps: Sequence[float] = (0.05, 0.1, 0.2), children: Sequence[int] = (1, 5)
) -> list[dict]:
    """Hyper-parameter combinations, in search order."""
    return [
        {"max_depth": d, "step_size": s, "min_child": c} for d, s, c in itertools.product(depths, steps, children)
    ]


def binned(folds: DataFrame, fit_rows: int | None = None) -> tuple[DataFrame, dict[tuple[str, int], list[np.ndarray]]]:
    """Stored training rows with one byte per feature, and the edges of the bins by (domain, fold).

    Edges are quantiles of all training rows of a fold, merged from sketches of every task. All rows are kept, unless the caller
    asks for about ``fit_rows`` rows of a domain by a hash of (entity, window end), the same ones in every fold. ``folds`` has
    ``domain, fold, role, entity_key, window_end, vector, label``.
    """
    n_features = folds.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 0
    probs = F.array(*[F.lit(k / booster.MOST_BINS) for k in range(1, booster.MOST_BINS)])
    quantiles = folds.where("role = 'train'").groupBy("domain", "fold").agg(*[
        F.percentile_approx(F.element_at("vector", f + 1), probs, _ACCURACY).alias(f"f{f}") for f in range(n_features)])
    # One row per domain and fold, each of features x 255 numbers.
    edges = {(r["domain"], r["fold"]): [np.unique(np.array(r[f"f{f}"])) for f in range(n_features)] for r in quantiles.collect()}
    chosen = folds
    if fit_rows is not None:
        sizes = folds.groupBy("domain").agg(F.countDistinct("entity_key", "window_end").alias("_n"))
        cut = F.lit(float(fit_rows)) / F.col("_n") * F.lit(float(1 << 31))
        chosen = folds.join(sizes, "domain").where(
            F.pmod(F.xxhash64(F.lit(29), "entity_key", "window_end"), F.lit(1 << 31)).cast("double") < cut)

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("vector").to_pylist(), np.float64).reshape(batch.num_rows, -1)
            keys = list(zip(batch.column("domain").to_pylist(), batch.column("fold").to_pylist(), strict=True))
            out = np.zeros(x.shape, np.uint8)
            for key in set(keys) & edges.keys():
                at = np.array([k == key for k in keys])
                out[at] = booster.to_bins(x[at], edges[key])
            yield pa.RecordBatch.from_arrays(
                [batch.column("domain"), batch.column("fold"), batch.column("held_out"), batch.column("label"),
                 pa.array([r.tobytes() for r in out], pa.binary())], ["domain", "fold", "held_out", "label", "bins"])

    rows = chosen.select("domain", "fold", (F.col("role") == "test").alias("held_out"), F.col("label").cast("int").alias("label"), "vector")
    return materialize(rows.mapInArrow(to_bytes, "domain string, fold int, held_out boolean, label int, bins binary")), edges


def fit_boosters(
    folds: DataFrame, points: Sequence[dict], rounds: int = 300, patience: int = PATIENCE, fit_rows: int | None = None,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Every (domain, fold, grid point) fitted on all rows of its fold: one row per fit, with its trees.

    Fits of folds up to ``task_rows`` rows of one byte per feature are independent tasks of one job; larger folds are fitted by all tasks
    together (``joint_fits``). Folds without rows on either side give no row; without positives on either side the score is null
    and there are no trees. ``fit_rows`` is that of ``binned``.
    """
    rows, edges = binned(folds, fit_rows)
    grid = [dict(p) for p in points]
    each = rows.withColumn("point", F.explode(F.array(*[F.lit(i) for i in range(len(grid))])))
    names = [f.split(" ")[0] for f in _NODES.split(", ")]
    kinds = {"feature": pa.int32(), "left": pa.int32(), "right": pa.int32(), "roots": pa.int32()}

    def fit(group: pa.Table) -> pa.Table:
        domain, fold, point = (group.column(c)[0].as_py() for c in ("domain", "fold", "point"))
        blob = group.column("bins").combine_chunks()
        bins = np.frombuffer(b"".join(blob.to_pylist()), np.uint8).reshape(group.num_rows, -1)
        order = np.lexsort(bins.T[::-1])  # sums do not depend on the order in which rows arrive
        bins, held_out = bins[order], group.column("held_out").to_numpy(zero_copy_only=False).astype(bool)[order]
        label = group.column("label").to_numpy().astype(float)[order]
        sides = [(int(m.sum()), int(label[m].sum())) for m in (~held_out, held_out)]
        model, best, score = None, None, None
        if all(p for _n, p in sides):
            model, best, score = booster.fit(bins, label, held_out, edges[(domain, fold)], rounds=rounds, patience=patience, **grid[point])
        head = {
            "domain": [domain], "fold": [fold], "point": [point], "train_rows": [sides[0][0]], "train_positives": [sides[0][1]],
            "test_rows": [sides[1][0]], "test_positives": [sides[1][1]], "best_round": [best], "aucpr": [score],
            "base": [None if model is None else model.base],
        }
        ints = {c: pa.array(head[c], pa.int32()) for c in ("fold", "point", "best_round")}
        reals = {c: pa.array(head[c], pa.float64()) for c in ("aucpr", "base")}
        trees = {c: pa.array([None if model is None else getattr(model, c).tolist()], pa.list_(kinds.get(c, pa.float64()))) for c in names}
        return pa.table({c: pa.array(v) for c, v in head.items()} | ints | reals | trees)

    held, train = F.col("held_out"), ~F.col("held_out")
    sizes = rows.where("domain IS NOT NULL").groupBy("domain", "fold").agg(
        F.count(F.when(held, 1)).alias("_a"), F.count(F.when(train, 1)).alias("_b"),
        F.sum(F.when(held, F.col("label"))).alias("_c"), F.sum(F.when(train, F.col("label"))).alias("_d")).where("_a > 0 and _b > 0")
    within = F.col("_a") + F.col("_b") <= task_rows
    fits = each.join(sizes.where(within).select("domain", "fold"), ["domain", "fold"]).groupBy("domain", "fold", "point").applyInArrow(
        fit, FITS_SCHEMA)
    large = sizes.where(~within).collect()  # one row per domain and fold
    return materialize(fits.unionByName(_joint(rows, large, edges, grid, rounds, patience)) if large else fits)


def _joint(
    rows: DataFrame, sizes: list, edges: dict[tuple[str, int], list[np.ndarray]], grid: Sequence[dict], rounds: int, patience: int
) -> DataFrame:
    """``FITS_SCHEMA`` rows of the folds in ``sizes``; the driver holds their trees."""
    spark, names = rows.sparkSession, [f.split(" ")[0] for f in FITS_SCHEMA.split(", ")]
    sound = sorted((r for r in sizes if r["_c"] and r["_d"]), key=lambda r: (r["domain"], r["fold"]))
    keys = [(r["domain"], r["fold"]) for r in sound]
    made = {}
    if keys:
        parts = spark.createDataFrame([(d, f, p) for p, (d, f) in enumerate(keys)], "domain string, fold int, part int")
        made = fit_jointly(rows.join(parts, ["domain", "fold"]), keys, [r["_d"] / r["_b"] for r in sound], edges, grid, rounds, patience)
    out = []
    for r in sizes:
        key = r["domain"], r["fold"]
        for i in range(len(grid)):
            nodes, base, best, score = made[keys.index(key), i] if key in keys else ({}, None, None, None)
            values = [*key, i, r["_b"], r["_d"], r["_a"], r["_c"], best, score, base]
            out.append(dict(zip(names, values)) | {c: None if not nodes else nodes[c].tolist() for c in names[len(values):]})
    return spark.createDataFrame(out, FITS_SCHEMA)


def as_booster(row) -> Booster:
    """The model in a row of ``fit_boosters`` or of a stored model."""
    ints = {c: np.array(row[c], np.int64) for c in ("feature", "left", "right", "roots")}
    reals = {c: np.array(row[c], np.float64) for c in ("threshold", "value", "cover")}
    return Booster(base=row["base"], **ints, **reals)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.to_list(), np.float64)


def _by_domain(domain: pd.Series, vectors: pd.Series, models: dict[str, Booster]) -> Iterator[tuple[np.ndarray, Booster]]:
    """Places of the rows that have a vector and a model, with that model."""
    given = vectors.notna().to_numpy()
    for d, model in models.items():
        at = np.flatnonzero(given & (domain == d).to_numpy())
        if len(at):
            yield at, model


def margins(df: DataFrame, models: dict[str, Booster], out: str = "margin", where: Column | None = None) -> DataFrame:
    """Add the log-odds of ``vector`` by the model of its domain; null without a model, or where ``where`` does not hold."""

    @F.pandas_udf("double")
    def of(domain: pd.Series, vectors: pd.Series) -> pd.Series:
        values = pd.Series(np.nan, index=range(len(vectors)), dtype=object).where(lambda x: x.notna(), None)
        for at, model in _by_domain(domain, vectors, models):
            values.iloc[at] = model.margin(_matrix(vectors.iloc[at]))
        return values.astype("Float64")

    vector = F.col("vector") if where is None else F.when(where, F.col("vector"))
    return df.withColumn(out, of("domain", vector))


def supervised_scores(
    df: DataFrame, models: dict[str, Booster], curves: DataFrame | None = None, out: str = "xgboost"
) -> DataFrame:
    """Add the probability by the model of the row's domain, calibrated by ``curves`` (``domain, x, y``); null without a model."""
    if not models:
        return df.withColumn(out, F.lit(None).cast("double"))
    raw = margins(df, models, "_margin").withColumn("_raw", F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_margin"))))
    return calibrate(raw, curves, "_raw", out, keys=["domain"]).drop("_raw", "_margin")


def supervised_score(
    df: DataFrame, model: Booster | None, calibration: DataFrame | None = None, out: str = "xgboost"
) -> DataFrame:
    """``supervised_scores`` of rows that all belong to one model, whatever their domain."""
    if model is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    curves = None if calibration is None else calibration.withColumn("domain", F.lit("")).select("domain", "x", "y")
    one = df.withColumn("_domain", F.col("domain") if "domain" in df.columns else F.lit("")).withColumn("domain", F.lit(""))
    scored = supervised_scores(one, {"": model}, curves, out).withColumn("domain", F.col("_domain")).drop("_domain")
    return scored.select(*[c for c in df.columns if c != out], out)


def attributions(df: DataFrame, models: dict[str, Booster], where: Column | None = None, out: str = "shap") -> DataFrame:
    """Add signed attributions per input (array) and ``shap_bias``, which sum to the margin, for rows where ``where`` holds.

    Other rows, and rows without a model, hold null and cost nothing but their way through the function.
    """
    if not models:
        return df.withColumns({out: F.lit(None).cast("array<double>"), "shap_bias": F.lit(None).cast("double")})

    @F.pandas_udf("array<double>")
    def of(domain: pd.Series, vectors: pd.Series) -> pd.Series:
        values = pd.Series([None] * len(vectors), dtype=object)
        for at, model in _by_domain(domain, vectors, models):
            for i, v in zip(at, model.attributions(_matrix(vectors.iloc[at])), strict=True):
                values.iat[i] = v
        return values

    vector = F.col("vector") if where is None else F.when(where, F.col("vector"))
    n = F.size("_shap")
    return df.withColumn("_shap", of("domain", vector)).withColumns({
        out: F.when(F.col("_shap").isNotNull(), F.slice("_shap", 1, n - 1)), "shap_bias": F.try_element_at("_shap", n)}).drop("_shap")


def save_model(spark: SparkSession, path: str, domain: str, model: Booster, calibration: DataFrame | None = None) -> str:
    """Write one domain's model and curve below a new version folder; returns the version.

    Versions are numbered and never overwritten, so a reader never meets half of a model: the model row is written last.
    """
    version = 1 + max([v for v, _has in _versions(spark, path, domain)], default=0)
    folder = f"{path.rstrip('/')}/{domain}/v{version:06d}"
    if calibration is not None:
        calibration.select("x", "y").write.mode("errorifexists").parquet(f"{folder}/curve")
    row = {c: getattr(model, c).tolist() for c in ("feature", "threshold", "left", "right", "value", "cover", "roots")}
    stored = spark.createDataFrame([row | {"base": model.base, "calibrated": calibration is not None}],
                                   f"base double, calibrated boolean, {_NODES}")
    stored.coalesce(1).write.mode("errorifexists").parquet(f"{folder}/model")
    return f"v{version:06d}"


def _versions(spark: SparkSession, path: str, domain: str) -> list[tuple[int, bool]]:
    """Number of every version folder, and whether its model has been written to the end."""
    fs, top = file_system(spark, f"{path.rstrip('/')}/{domain}")
    if not fs.exists(top):
        return []
    found = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName()[1:].isdigit()]
    return [(int(p.getName()[1:]), fs.exists(p.suffix("/model/_SUCCESS"))) for p in found]


def load_model(spark: SparkSession, path: str, domain: str) -> tuple[Booster | None, DataFrame | None]:
    """A domain's newest complete model and its curve; ``(None, None)`` before there is one."""
    newest = max([v for v, complete in _versions(spark, path, domain) if complete], default=None)
    if newest is None:
        return None, None
    folder = f"{path.rstrip('/')}/{domain}/v{newest:06d}"
    row = spark.read.parquet(f"{folder}/model").first()
    return as_booster(row), spark.read.parquet(f"{folder}/curve") if row["calibrated"] else None
