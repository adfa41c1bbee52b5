"""Exact top-k by inner product: a Voronoi kNN join.

Queries and data are grouped by their nearest pivot. A data cell is summed up by its radius, its largest norm and the k + 1
members best aligned with the pivot; those members bound from below what each query's k-th score is. A query group is summed
up by its centre, its radius and the least of its lower bounds. Centres, radii and norms bound from above what any member
of a cell can score with any query of a group, so pairs of cell and group that cannot matter are dropped before a row moves. The rows of
the other cells are tested one by one against the groups that are left for their cell, and only those that pass are sent.

Groups that need mostly the same cells are bundled, up to ``BUNDLE_QUERIES`` queries, and a row is sent to a bundle once, however
many of its groups need it. So at worst, with vectors that no bound can part, every row is sent once for each ``BUNDLE_QUERIES``
queries. A bundle is solved locally in pieces: its queries in parts of that number, its rows in chunks of about
``CHUNK_ROWS`` by a hash of the id, which also cuts hot cells; the pieces' best are merged. The answer is exact for any pivots.
``sent_rows`` tells what was dropped.

Pivots are a bounded sample (``MOST_PIVOTS``, by the square root of the data's size), and so are the summaries that are shared with
tasks. Vectors become floor(scale * x) in 64 bits; scores beyond that width wrap around. Vectors that are null or hold null or
non-finite components, and rows with a null id, take no part. Shorter vectors count as filled up with zeros. Repeated rows
are candidates each; repeated queries count once, and no row with the query's id is its neighbour. Empty tables give
empty results. Ties go to the smaller id. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
MOST_PIVOTS = 256
LEAST_PIVOTS = 16
BUNDLE_QUERIES = 1024
#: Groups join a bundle while the cells that the bundle needs are at most so many times those of its neediest group.
BUNDLE_SPREAD = 1.25
CHUNK_ROWS = 1 << 16
_EXACT = float(1 << 53)


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``id`` and ``v`` (array<long>) of the vectors that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = vectors.where(v.isNotNull() & F.col(id_col).isNotNull()).where(finite)
    return usable.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows filled up with zeros to ``dim``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; through floats only where those are exact."""
    qf, xf = q.astype(np.float64), x.astype(np.float64)
    largest = np.sqrt((qf * qf).sum(axis=1).max(initial=0.0)) * np.sqrt((xf * xf).sum(axis=1).max(initial=0.0))
    return (qf @ xf.T).astype(np.int64) if largest < _EXACT / 4 else q @ x.T


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Places of the nearest pivots, which is largest 2<x, p> - |p|^2."""
    return np.argmax(2.0 * (x @ pivots.T) - (pivots * pivots).sum(axis=1), axis=1)


class _Plan(NamedTuple):
    """What is shared with tasks: all of it is bounded by ``MOST_PIVOTS``."""

    dim: int
    pivots: np.ndarray
    needs: np.ndarray  # (groups, cells): whether a row of the cell may matter to the group
    centre: np.ndarray  # pivot of each group
    radius: np.ndarray
    least: np.ndarray
    bundle: np.ndarray  # bundle of each group
    parts: np.ndarray  # parts of each bundle's queries
    chunks: np.ndarray  # chunks of each bundle's rows
    grouped: DataFrame
    data: DataFrame


def _margin(upper: np.ndarray) -> np.ndarray:
    """An upper bound that stays one in spite of rounding."""
    return upper + np.abs(upper) * 1e-9 + 1.0


def _bundles(needs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bundle for each group: neediest first, each joins the first bundle that has room and hardly grows by it."""
    out = np.zeros(len(needs), np.int32)
    cells: list[np.ndarray] = []
    held: list[int] = []
    most: list[int] = []
    for g in np.argsort(-needs.sum(axis=1), kind="stable"):
        for b in range(len(cells)):
            both = cells[b] | needs[g]
            if held[b] + sizes[g] <= BUNDLE_QUERIES and both.sum() <= BUNDLE_SPREAD * most[b]:
                out[g], cells[b], held[b] = b, both, held[b] + int(sizes[g])
                break
        else:
            out[g] = len(cells)
            cells.append(needs[g].copy())
            held.append(int(sizes[g]))
            most.append(int(needs[g].sum()))
    return out


def _plan(vectors: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str) -> _Plan | None:
    """Pivots, summaries of cells and groups, and what each group needs; None when there are no rows or no queries."""
    data = quantized(vectors, id_col, vector_col)
    queries = quantized(vectors.where(is_query), id_col, vector_col).distinct()
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"] or queries.isEmpty():
        return None
    dim = max(1, size["dim"])
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.isqrt(size["n"]) // 4))
    drawn = data.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    pivots = np.array([r["v"] + [0] * (dim - len(r["v"])) for r in drawn], np.float64)

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        reach: dict[int, tuple[float, float, int]] = {}
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            ids, xf = batch.column("id").to_numpy(), x.astype(np.float64)
            cell = _nearest(xf, pivots) if len(x) else np.empty(0, int)
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                fit = xf[at] @ pivots[c]
                far = np.sqrt(((xf[at] - pivots[c]) ** 2).sum(axis=1).max())
                norm = np.sqrt((xf[at] ** 2).sum(axis=1).max())
                old = reach.get(c, (0.0, 0.0, 0))
                reach[c] = (max(old[0], far), max(old[1], norm), old[2] + len(at))
                top = np.argsort(-fit, kind="stable")[:k + 1]
                best[c] = sorted(best.get(c, []) + [(-fit[t], int(ids[at[t]]), x[at[t]].tolist()) for t in top])[:k + 1]
        rows = [(c, -f, i, v, *reach[c][:2], 0 if place else reach[c][2]) for c, kept in best.items() for place, (f, i, v) in enumerate(kept)]
        yield pa.RecordBatch.from_pydict({
            "cell": pa.array([int(r[0]) for r in rows], pa.int32()), "fit": pa.array([float(r[1]) for r in rows], pa.float64()),
            "id": pa.array([r[2] for r in rows], pa.int64()), "v": pa.array([r[3] for r in rows], pa.list_(pa.int64())),
            "far": pa.array([float(r[4]) for r in rows], pa.float64()), "norm": pa.array([float(r[5]) for r in rows], pa.float64()),
            "n": pa.array([r[6] for r in rows], pa.int64())})

    cell_rows = Window.partitionBy("cell")
    order = cell_rows.orderBy(F.desc("fit"), "id", "v")
    summary = data.mapInArrow(aligned, "cell int, fit double, id long, v array<long>, far double, norm double, n long").withColumns({
        "far": F.max("far").over(cell_rows), "norm": F.max("norm").over(cell_rows), "n": F.sum("n").over(cell_rows), "place": F.row_number().over(order),
    }).where(F.col("place") <= k + 1).collect()
    sample_ids = np.array([r["id"] for r in summary], np.int64)
    sample = np.array([r["v"] + [0] * (dim - len(r["v"])) for r in summary], np.int64)
    far, norm, rows = np.zeros(len(pivots)), np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in summary:
        far[r["cell"]], norm[r["cell"]], rows[r["cell"]] = r["far"], r["norm"], r["n"]

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("v"), dim)
            ids, qf = batch.column("id").to_numpy(), q.astype(np.float64)
            scores = _scores(q, sample).astype(np.float64)
            scores[ids[:, None] == sample_ids[None, :]] = -np.inf
            least = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
            near = _nearest(qf, pivots) if len(q) else np.empty(0, int)
            radius = np.sqrt(((qf - pivots[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(near, pa.int32()), pa.array(least), pa.array(radius)],
                ["id", "v", "centre", "least", "radius"])

    grouped = queries.mapInArrow(bounded, "id long, v array<long>, centre int, least double, radius double")
    groups = grouped.groupBy("centre").agg(
        F.min("least").alias("least"), F.max("radius").alias("radius"), F.count(F.lit(1)).alias("n")).orderBy("centre").collect()
    centre = np.array([g["centre"] for g in groups])
    radius, least = (np.array([g[c] for g in groups], np.float64) for c in ("radius", "least"))
    sizes = np.array([g["n"] for g in groups], np.int64)
    middle = pivots[centre]
    length = np.sqrt((pivots ** 2).sum(axis=1))
    # q x = (c_q + u)(c_x + w) with |u| and |w| below the radii; or (c_q + u) x, with |x| below the cell's norm.
    by_radii = middle @ pivots.T + radius[:, None] * length[None, :] + far[None, :] * (length[centre] + radius)[:, None]
    by_norm = (length[centre] + radius)[:, None] * norm[None, :]
    needs = (_margin(np.minimum(by_radii, by_norm)) >= least[:, None]) & (rows > 0)[None, :]
    if 4 * max(norm.max(), length.max()) ** 2 >= _EXACT:  # a row's nearest pivot then depends on rounding
        needs[:] = True
    bundle = _bundles(needs, sizes)
    held = np.bincount(bundle, weights=sizes).astype(np.int64)
    parts = np.maximum(1, -(-held // BUNDLE_QUERIES)).astype(np.int32)
    reached = np.array([rows[needs[bundle == b].any(axis=0)].sum() for b in range(len(parts))])
    return _Plan(dim, pivots, needs, centre, radius, least, bundle, parts, np.maximum(1, -(-reached // CHUNK_ROWS)), grouped, data)


def _sent(plan: _Plan) -> DataFrame:
    """``bundle``, ``id``, ``v`` of every row that may be among a bundle's answers."""
    dim, pivots, needs, bundle = plan.dim, plan.pivots, plan.needs, plan.bundle
    centre, radius, least = plan.centre, plan.radius, plan.least

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                xf = _matrix(part.column("v"), dim).astype(np.float64)
                near = _nearest(xf, pivots)
                upper = xf @ pivots[centre].T + radius[None, :] * np.sqrt((xf * xf).sum(axis=1))[:, None]
                passes = needs[:, near].T & (_margin(upper) >= least[None, :])
                for b in range(int(bundle.max()) + 1):
                    rows = np.flatnonzero(passes[:, bundle == b].any(axis=1))
                    if len(rows):
                        take = part.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), b, np.int32)), take.column("id"), take.column("v")], ["bundle", "id", "v"])

    return plan.data.mapInArrow(needed, "bundle int, id long, v array<long>")


def sent_rows(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """How much the bounds leave: ``bundle``, its ``groups``, ``cells`` needed of ``all_cells``, ``rows_sent`` of ``all_rows``."""
    spark = vectors.sparkSession
    plan = _plan(vectors, is_query, k, id_col, vector_col)
    if plan is None:
        return spark.createDataFrame([], "bundle int, groups int, cells int, all_cells int, rows_sent long, all_rows long")
    facts = [(b, int((plan.bundle == b).sum()), int(plan.needs[plan.bundle == b].any(axis=0).sum()), len(plan.pivots))
             for b in range(len(plan.parts))]
    sent = _sent(plan).groupBy("bundle").agg(F.count(F.lit(1)).alias("rows_sent"))
    return (
        spark.createDataFrame(facts, "bundle int, groups int, cells int, all_cells int").join(sent, "bundle", "left")
        .fillna(0, ["rows_sent"]).withColumn("all_rows", F.lit(plan.data.count()))
    )


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of each query's ``k`` best among all other rows."""
    plan = _plan(vectors, is_query, k, id_col, vector_col)
    if plan is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = plan.dim
    numbers = lambda values: F.array(*[F.lit(int(v)) for v in values])
    bundle_of = dict(zip(plan.centre.tolist(), plan.bundle.tolist(), strict=True))
    parts = F.get(numbers(plan.parts), F.col("bundle"))
    chunks = F.get(numbers(plan.chunks), F.col("bundle"))
    chunk = F.pmod(F.xxhash64(F.lit(7), "id"), chunks).cast("int")
    sent = _sent(plan).withColumns({"chunk": chunk, "part": F.explode(F.sequence(F.lit(0), parts - 1))})
    asked = plan.grouped.withColumn("bundle", F.get(numbers(bundle_of.get(c, 0) for c in range(len(plan.pivots))), F.col("centre"))).select(
        "bundle", F.pmod(F.xxhash64(F.lit(11), "id"), parts).cast("int").alias("part"), "id", "v",
        F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, qs = left.column("id").to_numpy(), _matrix(left.column("v").combine_chunks(), dim)
        xid, xs = right.column("id").to_numpy(), _matrix(right.column("v").combine_chunks(), dim)
        order = np.argsort(xid, kind="stable")
        xid, xs = xid[order], xs[order]
        out: list[np.ndarray] = []
        step = max(1, (1 << 22) // max(1, len(xid)))
        for at in range(0, len(qid) if len(xid) else 0, step):
            scores = _scores(qs[at:at + step], xs)
            for i, row in zip(qid[at:at + step], scores, strict=True):
                free = np.flatnonzero(xid != i)
                if len(free) > k:
                    kth = np.partition(row[free], len(free) - k)[len(free) - k]
                    free = free[row[free] >= kth]
                best = free[np.argsort(-row[free], kind="stable")[:k]]
                out.append(np.stack((np.full(len(best), i), xid[best], row[best]), axis=1))
        flat = np.concatenate(out) if out else np.empty((0, 3), np.int64)
        return pa.table({"query_id": flat[:, 0], "vec_id": flat[:, 1], "score": flat[:, 2]})

    keys = ["bundle", "part", "chunk"]
    local = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
