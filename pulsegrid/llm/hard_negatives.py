"""Hard negatives by an inverted multi-index with certified score windows.

An anchor's positives are its best rows of the same label; its hard negatives are the best rows of another label whose score
lies in a window below a positive's score. Scores are integer inner products of vectors taken as ``floor(scale * x)``.

* **Index.** Two codebooks, one for each half of a vector, are fitted on a bounded hash sample (``SAMPLE_ROWS``). Every row is
  indexed: its cell is the pair of its nearest half-codewords. Radii (the largest distance of a member from its
  codeword, by half) are taken over all rows, so bounds hold for each of them.
* **Visits.** What a cell can score with an anchor is at most the sum of two half bounds: inner product with the codeword plus
  norm times radius. A heap pops pairs of half-codewords in falling order of that sum (multi-sequence). Popped cells
  without rows, or whose own radii put them outside every open window, are passed over.
* **Certificates.** A search ends when the next sum falls below what is already held: the last of ``positives`` scores, or for
  each window its last negative (its lower edge while fewer are held). Answers are exact for any codebooks.
* **Rounds.** ``VISITS`` cells at most in the first rounds, then all that the certificate still asks for. Each round sends an anchor
  once to every shard that holds cells it wants. Shards hold at most ``SHARD_VALUES / dim`` rows: small cells share one, a hot
  cell is cut by a salt stored with its rows. More than ``GROUP_VALUES / dim`` anchors at a shard are solved in parts.

Rows with null id, label or vector, or with a null or non-finite component, take no part. Shorter vectors count as filled up
with zeros. Repeated rows are candidates each; of an id that is repeated among anchors, the row with the smallest label and vector is
the anchor, and no row with the anchor's id is its partner. Ties go to the smaller id. An empty table gives no rows, an
anchor without positives none either. Other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scratch import materialize
from pulsegrid.llm.common import hash_sample

SCALE = 256
#: Rows (and values) that the codebooks are fitted on, at most about.
SAMPLE_ROWS, SAMPLE_VALUES = 16_384, 1 << 21
#: Rows per cell aimed at, and codewords of a half at most: cell statistics stay below 256 x 256 rows.
CELL_ROWS, MOST_WORDS = 64, 256
LLOYD_STEPS = 8
#: Cells visited at most in each round but the last, which has no limit.
VISITS = (16, 128)
#: Pops of a heap after which all cells are put in order at once.
HEAP_POPS = 512
SHARD_VALUES, GROUP_VALUES = 1 << 20, 1 << 19
_EXACT = float(1 << 53)
_NONE = -(1 << 62)


@dataclass
class Index:
    """Codebooks (halves x words x values), radii, and the shard of every cell. Bounded by ``MOST_WORDS`` squared."""

    words: tuple[np.ndarray, np.ndarray]
    reach: tuple[np.ndarray, np.ndarray]  # largest radius of a half-codeword
    radius: np.ndarray  # cells x 2
    rows: np.ndarray
    shard: np.ndarray
    parts: np.ndarray
    dim: int


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``id, label, v`` (array<long>) of the rows that take part."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = v.isNotNull() & F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    return vectors.where(known).where(finite).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
        F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def as_matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Lists as rows of integers, filled up with zeros to ``dim``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def inner_products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, through floats only where those are exact."""
    af, xf = a.astype(np.float64), x.astype(np.float64)
    largest = np.sqrt((af * af).sum(axis=1).max(initial=0.0)) * np.sqrt((xf * xf).sum(axis=1).max(initial=0.0))
    return np.rint(af @ xf.T).astype(np.int64) if largest < _EXACT / 4 else a @ x.T


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = (x.shape[1] + 1) // 2
    return x[:, :cut], x[:, cut:]


def fit_words(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` codewords by Lloyd's steps from evenly spaced rows; a word without members stays where it is."""
    words = x[np.linspace(0, len(x) - 1, n).astype(int)].astype(np.float64)
    for _ in range(LLOYD_STEPS):
        at = nearest(x, words)
        count = np.bincount(at, minlength=n)
        total = np.zeros_like(words)
        np.add.at(total, at, x)
        words = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], words)
    return words


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmax(2.0 * (x @ words.T) - (words * words).sum(axis=1), axis=1)


def build_index(data: DataFrame, n: int, dim: int) -> tuple[DataFrame, Index]:
    """The stored index of every row (``id, label, v, shard, cell``), and its bounded summary."""
    spark = data.sparkSession
    bound = max(256, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    sample = as_matrix(hash_sample(data, "id", bound, n).select("v").limit(2 * bound).toArrow().column("v"), dim)
    if not len(sample):
        sample = np.zeros((1, dim), np.int64)
    n_words = int(min(MOST_WORDS, max(1, round((n / CELL_ROWS) ** 0.5))))
    words = tuple(fit_words(h.astype(np.float64), n_words) for h in halves(sample))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            x = as_matrix(batch.column("v"), dim).astype(np.float64)
            at = [nearest(h, w) for h, w in zip(halves(x), words, strict=True)]
            off = [np.sqrt(((h - w[a]) ** 2).sum(axis=1)) for h, w, a in zip(halves(x), words, at, strict=True)]
            salt = np.arange(row, row + len(x), dtype=np.int64)  # copies of one id must not meet in one shard
            row += len(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((at[0] * n_words + at[1]).astype(np.int32)), pa.array(off[0]), pa.array(off[1]), pa.array(salt)],
                ["id", "label", "v", "cell", "off1", "off2", "salt"])

    stored = materialize(data.select("id", "label", "v").mapInArrow(
        assign, "id long, label string, v array<long>, cell int, off1 double, off2 double, salt long"))
    # One row per cell, at most MOST_WORDS squared.
    seen = stored.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("off1").alias("r1"), F.max("off2").alias("r2")).toPandas()
    rows, radius = np.zeros(n_words * n_words, np.int64), np.zeros((n_words * n_words, 2))
    rows[seen["cell"]] = seen["n"]
    radius[seen["cell"]] = seen[["r1", "r2"]].to_numpy() * (1 + 1e-9)
    grid = radius.reshape(n_words, n_words, 2)
    shard, parts = shards(rows, max(256, SHARD_VALUES // dim))
    index = Index(words, (grid[:, :, 0].max(axis=1), grid[:, :, 1].max(axis=0)), radius, rows, shard, parts, dim)
    places = spark.createDataFrame(
        list(zip(range(len(rows)), shard.tolist(), parts.tolist(), strict=True)), "cell int, first int, parts int")
    placed = stored.join(F.broadcast(places), "cell")  # one row per cell, as above
    return placed.select(
        "id", "label", "v", "cell",
        (F.col("first") + F.pmod(F.xxhash64("id", "salt"), F.col("parts")).cast("int")).alias("shard")), index


def shards(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard of every cell and how many it has: small neighbours share one, a large cell has several of its own."""
    first, parts, now, held = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), 0, 0
    for cell, n in enumerate(rows):
        if held and held + n > most:
            now, held = now + 1, 0
        first[cell], parts[cell] = now, max(1, -(-n // most))
        now, held = (now, held + n) if parts[cell] == 1 else (now + parts[cell], 0)
    return first, parts


def visits(up1: np.ndarray, up2: np.ndarray) -> Iterator[tuple[float, int]]:
    """Cells in falling order of the sum of their half bounds: the multi-sequence heap."""
    order1, order2 = np.argsort(-up1, kind="stable"), np.argsort(-up2, kind="stable")
    heap, pushed = [(-(up1[order1[0]] + up2[order2[0]]), 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, int(order1[i]) * len(up2) + int(order2[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(up1) and b < len(up2) and (a, b) not in pushed:
                pushed.add((a, b))
                heapq.heappush(heap, (-(up1[order1[a]] + up2[order2[b]]), a, b))


@dataclass
class Want:
    """What an anchor still looks for: a score in [low, high] of which ``held`` is the last one it has (or ``_NONE``)."""

    low: float
    high: float
    held: float

    @property
    def least(self) -> float:
        return max(self.low, self.held)


def choose(index: Index, anchor: np.ndarray, wants: list[Want], seen: int, most: int | None) -> tuple[list[int], int, bool]:
    """Cells to visit after the first ``seen`` pops, how many pops were made in all, and whether the search is certified."""
    if not wants:
        return [], seen, True
    a = halves(anchor[None, :].astype(np.float64))
    norm = [float(np.sqrt((h * h).sum())) for h in a]
    fit = [(w @ h[0]) for h, w in zip(a, index.words, strict=True)]
    least = min(w.least for w in wants)
    slack = 1.0 + 1e-9 * (norm[0] + norm[1] + 1.0) * (abs(fit[0]).max() + abs(fit[1]).max() + 1.0)
    up1, up2 = fit[0] + norm[0] * index.reach[0], fit[1] + norm[1] * index.reach[1]
    n2, chosen, pops = len(index.words[1]), [], 0
    for bound, cell in visits(up1, up2) if most is not None else ():
        if bound + slack < least:
            return chosen, pops, True
        pops += 1
        if pops > HEAP_POPS:
            break
        if pops <= seen or not index.rows[cell]:
            continue
        middle = fit[0][cell // n2] + fit[1][cell % n2]
        span = norm[0] * index.radius[cell, 0] + norm[1] * index.radius[cell, 1] + slack
        if any(middle + span >= w.least and middle - span <= w.high for w in wants):
            chosen.append(cell)
            if most is not None and len(chosen) >= most:
                return chosen, pops, False
    if most is not None and pops <= HEAP_POPS:
        return chosen, pops, True
    # The same cells in the same order, from whole columns: a search that goes on for long would spend its time on the heap.
    total = (up1[:, None] + up2[None, :]).ravel()
    cells = np.flatnonzero(total + slack >= least)
    place1, place2 = (np.argsort(np.argsort(-up, kind="stable"), kind="stable") for up in (up1, up2))
    cells = cells[np.lexsort((place2[cells % n2], place1[cells // n2], -total[cells]))]
    middle = fit[0][cells // n2] + fit[1][cells % n2]
    span = norm[0] * index.radius[cells, 0] + norm[1] * index.radius[cells, 1] + slack
    fits = np.logical_or.reduce([(middle + span >= w.least) & (middle - span <= w.high) for w in wants])
    fits &= (index.rows[cells] > 0) & (np.arange(len(cells)) >= seen)
    at = np.flatnonzero(fits)
    if most is not None and len(at) >= most:
        return cells[at[:most]].tolist(), int(at[most - 1]) + 1, False
    return cells[at].tolist(), len(cells), True


def best_per_row(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best allowed scores of every row; columns are in order of id, so ties go to the left."""
    masked = np.where(allowed, scores, _NONE)
    if masked.shape[1] > k:
        kth = np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]
        allowed = allowed & (masked >= kth[:, None])
    r, c = np.nonzero(allowed)
    order = np.lexsort((c, -masked[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _ask(open_anchors: DataFrame, index: Index, most: int | None, wants_of) -> DataFrame:
    """One row per anchor and shard with the cells it wants there; one with a null shard carries its progress."""
    names = ["anchor_id", "label", "v", "scores", "shard", "cells", "pops", "certain"]
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.bool_()]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for row, v in zip(batch.drop_columns(["v"]).to_pylist(), as_matrix(batch.column("v"), index.dim), strict=True):
                cells, pops, certain = choose(index, v, wants_of(row), row["seen"], most)
                by_shard: dict[int, list[int]] = {}
                for c in cells:
                    for s in range(index.shard[c], index.shard[c] + index.parts[c]):
                        by_shard.setdefault(int(s), []).append(c)
                values = v.tolist()
                for s, c in by_shard.items():
                    out.append((row["anchor_id"], row["label"], values, row["scores"], s, c, pops, certain))
                    if len(out) * index.dim >= GROUP_VALUES:
                        yield packed(out)
                        out = []
                out.append((row["anchor_id"], None, None, None, None, None, pops, certain))
        if out:
            yield packed(out)

    # Anchors are a small table whose search is long: every core has its share of them.
    cores = open_anchors.sparkSession.sparkContext.defaultParallelism
    return materialize(open_anchors.repartition(2 * cores, "anchor_id").mapInArrow(
        ask, "anchor_id long, label string, v array<long>, scores array<long>, shard int, cells array<int>, pops long, certain boolean"))


def _meet(asked: DataFrame, stored: DataFrame, index: Index, solve) -> DataFrame:
    """``solve`` on every shard that is asked for, with its anchors in parts of bounded size."""
    most = max(64, GROUP_VALUES // index.dim)
    wanted = asked.where(F.col("shard").isNotNull()).select("anchor_id", "label", "v", "scores", "shard", "cells")
    parts = wanted.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    left = wanted.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("anchor_id"), F.col("parts")).cast("int")).drop("parts")
    right = stored.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ["shard", "part"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(solve, "anchor_id long, score_of long, id long, score long")


def _solver(index: Index, k: int, windows: tuple[int, int] | None):
    """Best rows of a shard for its anchors: of the same label, or of others inside the window of each positive score."""
    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        aid, a = left.column("anchor_id").to_numpy(), as_matrix(left.column("v"), index.dim)
        order = np.argsort(right.column("id").to_numpy(), kind="stable")
        xid, x = right.column("id").to_numpy()[order], as_matrix(right.column("v"), index.dim)[order]
        own_cells, cell = np.unique(right.column("cell").to_numpy()[order], return_inverse=True)
        label = np.unique(np.array(left.column("label").to_pylist() + right.column("label").to_pylist(), dtype=object), return_inverse=True)[1]
        mine, theirs = label[:len(aid)], label[len(aid):][order]
        wanted = np.zeros((len(aid), len(own_cells)), bool)
        for i, cells in enumerate(left.column("cells").to_pylist()):
            wanted[i] = np.isin(own_cells, cells)
        scores_of = left.column("scores").to_pylist()
        out: list[np.ndarray] = []
        step = max(1, (1 << 21) // max(1, len(xid)))
        for at in range(0, len(aid) if len(xid) else 0, step):
            here = slice(at, at + step)
            if windows is None:
                for own in np.unique(mine[here]):
                    i, j = at + np.flatnonzero(mine[here] == own), np.flatnonzero(theirs == own)
                    if not len(j):
                        continue
                    scores = inner_products(a[i], x[j])
                    r, c = best_per_row(scores, wanted[i][:, cell[j]] & (aid[i][:, None] != xid[j][None, :]), k)
                    out.append(np.stack((aid[i][r], np.zeros(len(r), np.int64), xid[j][c], scores[r, c]), axis=1))
                continue
            scores = inner_products(a[here], x)
            free = wanted[here][:, cell] & (aid[here][:, None] != xid[None, :])
            free &= mine[here][:, None] != theirs[None, :]
            # Windows overlap: what lies in none of an anchor's is put aside once, and the rest in order once unless it is much.
            low, high = (np.array([f([w * p for p in s], default=none) for s in scores_of[here]], np.int64)
                         for f, w, none in ((min, windows[0], 1), (max, windows[1], 0)))
            free &= (100 * scores >= low[:, None]) & (100 * scores <= high[:, None])
            few = 8 * np.count_nonzero(free) <= free.size
            if few:
                fr, fc = np.nonzero(free)
                order = np.lexsort((-scores[fr, fc], fr))
                fr, fc = fr[order], fc[order]
                score = scores[fr, fc]
            for nth in range(max(map(len, scores_of[here]), default=0)):
                has = np.array([len(s) > nth for s in scores_of[here]])
                p = np.array([s[nth] if len(s) > nth else 0 for s in scores_of[here]], np.int64)
                if few:
                    kept = np.flatnonzero(has[fr] & (100 * score >= (windows[0] * p)[fr]) & (100 * score <= (windows[1] * p)[fr]))
                    kept = kept[np.arange(len(kept)) - np.searchsorted(fr[kept], fr[kept]) < k]
                    out.append(np.stack((aid[here][fr[kept]], p[fr[kept]], xid[fc[kept]], score[kept]), axis=1))
                    continue
                inside = (100 * scores >= (windows[0] * p)[:, None]) & (100 * scores <= (windows[1] * p)[:, None])
                r, c = best_per_row(scores, free & inside & has[:, None], k)
                out.append(np.stack((aid[here][r], p[r], xid[c], scores[r, c]), axis=1))
        flat = np.concatenate(out) if out else np.empty((0, 4), np.int64)
        return pa.table(dict(zip(("anchor_id", "score_of", "id", "score"), flat.T, strict=True)))

    return solve


def _search(anchors: DataFrame, stored: DataFrame, index: Index, k: int, wants_of, solve) -> DataFrame:
    """Rounds until every anchor's search is certified: ``anchor_id, score_of, id, score, place``.

    ``anchors`` has ``anchor_id, label, v, scores``; ``wants_of`` reads ``scores`` and ``held``, the last held score of each.
    """
    key = ["anchor_id", "score_of"]
    first = Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    progress, best = None, None
    for most in (*VISITS, None):
        if progress is None:
            state = anchors.withColumns({"seen": F.lit(0).cast("long"), "held": F.array().cast("array<struct<score_of:bigint,score:bigint>>")})
        else:
            last = best.where(F.col("place") == k).groupBy("anchor_id").agg(F.collect_list(F.struct("score_of", "score")).alias("held"))
            state = anchors.join(progress.where(~F.col("certain")).select("anchor_id", F.col("pops").alias("seen")), "anchor_id").join(
                last, "anchor_id", "left").withColumn("held", F.coalesce("held", F.array()))
        asked = _ask(state, index, most, wants_of)
        progress = asked.where(F.col("shard").isNull())
        found = _meet(asked, stored, index, solve)
        if best is not None:
            found = found.unionByName(best.drop("place"))
        best = materialize(found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k))
        if progress.where(~F.col("certain")).isEmpty():
            break
    return best


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Positives: the anchor's ``positives`` best rows of its label. For each, the ``negatives`` best rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``; a pair without any gives no rows.
    """
    spark: SparkSession = vectors.sparkSession
    data = usable(vectors, id_col, vector_col, label_col, scale)
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"]:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    stored, index = build_index(data, size["n"], max(1, size["dim"]))
    anchors = materialize(usable(vectors.where(is_anchor), id_col, vector_col, label_col, scale).groupBy(
        F.col("id").alias("anchor_id")).agg(F.min(F.struct("label", "v")).alias("r")).select(
        "anchor_id", "r.label", "r.v", F.array().cast("array<bigint>").alias("scores")))

    def positive_wants(row: dict) -> list[Want]:
        return [Want(-np.inf, np.inf, row["held"][0]["score"] if row["held"] else -np.inf)]

    def negative_wants(row: dict) -> list[Want]:
        held = {h["score_of"]: h["score"] for h in row["held"]}
        return [Want(low * p / 100, high * p / 100, held.get(p, -np.inf)) for p in row["scores"] if low * p <= high * p]

    pos = _search(anchors, stored, index, positives, positive_wants, _solver(index, positives, None))
    # Equal positive scores have the same window, so each is searched once.
    scored = pos.groupBy("anchor_id").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    neg = _search(materialize(anchors.drop("scores").join(scored, "anchor_id")), stored, index, negatives, negative_wants,
                  _solver(index, negatives, (low, high)))
    pairs = pos.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(neg.withColumnRenamed("score_of", "positive_score"), ["anchor_id", "positive_score"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
