"""Boosted trees of folds that are too large for one task: every task adds up histograms of its rows, level by level.

Trees are those of ``booster.fit`` on all rows of a fold. All fits share the jobs of a round: one per level for the histograms, one that
writes the new margins, one for the held-out average precision. A task holds the histograms of the open nodes (fits x nodes x
features x bins), the driver the trees. Sums are integers of 2^-32, so results do not depend on how rows are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scan import BLOCK, FINE_BLOCKS, running, value_block
from pulsegrid.functions.scratch import discard, materialize
from pulsegrid.operators import booster
from pulsegrid.operators.booster import LEAF_PENALTY, LEAST_GAIN, MOST_BINS

_UNIT, _FINE = float(1 << 32), float(1 << 52)
_STATE = "part int, held_out boolean, label int, bins binary, margins array<double>"
_SPLITS = (
    "part int, point int, node int, gain double, feature int, bin int, g double, h double, low_g double, low_h double, high_g double, high_h double"
)


class Tree:
    """Nodes of one tree while it grows; a leaf has feature -1 and the open ones are leaves that may still be split."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right = [-1], [0], [-1], [-1]
        self.threshold, self.value, self.cover = [0.0], [0.0], [0.0]
        self.open = [0]

    def close(self) -> None:
        """Columns as arrays: a model has hundreds of trees."""
        for c, kind in (("feature", np.int32), ("cut", np.int32), ("left", np.int32), ("right", np.int32), ("threshold", float), ("value", float), ("cover", float)):
            setattr(self, c, np.array(getattr(self, c), kind))

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        feature, cut, left, right = (np.array(c) for c in (self.feature, self.cut, self.left, self.right))
        at, line = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while (inner := feature[at] >= 0).any():
            low = bins[line, np.maximum(feature[at], 0)] <= cut[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)
        return at

    def weigh(self, node: int, g: float, h: float, step_size: float) -> None:
        self.value[node], self.cover[node] = -step_size * g / (h + LEAF_PENALTY), h

    def split(self, row, threshold: float, step_size: float) -> list[int]:
        """Two leaves below the node of ``row``."""
        kids = [len(self.feature), len(self.feature) + 1]
        node = row["node"]
        self.feature[node], self.cut[node], self.threshold[node], self.value[node] = row["feature"], row["bin"], threshold, 0.0
        self.left[node], self.right[node] = kids
        for column, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.threshold, 0.0), (self.value, 0.0), (self.cover, 0.0)):
            column += [v, v]
        self.weigh(kids[0], row["low_g"], row["low_h"], step_size)
        self.weigh(kids[1], row["high_g"], row["high_h"], step_size)
        return kids


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Part, label and bins (rows x features) of a batch."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    return batch.column("part").to_numpy(), batch.column("label").to_numpy().astype(float), bins


def _margins(batch: pa.RecordBatch, rows: np.ndarray, n: int) -> np.ndarray:
    """Margins (rows x fits) of rows of one part, which all have ``n``."""
    column = batch.column("margins")
    return column.values.to_numpy()[column.offsets.to_numpy()[rows][:, None] + np.arange(n)]


def _advance(state: DataFrame, kept: dict[int, list[tuple[int, Tree]]], held: dict[int, int]) -> DataFrame:
    """The state after a round: margins at the places ``kept``, each with the leaf of its tree added."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, _label, bins = _columns(batch)
            margins: list = [None] * batch.num_rows
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                before = _margins(batch, rows, held[p])
                after = np.stack([before[:, i] + np.array(tree.value)[tree.place(bins[rows])] for i, tree in kept[p]], axis=1)
                for i, m in zip(rows, after, strict=True):
                    margins[i] = m
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margins, pa.list_(pa.float64()))], batch.schema.names)

    return materialize(state.where(F.col("part").isin([p for p, fits in kept.items() if fits])).mapInArrow(step, _STATE))


def _best_splits(state: DataFrame, trees: dict[tuple[int, int], Tree], places: dict[int, list[int]], grid: Sequence[dict]) -> list:
    """Totals and best split of every open node: one row per node reaches the driver."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            part, label, bins = _columns(batch)
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                margins = _margins(batch, rows, len(places[p]))
                x, y = bins[rows], label[rows]
                cell = np.arange(x.shape[1]) * MOST_BINS + x
                cells = x.shape[1] * MOST_BINS
                for i, point in enumerate(places[p]):
                    tree = trees.get((p, point))
                    if tree is None or not tree.open:
                        continue
                    slot = np.full(len(tree.feature), -1)
                    slot[tree.open] = np.arange(len(tree.open))
                    mine = slot[tree.place(x)]
                    at = np.flatnonzero(mine >= 0)
                    where = (mine[at][:, None] * cells + cell[at]).ravel()
                    chance = 1.0 / (1.0 + np.exp(-margins[at, i]))
                    total = sums.setdefault((p, point), np.zeros((len(tree.open), 2, cells), np.int64))
                    for k, v in enumerate((chance - y[at], chance * (1 - chance))):
                        weight = np.repeat(np.rint(v * _UNIT), x.shape[1])
                        total[:, k] += np.bincount(where, weight, total.shape[0] * cells).astype(np.int64).reshape(-1, cells)
        for (p, point), total in sums.items():
            n = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p] * n, pa.int32()), pa.array([point] * n, pa.int32()), pa.array(trees[p, point].open, pa.int32()),
                 pa.array([t.tobytes() for t in total], pa.binary())], ["part", "point", "node", "sums"])

    def best(group: pa.Table) -> pa.Table:
        head = {c: group.column(c)[0].as_py() for c in ("part", "point", "node")}
        total = sum(np.frombuffer(s.as_py(), np.int64) for s in group.column("sums"))
        g, h = total.reshape(2, -1, MOST_BINS) / _UNIT
        (gain,), (f,), (b,) = booster._split(g[None], h[None], grid[head["point"]]["min_child"])
        sides = {"g": g[0].sum(), "h": h[0].sum(), "low_g": g[f, :b + 1].sum(), "low_h": h[f, :b + 1].sum(),
                 "high_g": g[f, b + 1:].sum(), "high_h": h[f, b + 1:].sum()}
        ints = {c: pa.array([v], pa.int32()) for c, v in (head | {"feature": f, "bin": b}).items()}
        reals = {c: pa.array([v], pa.float64()) for c, v in ({"gain": gain} | sides).items()}
        return pa.table({c.split(" ")[0]: (ints | reals)[c.split(" ")[0]] for c in _SPLITS.split(", ")})

    sums = state.where("NOT held_out").mapInArrow(add_up, "part int, point int, node int, sums binary")
    return sums.groupBy("part", "point", "node").applyInArrow(best, _SPLITS).collect()


def _precisions(state: DataFrame) -> dict[tuple[int, int], float]:
    """Average precision of the held-out rows by (part, place of the fit in ``margins``), over every distinct margin."""
    scored = state.where("held_out").select("part", "label", F.posexplode("margins").alias("place", "score"))
    at_score = scored.groupBy("part", "place", (-F.col("score")).alias("_down")).agg(
        F.sum("label").alias("_tp"), F.count(F.lit(1)).alias("_n")).withColumn(BLOCK, value_block(F.col("_down"), FINE_BLOCKS))
    steps = running(at_score, ["part", "place"], ["_down"], {
        "tp": ("sum", F.col("_tp")), "seen": ("sum", F.col("_n")), "positives": ("total", F.col("_tp"))})
    gain = F.col("_tp") / F.col("positives") * (F.col("tp") / F.col("seen"))
    # Whole units, so that the order of the sum cannot make a round look better than an equal one.
    found = steps.groupBy("part", "place").agg(F.sum(F.round(gain * _FINE).cast("long")).alias("s")).collect()
    return {(r["part"], r["place"]): r["s"] / _FINE for r in found}


def fit_jointly(
    rows: DataFrame, keys: Sequence[tuple[str, int]], shares: Sequence[float], edges: dict[tuple[str, int], list[np.ndarray]],
    grid: Sequence[dict], rounds: int, patience: int,
) -> dict[tuple[int, int], tuple[dict[str, np.ndarray], float, int, float]]:
    """By (place in ``keys``, grid point): columns of nodes, base, best round and its average precision, as ``booster.fit`` has them.

    ``rows`` is ``binned`` with ``part``, the place of the row's (domain, fold) in ``keys``; ``shares`` has the positive share of the
    training rows of each. Every fold has positives on both sides.
    """
    bases = [math.log(s / (1 - s)) for s in (min(max(s, 1e-6), 1 - 1e-6) for s in shares)]
    places = {p: list(range(len(grid))) for p in range(len(keys))}
    base = F.element_at(F.array(*[F.lit(b) for b in bases]), F.col("part") + 1)
    state = rows.select("part", "held_out", "label", "bins", F.array_repeat(base, len(grid)).alias("margins"))
    stored = None
    grown: dict[tuple[int, int], list[Tree]] = {(p, i): [] for p in places for i in places[p]}
    best = dict.fromkeys(grown, (0, -1.0))
    for n in range(1, rounds + 1):
        trees = {(p, i): Tree() for p in places for i in places[p] if n - 1 - best[p, i][0] < patience}
        if not trees:
            break
        for level in range(1 + max(grid[i]["max_depth"] for _p, i in trees)):
            if level and not any(t.open for t in trees.values()):
                break
            kids: dict[tuple[int, int], list[int]] = {k: [] for k in trees}
            for row in sorted(_best_splits(state, trees, places, grid), key=lambda r: (r["part"], r["point"], r["node"])):
                key = row["part"], row["point"]
                params, mine = grid[key[1]], edges[keys[key[0]]]
                if level == 0:
                    trees[key].weigh(0, row["g"], row["h"], params["step_size"])
                if level < params["max_depth"] and row["gain"] > LEAST_GAIN and row["bin"] < len(mine[row["feature"]]):
                    kids[key] += trees[key].split(row, float(mine[row["feature"]][row["bin"]]), params["step_size"])
            for key, tree in trees.items():
                tree.open = kids[key] if level + 1 < grid[key[1]]["max_depth"] else []
        kept = {p: [(k, trees[p, i]) for k, i in enumerate(at) if (p, i) in trees] for p, at in places.items()}
        after = _advance(state, kept, {p: len(at) for p, at in places.items()})
        if stored is not None:
            discard(stored)
        state = stored = after
        places = {p: [places[p][k] for k, _tree in fits] for p, fits in kept.items()}
        scores = _precisions(state)
        for (p, i), tree in trees.items():
            tree.close()
            grown[p, i].append(tree)
            score = scores[p, places[p].index(i)]
            if score > best[p, i][1]:
                best[p, i] = n, score
            elif n - best[p, i][0] >= patience:
                del grown[p, i][best[p, i][0]:]
    if stored is not None:
        discard(stored)
    return {key: (_nodes(made[:best[key][0]]), bases[key[0]], *best[key]) for key, made in grown.items()}


def _nodes(trees: Sequence[Tree]) -> dict[str, np.ndarray]:
    """Trees as one table of nodes."""
    roots = np.cumsum([0, *[len(t.feature) for t in trees]])[:-1] if trees else np.zeros(0, int)
    below = lambda c: [np.where(np.array(getattr(t, c)) < 0, -1, np.array(getattr(t, c)) + r) for t, r in zip(trees, roots, strict=True)]
    plain = lambda c: [np.array(getattr(t, c)) for t in trees]
    parts = {"feature": plain("feature"), "threshold": plain("threshold"), "left": below("left"), "right": below("right"),
             "value": plain("value"), "cover": plain("cover")}
    return {c: np.concatenate(v) if v else np.zeros(0) for c, v in parts.items()} | {"roots": roots}
