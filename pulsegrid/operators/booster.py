"""Boosted trees in numpy: what one task does with one bounded fit, or with one batch of rows to score or explain."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bins of a feature: one byte.
MOST_BINS = 256
#: Regularisation of leaf weights, and the least gain of a split.
LEAF_PENALTY, LEAST_GAIN = 1.0, 1e-6
_BLOCK = 1 << 21


@dataclass(frozen=True)
class Booster:
    """Trees as one table of nodes; a leaf has feature -1 and adds ``value`` to the margin (log-odds).

    At most rounds x 2^(depth + 1) nodes, some 19 000 for 300 rounds of depth 5, so a model travels with its tasks.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray  # sum of Hessians of the training rows
    roots: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Base plus the leaf of every tree; a value at its threshold goes left."""
        out = np.full(len(x), self.base)
        step = max(1, _BLOCK // max(1, len(self.roots)))
        for at in range(0, len(x) if len(self.roots) else 0, step):
            rows = x[at:at + step]
            node = np.broadcast_to(self.roots, (len(rows), len(self.roots))).copy()
            line = np.arange(len(rows))[:, None]
            while (inner := self.feature[node] >= 0).any():
                low = rows[line, np.maximum(self.feature[node], 0)] <= self.threshold[node]
                node = np.where(inner, np.where(low, self.left[node], self.right[node]), node)
            out[at:at + step] += self.value[node].sum(axis=1)
        return out

    def leaves(self) -> Iterator[tuple[float, list[tuple[int, float, list[tuple[float, bool]]]]]]:
        """Value of every leaf, with (feature, share of cover, [(threshold, is low side)]) for each feature on its path."""
        for root in self.roots:
            stack: list[tuple[int, dict]] = [(int(root), {})]
            while stack:
                node, path = stack.pop()
                f = int(self.feature[node])
                if f < 0:
                    yield float(self.value[node]), [(k, share, tests) for k, (share, tests) in path.items()]
                    continue
                share, tests = path.get(f, (1.0, []))
                for child, low in ((int(self.left[node]), True), (int(self.right[node]), False)):
                    part = share * float(self.cover[child]) / float(self.cover[node])
                    stack.append((child, path | {f: (part, [*tests, (float(self.threshold[node]), low)])}))

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """Path-dependent Shapley values of the margin; the last column is the bias.

        A leaf with ``m`` features on its path is worth its value times the product of (share + passed * t) over them, where
        the power of ``t`` counts the features that are seen. Leaving one feature out divides the polynomial by
        its factor, so a leaf costs m squared steps instead of 2^m coalitions.
        """
        out = np.zeros((len(x), x.shape[1] + 1))
        out[:, -1] = self.base
        for value, path in self.leaves():
            m = len(path)
            passed = [np.logical_and.reduce([(x[:, f] <= t) == low for t, low in tests]) for f, _share, tests in path]
            poly = np.zeros((m + 1, len(x)))
            poly[0] = 1.0
            for (_f, share, _tests), seen in zip(path, passed, strict=True):
                poly[1:] = share * poly[1:] + seen * poly[:-1]
                poly[0] *= share
            out[:, -1] += value * math.prod(share for _f, share, _tests in path)
            weight = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
            for (f, share, _tests), seen in zip(path, passed, strict=True):
                # Seen: divide by (share + t), from the highest power down. Not seen: divide by the share.
                gain, rest = np.zeros(len(x)), np.zeros(len(x))
                for k in range(m - 1, -1, -1):
                    rest = np.where(seen, poly[k + 1] - share * rest, 0.0)
                    gain += weight[k] * np.where(seen, rest, poly[k] / share)
                out[:, f] += value * (seen - share) * gain
        return out


def average_precision(score: np.ndarray, label: np.ndarray) -> float:
    """Precision at every distinct score, weighted by the recall it adds."""
    positives = label.sum()
    if not positives:
        return 0.0
    order = np.argsort(-score, kind="stable")
    score, hits = score[order], np.cumsum(label[order])
    last = np.append(np.flatnonzero(np.diff(score)), len(score) - 1)
    found = hits[last]
    return float((np.diff(np.append(0, found)) * found / (last + 1.0)).sum() / positives)


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin number of every value: how many edges lie below it."""
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1).astype(np.uint8)


def _split(grad: np.ndarray, hess: np.ndarray, min_child: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best (gain, feature, bin) of every node from its histograms (nodes x features x bins)."""
    g, h = np.cumsum(grad, axis=2), np.cumsum(hess, axis=2)
    total_g, total_h = g[:, :1, -1:], h[:, :1, -1:]
    worth = lambda a, b: a * a / (b + LEAF_PENALTY)
    gain = worth(g, h) + worth(total_g - g, total_h - h) - worth(total_g, total_h)
    gain = np.where((h >= min_child) & (total_h - h >= min_child), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), best], best // gain.shape[2], best % gain.shape[2]


def fit(
    bins: np.ndarray, label: np.ndarray, held_out: np.ndarray, edges: list[np.ndarray], max_depth: int = 3, step_size: float = 0.1,
    min_child: float = 1, rounds: int = 300, patience: int = 15,
) -> tuple[Booster, int, float]:
    """Boosted trees on binned rows, the best round (from 1) and its average precision on the rows marked ``held_out``.

    A node needs a sum of Hessians of ``min_child``. Boosting ends after ``patience`` rounds without a higher average
    precision on the held-out rows, and trees behind the best round are dropped. Without held-out rows all rounds are kept.
    """
    train = ~held_out
    share = min(max(label[train].mean(), 1e-6), 1 - 1e-6)
    base = math.log(share / (1 - share))
    n_rows, n_features = bins.shape
    places = np.arange(n_features) * MOST_BINS + bins  # histogram cell within a node
    cells = n_features * MOST_BINS
    margin = np.full(n_rows, base)
    nodes: list[list] = [[], [], [], [], [], []]  # feature, threshold, left, right, value, cover
    roots: list[int] = []
    best, best_score, kept = 0, -1.0, 0
    for n in range(1, rounds + 1):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - label, p * (1 - p)
        roots.append(len(nodes[0]))

        def add(g: float, h: float) -> int:
            for column, v in zip(nodes, (-1, 0.0, -1, -1, -step_size * g / (h + LEAF_PENALTY), h), strict=True):
                column.append(v)
            return len(nodes[0]) - 1

        add(grad[train].sum(), hess[train].sum())
        at = np.full(n_rows, roots[-1])
        open_nodes = [roots[-1]]
        for _ in range(max_depth):
            slot = np.full(len(nodes[0]), -1)
            slot[open_nodes] = np.arange(len(open_nodes))
            rows = np.flatnonzero(train & (slot[at] >= 0))
            where = (slot[at[rows]][:, None] * cells + places[rows]).ravel()
            shape = (len(open_nodes), n_features, MOST_BINS)
            hg = np.bincount(where, np.repeat(grad[rows], n_features), len(open_nodes) * cells).reshape(shape)
            hh = np.bincount(where, np.repeat(hess[rows], n_features), len(open_nodes) * cells).reshape(shape)
            grown = []
            for i, (gain, f, b) in enumerate(zip(*_split(hg, hh, min_child), strict=True)):
                if gain <= LEAST_GAIN or b >= len(edges[f]):
                    continue
                g, h = hg[i, f], hh[i, f]
                node = open_nodes[i]
                kids = [add(g[:b + 1].sum(), h[:b + 1].sum()), add(g[b + 1:].sum(), h[b + 1:].sum())]
                for column, v in zip(nodes[:5], (int(f), float(edges[f][b]), *kids, 0.0), strict=True):
                    column[node] = v
                grown.append((node, f, b, kids))
            for node, f, b, kids in grown:
                mine = at == node
                at = np.where(mine, np.where(bins[:, f] <= b, kids[0], kids[1]), at)
            open_nodes = [k for *_x, kids in grown for k in kids]
            if not open_nodes:
                break
        margin = margin + np.array(nodes[4])[at]
        score = average_precision(margin[held_out], label[held_out]) if held_out.any() else 0.0
        if score > best_score or not held_out.any():
            best, best_score, kept = n, score, len(nodes[0])
        elif n - best >= patience:
            break
    columns = [np.array(c[:kept]) for c in nodes]
    return Booster(*columns, np.array(roots[:best], np.int64), base), best, best_score
