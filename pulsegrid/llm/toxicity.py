"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy, over all overlapping windows.

A word enters as a hashed word vector, the mean of its hashed character n-gram vectors and the evidence of the word and of its
first five letters (shrunk log-odds of document frequencies in toxic and other texts). Windows of ``WINDOW`` words at steps of half a window cover the whole text; each is read in
both directions, pooled by attention and scored, and a document's score is that of its worst window, moved from the equal
classes of training to the share of toxic documents (between 1 and 50 %).

Training takes ``SAMPLE_DOCS`` labelled documents of either class at most (chosen by a hash of the id, null ids and held-out rows never) and at most
``SAMPLE_CHARS`` characters of each at a hashed place. Evidence that a training document gives itself is taken out
before it is trained on. Scoring is one pass without a shuffle. Null texts and texts without words score 0, and so
does everything when one class is missing. A document with several labels is toxic if one says so. Repeated rows and other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import held_out, learnable, whole
from pulsegrid.llm.word_features import find_words, word_features

SAMPLE_DOCS = 800
SAMPLE_CHARS = 30_000
WINDOW, STEP = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 6, 6, 8
BUCKETS = 1 << 14
BATCH, ROUNDS, RESELECT = 64, 200, 50
RATE, DECAY = 0.02, 0.02
#: Share of words whose learnt vectors enter while training; evidence always does.
KEEP = 0.3
LEAST_DOCS = 3
_CACHE_WORDS = 400_000

Params = dict[str, np.ndarray]


@dataclass
class Model:
    params: Params
    evidence: dict[str, float]
    shift: float  # from equal classes, as in training, to the share of toxic documents


def _places(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    whole_word, _, grams = word_features(words)
    grams = np.where(grams == 0, BUCKETS, grams % np.uint64(BUCKETS)).astype(np.int32)
    return (whole_word % np.uint64(BUCKETS)).astype(np.int32), grams


def _inputs(p: Params, word: np.ndarray, grams: np.ndarray, evidence: np.ndarray, keep: np.ndarray | float = KEEP) -> np.ndarray:
    """What enters for each word. ``keep`` scales the learnt vectors: their mean by default, 0 or 1 per row while training."""
    count = np.maximum((grams != BUCKETS).sum(axis=1, keepdims=True), 1)
    return np.concatenate((p["word"][word] * keep, p["char"][grams].sum(axis=1) / count * keep, evidence), axis=1)


def start_params(seed: int = 3) -> Params:
    rng = np.random.default_rng(seed)
    size = WORD_DIM + CHAR_DIM + 2
    p = {"word": rng.normal(0, 0.05, (BUCKETS, WORD_DIM)), "char": rng.normal(0, 0.05, (BUCKETS + 1, CHAR_DIM))}
    p["char"][BUCKETS] = 0
    for d in ("f", "b"):
        p[f"in_{d}"] = rng.normal(0, 0.4, (size, 3 * HIDDEN))
        p[f"bias_{d}"] = np.zeros(3 * HIDDEN)
        p[f"back_{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
    p["attend"] = rng.normal(0, 0.3, 2 * HIDDEN)
    p["out"] = rng.normal(0, 0.3, 2 * HIDDEN)
    p["out_bias"] = np.zeros(1)
    return p


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _read(gates: np.ndarray, index: np.ndarray, mask: np.ndarray, back: np.ndarray, reverse: bool, trace: list | None = None) -> np.ndarray:
    """States (places, windows, HIDDEN) of one direction. ``gates`` has the input part of all gates per word."""
    length, n = index.shape
    h = np.zeros((n, HIDDEN), gates.dtype)
    states = np.empty((length, n, HIDDEN), gates.dtype)
    for t in range(length - 1, -1, -1) if reverse else range(length):
        x, u = gates[index[t]], h @ back
        zr = _sigmoid(x[:, :2 * HIDDEN] + u[:, :2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = np.tanh(x[:, 2 * HIDDEN:] + r * u[:, 2 * HIDDEN:])
        new = np.where(mask[t][:, None], c + z * (h - c), h)
        if trace is not None:
            trace.append((t, h, z, r, c, u[:, 2 * HIDDEN:]))
        states[t] = h = new
    return states


def _pool(p: Params, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Attention weights, pooled states and logits."""
    pull = np.where(mask, states @ p["attend"], -30.0)
    a = np.exp(pull - pull.max(axis=0))
    a /= a.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, states)
    return a, pooled, pooled @ p["out"] + p["out_bias"][0]


def window_logits(p: Params, gates_f: np.ndarray, gates_b: np.ndarray, index: np.ndarray, mask: np.ndarray) -> np.ndarray:
    states = np.concatenate((_read(gates_f, index, mask, p["back_f"], False), _read(gates_b, index, mask, p["back_b"], True)), axis=2)
    return _pool(p, states, mask)[2]


def gradient(p: Params, word: np.ndarray, grams: np.ndarray, evidence: np.ndarray, index: np.ndarray, mask: np.ndarray,
             label: np.ndarray, weight: np.ndarray, keep: np.ndarray | float = 1.0) -> tuple[float, Params]:
    """Weighted log loss of windows and its gradient, by back-propagation through time."""
    x = _inputs(p, word, grams, evidence, keep)
    traces: dict[str, list] = {"f": [], "b": []}
    halves = [_read(x @ p[f"in_{d}"] + p[f"bias_{d}"], index, mask, p[f"back_{d}"], d == "b", traces[d]) for d in ("f", "b")]
    states = np.concatenate(halves, axis=2)
    a, pooled, logit = _pool(p, states, mask)
    prob = _sigmoid(logit)
    total = weight.sum()
    loss = float((weight * (np.logaddexp(0, logit) - label * logit)).sum() / total)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    d_logit = weight * (prob - label) / total
    g["out"], g["out_bias"] = d_logit @ pooled, np.array([d_logit.sum()])
    d_pooled = d_logit[:, None] * p["out"]
    d_a = np.einsum("tnh,nh->tn", states, d_pooled)
    d_pull = a * (d_a - (a * d_a).sum(axis=0)) * mask
    d_states = a[:, :, None] * d_pooled + d_pull[:, :, None] * p["attend"]
    g["attend"] = np.einsum("tn,tnh->h", d_pull, states)
    d_x = np.zeros_like(x)
    for side, d in enumerate(("f", "b")):
        d_gates = np.zeros((len(x), 3 * HIDDEN))
        d_h = np.zeros((index.shape[1], HIDDEN))
        for t, h, z, r, c, uc in reversed(traces[d]):
            d_h = d_h + d_states[t][:, side * HIDDEN:(side + 1) * HIDDEN]
            live = mask[t][:, None]
            d_new = np.where(live, d_h, 0)
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * uc * r * (1 - r)
            into = np.concatenate((d_z, d_r, d_c), axis=1)
            back = np.concatenate((d_z, d_r, d_c * r), axis=1)
            np.add.at(d_gates, index[t], into)
            g[f"back_{d}"] += h.T @ back
            d_h = np.where(live, d_new * z, d_h) + back @ p[f"back_{d}"].T
        g[f"in_{d}"], g[f"bias_{d}"] = x.T @ d_gates, d_gates.sum(axis=0)
        d_x += d_gates @ p[f"in_{d}"].T
    d_word, d_char = d_x[:, :WORD_DIM] * keep, d_x[:, WORD_DIM:WORD_DIM + CHAR_DIM] * keep
    count = np.maximum((grams != BUCKETS).sum(axis=1, keepdims=True), 1)
    for j in range(WORD_DIM):
        g["word"][:, j] = np.bincount(word, weights=d_word[:, j], minlength=BUCKETS)
    for j in range(CHAR_DIM):
        g["char"][:, j] = np.bincount(grams.ravel(), weights=np.repeat(d_char[:, j] / count[:, 0], grams.shape[1]), minlength=BUCKETS + 1)
    g["char"][BUCKETS] = 0
    return loss, g


def _stem(word: str) -> str:
    """The first five letters, marked as such."""
    return word[:5] + "*"


def evidence_of(words: list[str], evidence: dict[str, float]) -> np.ndarray:
    """Evidence of each word and of its stem."""
    return np.array([(evidence.get(w, 0.0), evidence.get(_stem(w), 0.0)) for w in words], np.float32).reshape(-1, 2)


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW, STEP))
    return [*starts, n - WINDOW]


def _log_odds(toxic: int, other: int, n_toxic: int, n_other: int) -> float:
    seen = toxic + other
    if seen < LEAST_DOCS:
        return 0.0
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((other + 0.5) / (n_other + 1))
    return odds * seen / (seen + 5)


def train(texts: list[str], labels: list[int], toxic_share: float, rounds: int = ROUNDS, seed: int = 11) -> Model | None:
    """A model of labelled texts, None unless both classes have words."""
    docs = [(find_words(t.lower()), y) for t, y in zip(texts, labels, strict=True)]
    docs = [(ws, y) for ws, y in docs if ws]
    n = {y: sum(1 for _, v in docs if v == y) for y in (0, 1)}
    if not n[0] or not n[1]:
        return None
    seen = {0: Counter(), 1: Counter()}
    for ws, y in docs:
        seen[y].update({k for w in ws for k in (w, _stem(w))})
    evidence = {w: _log_odds(seen[1][w], seen[0][w], n[1], n[0]) for w in seen[0] | seen[1] if seen[0][w] + seen[1][w] >= LEAST_DOCS}

    rng = np.random.default_rng(seed)
    index = {w: i for i, w in enumerate(sorted({w for ws, _ in docs for w in ws}))}
    word, grams = _places(list(index))
    lists = [np.array([index[w] for w in ws]) for ws, _ in docs]
    own = []
    for ws, y in docs:
        # What the document itself adds to the counts is left out.
        less = {w: _log_odds(seen[1][w] - y, seen[0][w] - (1 - y), n[1] - y, n[0] - (1 - y)) for w in {k for w in ws for k in (w, _stem(w))}}
        own.append(np.array([(less[w], less[_stem(w)]) for w in ws]))
    windows = [(d, s) for d, ids in enumerate(lists) for s in window_starts(len(ids))]
    first = np.cumsum([0] + [len(window_starts(len(ids))) for ids in lists])
    strength = np.array([own[d][s:s + WINDOW].clip(min=0).sum() for d, s in windows])
    label = np.array([y for _, y in docs])

    params = start_params()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    by_class = [np.flatnonzero(label == y) for y in (0, 1)]
    for step in range(1, rounds + 1):
        if step % RESELECT == 0:
            # From here on other documents show the windows that the model so far finds worst.
            table = np.concatenate([_inputs(params, word[i:i + 8192], grams[i:i + 8192], np.zeros((len(word[i:i + 8192]), 2))) for i in range(0, len(word), 8192)])
            gates = [table @ params[f"in_{d}"] + params[f"bias_{d}"] for d in ("f", "b")]
            for d in by_class[0]:
                local = [gt[lists[d]] + own[d] @ params[f"in_{s}"][-2:] for s, gt in zip("fb", gates, strict=True)]
                grid, mask, _ = _grid([np.arange(len(lists[d]))])
                strength[first[d]:first[d + 1]] = window_logits(params, local[0], local[1], grid, mask)
        chosen = np.concatenate([rng.choice(c, BATCH // 2) for c in by_class])
        # A toxic document is shown by its strongest window, another one by its strongest or by any.
        rows = [first[d] + (strength[first[d]:first[d + 1]].argmax() if label[d] or rng.random() < 0.7 else rng.integers(first[d + 1] - first[d])) for d in chosen]
        at = np.full((WINDOW, len(rows)), -1)
        ev = np.zeros((WINDOW, len(rows), 2))
        for j, r in enumerate(rows):
            d, s = windows[r]
            ids = lists[d][s:s + WINDOW]
            at[:len(ids), j], ev[:len(ids), j] = ids, own[d][s:s + WINDOW]
        # Evidence differs by document, so every place of the batch is its own input row.
        mask = at >= 0
        flat = np.where(mask, at, 0).ravel()
        place = np.arange(at.size).reshape(at.shape)
        loss, grad = gradient(params, word[flat], grams[flat], ev.reshape(-1, 2), place, mask, label[chosen].astype(float), np.ones(len(rows)),
                              (rng.random((at.size, 1)) < KEEP).astype(float))
        for k, v in grad.items():
            m, s2 = moments[k]
            m += 0.1 * (v - m)
            s2 += 0.01 * (v * v - s2)
            # Tables of vectors move slowly and decay: there are more of them than documents to tell them apart.
            table = k in ("word", "char")
            params[k] -= (RATE / 10 if table else RATE) * (m / (1 - 0.9**step)) / (np.sqrt(s2 / (1 - 0.99**step)) + 1e-8)
            params[k] *= 1 - (DECAY if table else DECAY / 10)

    share = min(0.5, max(0.01, toxic_share))
    return Model({k: v.astype(np.float32) for k, v in params.items()}, {w: e for w, e in evidence.items() if e}, math.log(share / (1 - share)))


def _grid(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word places (WINDOW, windows), mask and owning list of all windows over several lists of words."""
    sizes = np.array([len(x) for x in lists])
    starts = [window_starts(n) for n in sizes]
    owner = np.repeat(np.arange(len(lists)), [len(s) for s in starts])
    at = np.concatenate([np.array(s) for s in starts])[None, :] + np.arange(WINDOW)[:, None]
    mask = at < sizes[owner][None, :]
    base = (np.cumsum(sizes) - sizes)[owner]
    return np.concatenate(lists)[np.where(mask, at, 0) + base[None, :]], mask, owner


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> tuple[list[str], list[int], float]:
    """Texts and labels of a bounded sample, and the share of toxic ones among all that may be learnt from."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(
        learnable("id") & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if len(counts) < 2:
        return [], [], 0.0
    draw = F.pmod(F.xxhash64(F.lit(37), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cut = F.when(F.col("y") == 1, F.lit(per_class / counts[1])).otherwise(F.lit(per_class / counts[0]))
    # About 2 x per_class ids: small enough for every task whatever the table's size.
    picked = marked.where(draw < cut)
    text = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.lit(31), "id"), room).cast("int") + 1
    rows = text.join(F.broadcast(picked), "id").select("id", "y", F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("text")).collect()
    rows.sort(key=lambda r: (r["id"], r["text"]))
    return [r["text"] for r in rows], [r["y"] for r in rows], counts[1] / (counts[0] + counts[1])


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``n_windows`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        gates = [np.zeros((1 << 16, 3 * HIDDEN), np.float32) for _ in "fb"]

        def learn(words: list[str]) -> None:
            first = len(known)
            known.update(zip(words, range(first, first + len(words)), strict=True))
            while len(gates[0]) < len(known):
                gates[:] = [np.concatenate((g, np.zeros_like(g))) for g in gates]
            for at in range(0, len(words), 8192):
                part = words[at:at + 8192]
                evidence = evidence_of(part, model.evidence)
                x = _inputs(model.params, *_places(part), evidence)
                for g, d in zip(gates, "fb", strict=True):
                    g[first + at:first + at + len(part)] = x @ model.params[f"in_{d}"] + model.params[f"bias_{d}"]

        def score(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            found = [find_words(t.lower()) for t in texts]
            new = list({w for ws in found for w in ws} - known.keys())
            if new:
                learn(new)
            full = [i for i, ws in enumerate(found) if ws]
            worst, count = np.full(len(texts), -np.inf), np.zeros(len(texts), np.int64)
            if full:
                index, mask, owner = _grid([np.fromiter(map(known.__getitem__, found[i]), np.int64, len(found[i])) for i in full])
                owner = np.array(full)[owner]
                for at in range(0, index.shape[1], 2048):
                    logit = window_logits(model.params, gates[0], gates[1], index[:, at:at + 2048], mask[:, at:at + 2048])
                    np.maximum.at(worst, owner[at:at + 2048], logit)
                count = np.bincount(owner, minlength=len(texts))
            scores = 1 / (1 + np.exp(-np.clip(worst + model.shift, -30, 30)))
            return np.where(count > 0, scores, 0.0), count

        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 19):
                    size += len(texts[end])
                    end += 1
                if len(known) > _CACHE_WORDS:
                    known.clear()
                group = texts[at:end]
                scores, count = score(group) if model else (np.zeros(len(group)), np.zeros(len(group), np.int64))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array(count, pa.int64())],
                    ["doc_id", "held_out", "score", "n_windows"])
                at = end

    keyed = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), whole(text_col).alias("text"))
    return keyed.mapInArrow(run, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, n_windows long")


def fit_toxicity(docs: DataFrame, labels: DataFrame, **options) -> Model | None:
    texts, y, share = training_sample(docs, labels, **options)
    return train(texts, y, share) if texts else None
