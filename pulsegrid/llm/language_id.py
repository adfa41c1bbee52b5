"""Language identification with a linear-chain conditional random field.

Every word of a text gets a label. A word's scores come from hashed features: the word itself (lexicon), prefixes and
suffixes of one to three letters, and character n-grams; learned transitions tie neighbours together, so
code-switched passages are labelled as such. Forward-backward gives each word's label probabilities, and a document
is given the label with the most expected words.

The model is fitted by gradient ascent on ``SAMPLE_DOCS`` documents per language at most, of which stretches of
``SAMPLE_CHARS`` characters at a hashed place are used; their chunks are shuffled into mixed sequences, from
which transitions are learnt. Labelling runs over whole texts in segments of ``SEGMENT`` words, in one pass without a shuffle, and
its tables per task are bounded. Text that is null or without a letter is ``und`` with score 0, and so is everything
when there is nothing to learn from. Repeated rows and other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import held_out, learnable, whole
from pulsegrid.llm.word_features import find_words, word_features

SAMPLE_DOCS = 250
SAMPLE_CHARS = 4000
BUCKETS = 1 << 15
ROUNDS = 25
SEGMENT = 64
_CHUNK = 12
_CACHE_WORDS = 400_000


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # (BUCKETS + 1, labels); the last row is for missing features
    transitions: np.ndarray


def _feature_places(words: list[str]) -> np.ndarray:
    lexicon, affixes, grams = word_features(words)
    every = np.concatenate((lexicon[:, None], affixes, grams), axis=1)
    return np.where(every == 0, BUCKETS, every % np.uint64(BUCKETS)).astype(np.int32)


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Score of each label for each word."""
    out = np.empty((len(words), weights.shape[1]), np.float32)
    for at in range(0, len(words), 8192):
        places = _feature_places(words[at:at + 8192])
        count = (places != BUCKETS).sum(axis=1, keepdims=True)
        out[at:at + 8192] = weights[places].sum(axis=1) / np.sqrt(count)
    return out


def forward_backward(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every place and expected transition counts, for sequences (n, places, labels) padded at the end."""
    n, length, labels = scores.shape
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    alpha = np.empty_like(local)
    alpha[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ move) * local[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
    beta = np.ones((n, labels), local.dtype)
    prob = np.empty_like(local)
    expected = np.zeros((labels, labels), np.float64)
    for t in range(length - 1, -1, -1):
        p = alpha[:, t] * beta
        prob[:, t] = p / p.sum(axis=1, keepdims=True)
        if t:
            ahead = local[:, t] * beta
            live = mask[:, t]
            pair = alpha[live, t - 1][:, :, None] * move[None] * ahead[live][:, None, :]
            if live.any():
                expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = ahead @ move.T
            b /= b.sum(axis=1, keepdims=True)
            beta = np.where(live[:, None], b, beta)
    return prob, expected


def label_probabilities(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """As ``forward_backward``, without transition counts."""
    length = scores.shape[1]
    local = np.exp(scores - scores.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max()).astype(local.dtype)
    alpha = np.empty_like(local)
    alpha[:, 0] = local[:, 0] / local[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, length):
        a = (alpha[:, t - 1] @ move) * local[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = np.where(mask[:, t, None], a, alpha[:, t - 1])
    beta = np.ones_like(local[:, 0])
    for t in range(length - 1, -1, -1):
        ahead = local[:, t] * beta
        alpha[:, t] *= beta
        b = ahead @ move.T
        b /= b.sum(axis=1, keepdims=True)
        beta = np.where(mask[:, t, None], b, beta)
    return alpha / alpha.sum(axis=2, keepdims=True)


def fit(texts: list[str], langs: list[str], rounds: int = ROUNDS, seed: int = 5) -> Crf | None:
    """A field fitted to texts in one language each; None without a word to learn from."""
    labels = sorted(set(langs))
    index: dict[str, int] = {}
    chunks = []
    for text, lang in zip(texts, langs, strict=True):
        ids = [index.setdefault(w, len(index)) for w in find_words(text.lower())]
        chunks += [(labels.index(lang), ids[i:i + _CHUNK]) for i in range(0, len(ids), _CHUNK)]
    if not index:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(chunks))
    length = 4 * _CHUNK
    n = -(-len(chunks) // 4)
    word = np.zeros((n, length), np.int32)
    gold = np.zeros((n, length), np.int32)
    mask = np.zeros((n, length), bool)
    for s in range(n):
        at = 0
        for c in order[4 * s:4 * s + 4]:
            lab, ids = chunks[c]
            word[s, at:at + len(ids)], gold[s, at:at + len(ids)], mask[s, at:at + len(ids)] = ids, lab, True
            at += len(ids)
    k = len(labels)
    # Rare languages weigh as much as frequent ones.
    share = np.bincount(gold[mask], minlength=k)
    weight = (share.sum() / (k * np.maximum(share, 1)))[gold] * mask
    places = _feature_places(list(index))
    scale = 1 / np.sqrt((places != BUCKETS).sum(axis=1, keepdims=True))
    flat = places.ravel()
    params = [np.zeros((BUCKETS + 1, k)), np.zeros((k, k))]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    onehot = np.eye(k)[gold]
    both = mask[:, 1:] & mask[:, :-1]
    seen = np.zeros((k, k))
    np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    for step in range(1, rounds + 1):
        scores = (params[0][places].sum(axis=1) * scale)[word]
        prob, expected = forward_backward(scores, mask, params[1])
        pull = (onehot - prob) * weight[:, :, None]
        by_word = np.stack([np.bincount(word[mask], weights=pull[:, :, j][mask], minlength=len(index)) for j in range(k)], axis=1) * scale
        grad = np.stack([np.bincount(flat, weights=np.repeat(by_word[:, j], places.shape[1]), minlength=BUCKETS + 1) for j in range(k)], axis=1)
        grad[BUCKETS] = 0
        total = mask.sum()
        for p, g, m in zip(params, (grad / total - 1e-6 * params[0], (seen - expected) / total - 1e-5 * params[1]), moments, strict=True):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.02 * (g * g - m[1])
            p += 0.2 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.98**step)) + 1e-8)
    return Crf(labels, params[0].astype(np.float32), params[1].astype(np.float32))


def training_sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_lang: int = SAMPLE_DOCS):
    """Stretches of at most ``per_lang`` or so documents per language that may be learnt from, on the driver."""
    usable = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), whole(text_col).alias("text")).where(
        learnable("id") & F.col("lang").isNotNull())
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return [], []
    cuts = F.create_map(*[x for c, n in counts.items() for x in (F.lit(c), F.lit(min(1.0, per_lang / n)))])
    draw = F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    start = F.pmod(F.xxhash64(F.lit(31), "id"), room).cast("int") + 1
    rows = usable.where(draw < F.element_at(cuts, F.col("lang"))).select(
        "id", "lang", F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("text")).collect()
    rows.sort(key=lambda r: (r["id"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def _document_labels(texts: list[str], model: Crf, known: dict[str, int], table: list[np.ndarray]) -> tuple[list[str], list[float]]:
    """Labels and scores of a few documents. ``known`` and ``table`` hold the scores of words met before."""
    found = [find_words(t.lower()) for t in texts]
    new = list({w for ws in found for w in ws} - known.keys())
    if new:
        first = len(known)
        known.update(zip(new, range(first, first + len(new)), strict=True))
        while len(table[0]) < len(known):
            table[0] = np.concatenate((table[0], np.zeros_like(table[0])))
        table[0][first:first + len(new)] = emissions(new, model.weights)
    sizes = np.array([len(ws) for ws in found], np.int64)
    segments = -(-sizes // SEGMENT)
    labels, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not sizes.sum():
        return labels, scores
    ids = np.fromiter((known[w] for ws in found for w in ws), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(texts)), sizes)
    within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.cumsum(segments) - segments, sizes) + within // SEGMENT
    col = within % SEGMENT
    total = int(segments.sum())
    sums = np.zeros((len(texts), len(model.labels)))
    for at in range(0, total, 4096):
        part = np.flatnonzero((row >= at) & (row < at + 4096)) if total > 4096 else slice(None)
        r, c = row[part] - at, col[part]
        grid = np.zeros((min(4096, total - at), SEGMENT, len(model.labels)), np.float32)
        mask = np.zeros(grid.shape[:2], bool)
        grid[r, c] = table[0][ids[part]]
        mask[r, c] = True
        prob = label_probabilities(grid, mask, model.transitions)[r, c]
        for j in range(prob.shape[1]):
            sums[:, j] += np.bincount(owner[part], weights=prob[:, j], minlength=len(texts))
    best = sums.argmax(axis=1)
    for i, ws in enumerate(found):
        if ws and any(ch.isalpha() for w in ws for ch in w):
            labels[i], scores[i] = model.labels[best[i]], float(min(1.0, max(0.0, sums[i, best[i]] / sizes[i])))
    return labels, scores


def predict_language(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        table = [np.zeros((1 << 16, len(model.labels) if model else 1), np.float32)]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 20):
                    size += len(texts[end])
                    end += 1
                if len(known) > _CACHE_WORDS:
                    known = {}
                group = texts[at:end]
                labels, scores = _document_labels(group, model, known, table) if model else (["und"] * len(group), [0.0] * len(group))
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())],
                    ["doc_id", "held_out", "lang_pred", "score"])
                at = end

    keyed = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), whole(text_col).alias("text"))
    return keyed.mapInArrow(run, f"doc_id {keyed.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the rows that may be learnt from, then label all."""
    texts, langs = training_sample(docs, text_col, lang_col, id_col)
    return predict_language(docs, fit(texts, langs) if texts else None, id_col, text_col)
