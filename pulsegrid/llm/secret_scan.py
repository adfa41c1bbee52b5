"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Two character bigram models are counted from labelled samples: random strings (what the fixed patterns find, and
hash digests in hexadecimal, base 32 and base 64) and ordinary identifiers (the words of the documents, alone and joined
to snake, kebab, path, camel and constant names of up to ``IDENTIFIER_CHARS`` characters, some with a number). A token of 20 or
more characters outside the fixed findings becomes a finding of its own when its log-likelihood ratio favours the
random model by a threshold in nats for each pair of characters, so length alone decides nothing. The threshold is set on
samples that the models were not counted from: half way between the values beyond which at most ``ERROR_RATE`` of ordinary and random ones lie.

The models are fitted on a bounded sample (``SAMPLE_DOCS``) and are two tables of 65 x 65 numbers, so they travel as
one literal; scoring happens inside a row without a shuffle. Work grows as n log n with the findings of a text, however
many they are: places come from running sums by doubling, overlaps from running maxima. Positions count code points, ends are exclusive. Null and
empty texts have no findings; very long texts are scanned whole. Without samples every ratio is zero and the threshold is
``THRESHOLD``. Empty tables give empty results. Repeated rows and other columns do not matter to ``find_secrets``; ``redact`` hands
every column on.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scratch import materialize
from pulsegrid.llm.common import hash_sample, let, whole

#: The base patterns, their kinds in rank order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "markov"]

CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: The alphabet of the models; a place beyond it stands for every other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-"
SAMPLE_DOCS = 20_000
#: Nats a pair by which the random model must be better where no held-out samples say more.
THRESHOLD = 0.5
#: Share of the held-out samples of a kind that may lie beyond the values between which the threshold is set.
ERROR_RATE = 0.0005
#: Thresholds are multiples of this.
THRESHOLD_STEP = 0.02
IDENTIFIER_CHARS = 60
#: A joined name is made at every word whose place is a multiple of this.
NAME_EVERY = 16
LEAST_CHARS = 20
LEAST_DISTINCT = 8
#: Weight, in pairs, of single-character frequencies in the models.
BACK_OFF = 20.0
#: Texts are cut into blocks of so many code points before stretches of them are taken.
BLOCK_CHARS = 1024
SPAN = "array<struct<start:int,kind:int,end:int>>"


class Model(NamedTuple):
    """Log-likelihood ratios of all character pairs, the threshold in nats a pair, and the error rates at it on held-out samples."""

    table: list[float]
    threshold: float
    missed: float | None = None
    false: float | None = None


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running ``join`` (a sum, ``least`` or ``greatest``) over an array, by doubling the reach of every place."""
    reach = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda r: r < F.size(values))
    return F.aggregate(reach, values, lambda a, r: F.transform(
        a, lambda x, i: F.when(i >= r, join(x, F.get(a, i - r))).otherwise(x)))


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Leftmost non-overlapping matches as spans; places follow from the lengths of matches and of what lies between."""
    def place(hits: Column) -> Column:
        steps = let(F.split(text, pattern, -1), lambda g: F.transform(hits, lambda h, i: F.length(F.get(g, i)) + F.length(h)))
        ends = let(steps, lambda x: _running(x, lambda u, v: u + v))
        return let(ends, lambda e: F.transform(hits, lambda h, i: F.struct(
            (F.get(e, i) - F.length(h)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"))))

    def chosen(hits: Column) -> Column:
        if keep is None:
            return place(hits)
        passed = F.transform(hits, keep)
        return let(passed, lambda ok: let(place(hits), lambda p: F.filter(p, lambda _, i: F.get(ok, i))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(
        F.size(hits) == 0, F.array().cast(SPAN)).otherwise(chosen(hits).cast(SPAN)))


def base_spans(text: Column) -> Column:
    """Findings of the fixed patterns, sorted by start and kind."""
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 6
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, 0, value), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))


def _bigrams(token: Column) -> Column:
    """Pairs of places in the alphabet, as one number each."""
    def place(i: Column) -> Column:
        found = F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
        return F.when(found == 0, F.lit(len(ALPHABET))).otherwise(found - 1)

    pairs = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: place(i) * (len(ALPHABET) + 1) + place(i + 1))
    return F.when(F.length(token) < 2, F.array().cast("array<int>")).otherwise(pairs)


def labelled_samples(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bound: int = SAMPLE_DOCS) -> DataFrame:
    """(token, random) pairs of a bounded sample of documents."""
    picked = hash_sample(docs.select(F.col(id_col).alias("id"), whole(text_col).alias("t")), "id", bound)
    parts = picked.select("id", "t", F.transform(base_spans(F.col("t")), lambda s: F.substring(
        F.col("t"), s["start"] + 1, s["end"] - s["start"])).alias("found"))
    digest = F.sha2(F.coalesce(F.col("id").cast("string"), F.lit("")), 256)
    base64 = F.translate(F.base64(F.unhex(digest)), "=", "")
    generated = F.array(digest, base64, F.translate(base64, "+/", "-_"), F.upper(F.conv(F.substring(digest, 1, 15), 16, 36)))
    prose = F.split(F.regexp_replace("t", "|".join([ASSIGN, ACCESS, HEX]), " "), r"[^A-Za-z0-9+/_-]+", -1)
    ordinary = let(F.filter(prose, lambda w: F.length(w).between(2, LEAST_CHARS - 1)), lambda w: F.concat(
        F.filter(w, lambda x: F.length(x) >= 4), _identifiers(w)))
    return parts.select(F.explode(F.concat(F.col("found"), generated)).alias("token"), F.lit(True).alias("random")).unionAll(
        picked.select(F.explode(ordinary).alias("token"), F.lit(False).alias("random")))


def _identifiers(words: Column) -> Column:
    """Names joined from two to six neighbouring words, in a style that follows a hash of its words."""
    def name(i: Column) -> Column:
        first = F.xxhash64(F.get(words, i), F.get(words, i + 1))
        part = F.slice(words, i + 1, F.pmod(first, F.lit(5)).cast("int") + 2)
        camel = F.array_join(F.transform(part, lambda w: F.initcap(w)), "")
        number = F.pmod(F.shiftright(first, 16), F.lit(1000)).cast("string")
        styles = [F.array_join(part, "_"), F.array_join(part, "-"), F.array_join(part, "/"), camel,
                  F.concat(F.get(part, F.lit(0)), camel), F.upper(F.array_join(part, "_")),
                  F.concat(F.array_join(part, "/"), F.lit("/"), camel), F.concat(F.array_join(part, "_"), F.lit("_"), number),
                  F.concat(camel, number), F.concat(F.lit("/"), F.array_join(part, "/"), F.lit("_"), camel)]
        style = F.pmod(F.shiftright(first, 32), F.lit(len(styles)))
        chosen = styles[-1]
        for k, made in enumerate(styles[:-1]):
            chosen = F.when(style == k, made).otherwise(chosen)
        return chosen

    names = F.transform(F.sequence(F.lit(0), F.size(words) - 2, F.lit(NAME_EVERY)), name)
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
        F.filter(names, lambda w: F.length(w) <= IDENTIFIER_CHARS))


def fit_models(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, random against ordinary.

    Pairs are smoothed towards the frequency of their second character, so a model that has hardly met the first one falls
    back on that. Only 2 x 65 x 65 counts reach the driver. Without samples every ratio is zero.
    """
    side = len(ALPHABET) + 1
    counts = {True: [0.0] * (side * side), False: [0.0] * (side * side)}
    tokens = samples if "count" in samples.columns else samples.groupBy("random", "token").count()
    pairs = tokens.select("random", "count", F.explode(_bigrams(F.col("token"))).alias("pair"))
    for row in pairs.groupBy("random", "pair").agg(F.sum("count").alias("n")).collect():
        counts[row["random"]][row["pair"]] += row["n"]

    def log_likelihood(n: list[float]) -> list[float]:
        seconds = [1.0 + sum(n[b::side]) for b in range(side)]
        firsts = [sum(n[a * side:(a + 1) * side]) for a in range(side)]
        return [
            math.log((n[a * side + b] + BACK_OFF * seconds[b] / sum(seconds)) / (firsts[a] + BACK_OFF))
            for a in range(side) for b in range(side)
        ]

    return [x - y for x, y in zip(log_likelihood(counts[True]), log_likelihood(counts[False]), strict=True)]


def _held_out() -> Column:
    return F.pmod(F.xxhash64(F.lit(5), "token"), F.lit(4)) == 0


def fit(samples: DataFrame, error_rate: float = ERROR_RATE) -> Model:
    """Both models from three quarters of the distinct samples, the threshold and its error rates from the others.

    Only tokens that may become findings count for the threshold. What reaches the driver is a count per label and step of
    the ratio. A sample that repeats counts as often as it is met.
    """
    tokens = materialize(samples.groupBy("random", "token").count())
    table = fit_models(tokens.where(~_held_out()))
    step = F.floor(_ratio(F.col("token"), _literal(table)) / THRESHOLD_STEP).cast("long")
    rated = tokens.where(_held_out() & _eligible(F.col("token"))).groupBy("random", step.alias("step")).agg(F.sum("count").alias("n"))
    steps = sorted((r["step"], r["random"], r["n"]) for r in rated.collect())
    total = {label: sum(n for _, random, n in steps if random == label) for label in (True, False)}
    if not total[True] or not total[False]:
        return Model(table, THRESHOLD)

    def above(label: bool, least: int) -> float:
        return sum(n for at, random, n in steps if random == label and at >= least) / total[label]

    ends = [at for at, _, _ in steps]
    low = min(at + 1 for at in ends if above(False, at + 1) <= error_rate)
    high = max(at for at in ends if 1.0 - above(True, at) <= error_rate)
    chosen = (low + high) // 2 if high > low else low
    return Model(table, chosen * THRESHOLD_STEP, 1.0 - above(True, chosen), above(False, chosen))


def _literal(table: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")


def _ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio of a token for each of its pairs."""
    total = F.aggregate(_bigrams(token), F.lit(0.0), lambda a, p: a + F.get(table, p))
    return total / F.greatest(F.length(token) - 1, F.lit(1))


def _eligible(token: Column) -> Column:
    return (F.length(token) >= LEAST_CHARS) & (F.size(F.array_distinct(F.split(token, ""))) >= LEAST_DISTINCT)


def merged_spans(text: Column, base: Column, model: Model) -> Column:
    """The spans in ``base`` and, outside of them, tokens that the random model explains better; sorted by start and kind."""
    table = _literal(model.table)
    looks_random = lambda hit: _eligible(hit) & (_ratio(hit, table) >= model.threshold)
    far = F.lit((1 << 31) - 1)

    def free(spans: Column) -> Column:
        # A token is free when what starts before it has ended and the next of the base findings starts behind it.
        ends = F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0))
        starts = F.reverse(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(far)))
        before = let(ends, lambda e: _running(e, F.greatest))
        behind = F.reverse(let(starts, lambda x: _running(x, F.least)))
        return let(F.struct(before.alias("b"), behind.alias("a")), lambda x: F.filter(spans, lambda s, i: (s["kind"] < 3) | (
            (F.get(x["b"], i) <= s["start"]) & (F.get(x["a"], i) >= s["end"]))))

    return let(_spans(text, CANDIDATE, 3, looks_random), lambda found: F.when(F.size(found) == 0, base).otherwise(
        let(F.array_sort(F.concat(base, found)), free)))


def _findings(text_col: str, model: Model) -> Column:
    """Struct of base spans and all spans, both sorted by start and kind."""
    return let(whole(text_col), lambda t: let(base_spans(t), lambda base: F.struct(
        base.alias("base"), merged_spans(t, base, model).alias("all"))))


def _as_model(docs: DataFrame, model: Model | list[float] | None, id_col: str, text_col: str) -> Model:
    """The model given, one of a bare table of ratios, or one fitted on the documents."""
    if model is None:
        return fit(labelled_samples(docs, text_col, id_col))
    return model if isinstance(model, Model) else Model(list(model), THRESHOLD)


def find_secrets(docs: DataFrame, model: Model | list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``base`` and ``spans`` (start, kind, end) per document; the model is fitted on the documents if none is given."""
    model = _as_model(docs, model, id_col, text_col)
    found = docs.select(F.col(id_col), _findings(text_col, model).alias("f"))
    return found.select(id_col, F.col("f.base").alias("base"), F.col("f.all").alias("spans"))


def render(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, model: Model | list[float] | None = None, id_col: str = "doc_id", text_col: str = "text",
           mark: str = "[SECRET]", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with every finding replaced by ``mark``; overlapping findings become one. ``length_col`` follows the text."""
    model = _as_model(docs, model, id_col, text_col)
    text = F.col(text_col)

    def between(blocks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / BLOCK_CHARS).cast("int")
        held = F.slice(blocks, first + 1, F.floor(end / BLOCK_CHARS).cast("int") - first + 1)
        return F.substring(F.array_join(held, ""), start - first * BLOCK_CHARS + 1, end - start)

    def cut(spans: Column) -> Column:
        def parts(x: Column) -> Column:
            before = lambda i: F.coalesce(F.get(x["ends"], i - 1), F.lit(0))
            kept = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(
                between(x["blocks"], before(i), s["start"]), F.lit(mark))).otherwise(F.lit("")))
            return F.concat(F.array_join(kept, ""), between(x["blocks"], F.element_at(x["ends"], -1), F.length(text)))

        ends = let(F.transform(spans, lambda s: s["end"]), lambda e: _running(e, F.greatest))
        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))
        return let(F.struct(ends.alias("ends"), blocks.alias("blocks")), parts)

    marked = docs.withColumn("__found", _findings(text_col, model)["all"])
    clean = F.when(F.size("__found") > 0, cut(F.col("__found"))).otherwise(text)
    changed = {text_col: clean}
    if length_col in docs.columns:
        changed[length_col] = F.when(F.size("__found") > 0, F.length(clean)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)
    return marked.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
