"""Quality rules as a bitmask ledger: every rule is evaluated once and leaves one bit.

``rule_ledger`` stores measurements and failure bits per document; ``apply_policy`` and ``ablation`` read only
the ledger, so a new policy version costs no second look at the texts.

Everything happens inside a row, so nothing is shuffled and a hot source does not matter. Null and empty texts
measure zero everywhere. Repeated rows are rows of their own. Columns of the input other than id and text are
ignored by ``rule_ledger`` and handed on by ``filter_documents``. Repeated windows are found by 64-bit hashes
of eight words within one document.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import SPACE_CHARS, let, whole, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rule k owns bit k; the order is part of the stored format, new rules go to the end.
RULES: list[tuple[str, Callable[[Callable[[str], Column]], Column]]] = [
    ("few_words", lambda m: m("n_words") < 20),
    ("repeated_windows", lambda m: 100 * m("n_repeat_words") > 30 * m("n_words")),
    ("symbols", lambda m: 5 * m("n_symbols") > m("word_chars")),
    ("repeated_lines", lambda m: (m("n_lines") >= 4) & (2 * m("n_dup_lines") > m("n_lines"))),
    ("long_words", lambda m: m("word_chars") > 40 * m("n_words")),
]
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Policies by version: a document is rejected when it fails any of the rules named.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "long_words"),
}


def policy_mask(policy: str | tuple[str, ...]) -> int:
    return sum(BITS[name] for name in (POLICIES[policy] if isinstance(policy, str) else policy))


def _repeat_words(tokens: Column) -> Column:
    """Words inside eight-word windows that occur at least twice."""
    hashes = F.transform(tokens, lambda w: F.xxhash64(w))
    size = F.size(tokens)

    def covered(windows: Column) -> Column:
        tagged = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(tagged, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
            lambda x: x["i"],
        )))
        steps = let(places, lambda p: F.transform(
            p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    windows = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW)))))
    found = let(windows, lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))
    return F.when(size <= WINDOW, F.lit(0).cast("long")).otherwise(found)


def _measure(text: Column) -> Column:
    bare = F.translate(text, SPACE_CHARS, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    counts = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    chars = let(bare, lambda b: F.struct(
        F.length(b).cast("long").alias("word_chars"),
        (F.length(b) - F.length(F.translate(b, SYMBOLS, ""))).cast("long").alias("n_symbols")))
    by_line = let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return let(F.struct(counts.alias("a"), chars.alias("b"), by_line.alias("c")), lambda s: F.struct(
        s["a"]["n_words"].alias("n_words"), s["b"]["word_chars"].alias("word_chars"), s["b"]["n_symbols"].alias("n_symbols"),
        s["c"]["n_lines"].alias("n_lines"), s["c"]["n_dup_lines"].alias("n_dup_lines"),
        s["a"]["n_repeat_words"].alias("n_repeat_words")))


def _mask(m: Callable[[str], Column]) -> Column:
    bits = [F.when(rule(m), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return total.cast("long")


def rule_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements and ``fail_mask``, in which bit k tells that rule k failed."""
    measured = docs.select(F.col(id_col), _measure(whole(text_col)).alias("m")).select(id_col, "m.*")
    return measured.withColumn("fail_mask", _mask(F.col))


def rejected(policy: str | tuple[str, ...] = "v1", mask: Column | None = None) -> Column:
    """Whether a mask breaks a policy."""
    mask = F.col("fail_mask") if mask is None else mask
    return mask.bitwiseAND(F.lit(policy_mask(policy)).cast("long")) != 0


def apply_policy(ledger: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    return ledger.withColumn("kept", ~rejected(policy))


def ablation(ledger: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """Per rule of a policy: documents failing it, documents only it rejects, and documents kept without it.

    Masks are counted first, so what is shuffled has at most two to the number of rules rows.
    """
    mask = policy_mask(policy)
    names = [n for n in BITS if BITS[n] & mask]
    held = F.col("fail_mask").bitwiseAND(F.lit(mask).cast("long"))
    counted = ledger.groupBy(held.alias("fails")).agg(F.count(F.lit(1)).alias("n"))
    bit = F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.lit(BITS[n]).cast("long") for n in names])))
    return counted.select("fails", "n", bit.alias("rule", "bit")).groupBy("rule").agg(
        F.sum(F.when(F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(F.col("fails") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_rejected_only_by_it"),
        F.sum(F.when((F.col("fails") == F.col("bit")) | (F.col("fails") == 0), F.col("n")).otherwise(0)).alias("n_kept_without_it"),
    )


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Bits that any document failed and bits that all failed, by bitwise aggregation."""
    return ledger.agg(F.bit_or("fail_mask").alias("any_failed"), F.bit_and("fail_mask").alias("all_failed"))


def filter_documents(docs: DataFrame, policy: str | tuple[str, ...] = "v1", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with the columns they came with."""
    ledger = let(_measure(whole(text_col)), lambda m: _mask(lambda name: m[name]))
    return docs.where(~rejected(policy, ledger))


def as_policy_table(policies: Mapping[str, tuple[str, ...]] = POLICIES) -> dict[str, int]:
    """Policy versions as masks, the form to store beside a ledger."""
    return {version: policy_mask(names) for version, names in policies.items()}
