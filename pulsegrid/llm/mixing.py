"""Mixing sources to target weights by Poisson replication.

A source s with n documents and target weight w gets the mean repetition rate w * total / n. Each document draws
its number of copies by inverting the Poisson distribution of that mean at a uniform number taken from a hash of
seed and id, is exploded by the count, and all copies are shuffled globally by another hash.

The draw needs no state, so lost tasks repeat it exactly. Only counts per source are aggregated; the third of all
rows that one source may hold never meets in one task. Null sources are the source ''; rows with a null id draw by
all their columns instead. Rows repeated in the input draw alike and each get their copies. An empty table gives an empty table.
Weights that are missing for a source mean that it is left out; with no weights given they follow
``count ** alpha``. Other columns are handed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many sources their table is sent to every task; each row of it is below 1 KB at usual rates.
BROADCAST_SOURCES = 10_000
_SALTS = 64


def uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the parts, joined by colons."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, until what is left is below the draw's resolution."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log_p"), F.array(F.exp(-rate)).alias("cdf"))
    return F.aggregate(
        F.sequence(F.lit(1), last), start,
        lambda a, k: F.struct(
            (a["log_p"] + F.ln(rate) - F.ln(k.cast("double"))).alias("log_p"),
            F.concat(a["cdf"], F.array(
                F.element_at(a["cdf"], -1) + F.exp(a["log_p"] + F.ln(rate) - F.ln(k.cast("double"))))).alias("cdf"),
        ),
        lambda a: a["cdf"],
    )


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5,
                 total: float | None = None, source_col: str = "source") -> DataFrame:
    """One row per source with a positive weight: ``source``, ``n``, ``rate``. ``total`` is the wanted size, by default the input's."""
    name = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    counts = docs.groupBy(name.alias("source")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.pow("n", F.lit(float(alpha))))
    else:
        pairs = [x for s, w in sorted(weights.items()) for x in (F.lit(s), F.lit(float(w)))]
        known = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")
        weighted = counts.withColumn("weight", F.element_at(known, F.col("source"))).where(F.col("weight") > 0)
    sums = weighted.agg(F.sum("weight").alias("weights"), F.sum("n").alias("held")).first()
    rows = counts.agg(F.sum("n")).first()[0] if weights is not None else sums["held"]
    size = float(total if total is not None else rows or 0.0)
    return weighted.select("source", "n", (F.col("weight") / F.lit(float(sums["weights"] or 1.0)) * F.lit(size) / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, total: float | None = None,
                seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The input's columns in struct ``doc``, once per copy, with ``copy_no`` (from 1), ``n_copies``, ``rate`` and ``shuffle_key``.

    Partitions and rows within them follow ``shuffle_key``, a hash of seed, id and copy: a global random order.
    """
    rates = source_rates(docs, weights, alpha, total, source_col).select(
        F.col("source").alias("__source"), "rate", poisson_cdf(F.col("rate")).alias("cdf"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__source"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(rates), "__source")
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.coalesce(F.col("doc")[id_col].cast("string"), F.to_json("doc"))), F.lit(_SALTS)).cast("int")
        joined = keyed.withColumn("__salt", salt).join(salted, ["__source", "__salt"])
    key = F.coalesce(F.col("doc")[id_col].cast("string"), F.concat(F.lit("null:"), F.to_json("doc")))
    draw = uniform(seed, "count", key)
    drawn = joined.withColumn("__u", draw).withColumn("n_copies", F.size(F.filter("cdf", lambda c: F.col("__u") >= c)))
    copies = drawn.where(F.col("n_copies") > 0).select(
        "doc", "rate", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy_no"))
    keyed_copies = copies.withColumn("shuffle_key", uniform(seed, "order", key, F.col("copy_no")))
    return keyed_copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``mix_sources`` with the columns of the input only."""
    return mix_sources(docs, **options).select("doc.*")
