"""MinHash near-duplicate detection by min-max hashing.

A document is its set of distinct five-word shingles (64-bit hashes). Under each of ``PERMUTATIONS`` permutations both the
minimum and the maximum are kept, which gives two signature values for one hash evaluation. Four values make a band
key; documents that share a band key are candidates, and a candidate counts as a link only after its full sets are
compared: 100 * common >= 75 * union. With 40 bands a link at the very threshold is missed with a probability of
2.5e-7, above it far less.

Hot groups: equal sets become one class (one row) before anything is paired. Each document is first
compared with one smaller id out of its buckets; what this links becomes one component. Only members of different components are
paired after that: with the smallest id of each bucket, and then all with all, block by block inside tasks that hold
full sets and return links only. Links and labels stay tables throughout. Texts of documents without a candidate are
read once; which ones are read again is told by a bitmap of fixed size, and only as a filter before an exact join.

Null and empty texts have no shingles and link with nothing; an empty table gives no rows. A very long text is one set in one task. Rows with a null id are their own component, null.
Rows that share an id count as one document. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scratch import materialize
from pulsegrid.llm.common import free_unused, tidy, whole

SHINGLE = 5
SIMILARITY = 75
PERMUTATIONS = 80
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Blocks of a unit of work have about so many rows and shingles at most.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
_BITMAP_BITS = 1 << 23
_CACHE_WORDS = 200_000
_SALTS = 64

_rng = np.random.default_rng(20240607)
_PLACE = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALE = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_MIX = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _CACHE_WORDS:
            self[word] = value
        return value


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes high bits into low ones."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, word_hash: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    # For bytes, lower() and split() know exactly A-Z and the six white space characters.
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hash.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE)
    joined = h[:n - size + 1] * _PLACE[0]
    for k in range(1, size):
        joined = joined + h[k:n - size + 1 + k] * _PLACE[k]
    return np.unique(_scramble(joined + np.uint64(size)))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys, one row per non-empty set."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    every = np.concatenate(sets)
    low = np.empty((PERMUTATIONS, len(sets)), np.uint64)
    high = np.empty_like(low)
    for p in range(PERMUTATIONS):
        v = every * _SCALE[p] + _SHIFT[p]
        low[p], high[p] = np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for side, values in enumerate((low, high)):
        for g in range(PERMUTATIONS // ROWS):
            b = 2 * g + side
            mixed = sum((values[ROWS * g + r] * _MIX[r] for r in range(ROWS)), np.uint64(b + 1))
            keys[:, b] = _scramble(mixed)
    return keys


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_hash`` (128 bits, null without shingles) and ``bands`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = _WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingle_set(t, word_hash) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                if full:
                    for i, keys in zip(full, band_keys([sets[i] for i in full]).view(np.int64), strict=True):
                        bands[i] = keys
                digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set_hash", "bands"])

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text"))
    return keyed.mapInArrow(tidy(run), "doc_id long, n_shingles long, set_hash binary, bands array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``shingles`` of the documents whose id is in ``wanted(id)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = _WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingle_set(t, word_hash).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    bit = F.pmod(F.xxhash64("id"), F.lit(_BITMAP_BITS))
    # At most 131,072 rows whatever the number of ids.
    bitmap = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits"))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).where("id IS NOT NULL")
    marked = keyed.withColumn("bit", bit).withColumn("word", F.shiftright("bit", 6))
    near = marked.join(F.broadcast(bitmap), "word").where(
        F.call_function("shiftright", F.col("bits"), F.col("bit").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)
    return near.select("id", "text").mapInArrow(tidy(run), "id long, shingles array<long>")


def confirm(docs: DataFrame, pairs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(full_sets(docs, wanted, id_col, text_col))
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return common.where(100 * F.col("both") >= SIMILARITY * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` for every id in ``links(a, b)``: the smallest id that can be reached.

    Each round takes the least label among the neighbours and then the label of that label, so chains shorten
    fast; rounds are cut by stored tables and end when no label has changed.
    """
    both = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("theirs")), "b")
        least = seen.groupBy(F.col("a").alias("id")).agg(F.min("theirs").alias("theirs"))
        step = labels.join(least, "id").select("id", "component", F.least("component", "theirs").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("component").alias("further"))
        moved = materialize(step.join(jump, "next").select("id", F.least("next", "further").alias("new"), "component"))
        changed = moved.where(F.col("new") < F.col("component")).limit(1).count()
        labels = moved.select("id", F.col("new").alias("component"))
        if not changed:
            return labels


def _comparable(x: str, y: str):
    """Sizes that still allow the similarity."""
    small, large = F.least(x, y), F.greatest(x, y)
    return 100 * small >= SIMILARITY * large


def _exhaustive_links(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links between different components among documents that share a bucket.

    Buckets with the same hub are one unit of work. A unit is cut into blocks, every pair of blocks is compared on
    full sets inside one task, and only links leave it.
    """
    units = rows.select(F.col("hub.rep").alias("hub"), "rep", "n", "component").distinct()
    blocks = units.groupBy("hub").agg(F.ceil(F.greatest(
        F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sets = materialize(full_sets(docs, units.select(F.col("rep").alias("id")).distinct(), id_col, text_col))
    dealt = units.join(blocks, "hub").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.join(sets.withColumnRenamed("id", "rep"), "rep").select(
        "hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "shingles")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rep, comp, own = (table.column(c).to_numpy() for c in ("rep", "component", "own"))
        lists = table.column("shingles").combine_chunks()
        flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        sizes = np.diff(ends)
        i, j = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        mark = np.zeros(len(flat) and flat.max() + 1, np.int64)
        out = []
        for x in left:
            y = right[(comp[right] != comp[x]) & (100 * np.minimum(sizes[right], sizes[x]) >= SIMILARITY * np.maximum(sizes[right], sizes[x]))]
            if i == j:
                y = y[y > x]
            if not len(y):
                continue
            mark[flat[ends[x]:ends[x + 1]]] = 1
            span = np.repeat(ends[y] - (np.cumsum(sizes[y]) - sizes[y]), sizes[y]) + np.arange(sizes[y].sum())
            common = np.add.reduceat(mark[flat[span]], np.cumsum(sizes[y]) - sizes[y])
            mark[flat[ends[x]:ends[x + 1]]] = 0
            out += [(int(rep[x]), int(rep[z])) for z in y[100 * common >= SIMILARITY * (sizes[x] + sizes[y] - common)]]
        free_unused()
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return dealt.groupBy("hub", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Bucket members with their component, of buckets that hold more than one."""
    label = labels.select(F.col("id").alias("rep"), "component")
    rows = members.join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = rows.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"),
        F.min(F.struct("rep", "component")).alias("first")).where("low < high")
    return materialize(rows.join(mixed.select("key", "size", F.col("first.component").alias("hub_component")), "key"))


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """Members that are not of their hub's component, with the hub."""
    apart = rows.where((F.col("component") != F.col("hub_component")) & _comparable("n", "hub.n"))
    return apart.select(F.col("hub.rep").alias("a"), F.col("rep").alias("b"))


def _with_class(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with ``class_id`` where their set has copies. A large group of copies, or of rows without a set, is spread over tasks by salt."""
    salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    placed = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)).cast("int"))
    return placed.join(salted, ["set_hash", "salt"], "left").drop("salt")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class_id`` (least id with an equal set), ``component_id`` and ``kept`` per row of ``docs``."""
    signed = materialize(signatures(docs, id_col, text_col))
    usable = signed.where("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    copies = usable.groupBy("set_hash").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    classes = copies.select("set_hash", "class_id")
    reps = _with_class(usable, classes).where(F.col("doc_id") == F.coalesce("class_id", "doc_id")).select(
        F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands")
    rows = reps.select(F.explode("bands").alias("key"), "rep", "n")
    buckets = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.max("rep").alias("last")).where("last > hub.rep")
    members = materialize(rows.join(buckets.select("key", "hub"), "key"))

    # First each document with one hub, the smallest: large groups become one component by as many pairs as they have members.
    to_hub = members.where((F.col("rep") != F.col("hub.rep")) & _comparable("n", "hub.n")).select(
        F.col("hub.rep").alias("a"), F.col("rep").alias("b"))
    checked = materialize(to_hub.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = materialize(confirm(docs, checked, id_col, text_col))
    labels = components(links)
    # Then with the hubs of its other buckets, and last with all members, as far as components still differ.
    pairs = materialize(_hub_pairs(_labelled(members, labels)).distinct().join(checked, ["a", "b"], "left_anti"))
    links = materialize(links.unionAll(confirm(docs, pairs, id_col, text_col)))
    rest = _exhaustive_links(docs, _labelled(members, components(links)), id_col, text_col)
    labels = components(links.unionAll(rest))
    final = labels.select(F.col("id").alias("group_id"), "component")

    out = _with_class(signed.select("doc_id", "n_shingles", "set_hash"), classes).withColumn(
        "class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(final, F.col("class_id") == F.col("group_id"), "left").withColumn("component_id", F.coalesce("component", "class_id"))
    return out.select("doc_id", "n_shingles", "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with the columns it came with; null ids stay."""
    lost = near_duplicates(docs, id_col, text_col).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(lost, id_col, "left_anti").select(*[f"`{c}`" for c in docs.columns])
