"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

1. A task cuts its texts into pre-tokens, some MB (a *block*) at a time, and numbers a block's distinct words. Each word goes
   to its bucket with its block and its place there; a bucket's words come from all blocks and each is encoded once.
2. Ids go back to their block, one row per block and bucket. Texts, as the numbers of their words in order, meet the ids of
   their block and are reassembled by position.
3. Decoding looks every id up in the table of token bytes.

A frequent word occurs once per block, so no key is hot; no word passes through the driver or to all tasks. A task holds one block, a bucket's
task the words of a bounded table (``KNOWN_BYTES``; beyond it words are encoded again). A text longer than a block is a block of its own.

Texts are cut twice, for the words and for the numbers, because storing the numbers would cost more disk than cutting again. Rows must
come in the same order both times, as they do from files; each block is compared, and a difference is an error (write ``docs`` to a table
first then). Rows that repeat are each returned. Null and empty texts have no ids, an empty table no rows. Other columns do not
matter. The vocabulary file's path is a parameter; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import free_unused, tidy, whole
from pulsegrid.llm.token_counts import pieces

#: Bytes of text that are numbered together.
BLOCK_BYTES = 1 << 22
#: Buckets of words per shuffle partition, so that partitions get about as many words each.
BUCKETS = 8
#: Words (and their ids) that a task of buckets remembers, in bytes.
KNOWN_BYTES = 1 << 25

# Letters that are letters in every edition of Unicode in use, and marks that stand apart behind them.
_LETTERS = r"[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+"
_MARKS = "[.,;:!?]"

# A blank after other white space is no safe place to cut.
_UNSAFE_BLANK = r"[\s\v\x1c-\x1f\x85\pZ] "


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def make_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def split_pieces(strings: pa.Array, pattern: str, letter_runs: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Pre-tokens of pieces of text: the distinct words, numbers of the words piece by piece, and how many each piece has.

    ``letter_runs`` says that the pattern takes a run of letters with one blank in front whole and keeps a mark behind it apart. Most
    pieces are such runs, or one with a mark behind it, and Arrow takes them as whole columns; only the rest is searched.
    """
    find = regex.compile(pattern).findall
    n = len(strings)
    run, marked = np.zeros(n, bool), np.zeros(n, bool)
    if letter_runs:
        run = pc.match_substring_regex(strings, f"^ ?{_LETTERS}$").to_numpy(zero_copy_only=False).astype(bool)
        marked = pc.match_substring_regex(strings, f"^ ?{_LETTERS}{_MARKS}$").to_numpy(zero_copy_only=False).astype(bool)
    at_run, at_marked, at_rest = (np.flatnonzero(x) for x in (run, marked, ~run & ~marked))
    before = strings.take(pa.array(at_marked))
    found = [find(p) for p in strings.take(pa.array(at_rest)).to_pylist()]
    every = pa.concat_arrays([
        strings.take(pa.array(at_run)), pc.utf8_slice_codeunits(before, 0, -1), pc.utf8_slice_codeunits(before, -1),
        pa.array(list(chain.from_iterable(found)), pa.string())])
    coded = every.dictionary_encode()
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.ones(n, np.int64)
    sizes[at_marked] = 2
    sizes[at_rest] = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(sizes) - sizes
    flat = np.empty(len(numbers), np.int64)
    a, b = len(at_run), len(at_run) + len(at_marked)
    flat[starts[at_run]] = numbers[:a]
    flat[starts[at_marked]] = numbers[a:b]
    flat[starts[at_marked] + 1] = numbers[b:b + len(at_marked)]
    rest = sizes[at_rest]
    flat[np.repeat(starts[at_rest] - (np.cumsum(rest) - rest), rest) + np.arange(rest.sum())] = numbers[b + len(at_marked):]
    return coded.dictionary, flat, sizes


def byte_groups(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold about ``size`` bytes of text, or one longer text."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        stop = max(int(np.searchsorted(ends, done + size, "right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def cut_texts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as numbers of pieces: the pieces, their numbers text by text, where each text starts, and the order of texts.

    Where every blank is a safe place, Arrow cuts the texts; the others come last and are cut one by one.
    """
    unsafe = pc.match_substring_regex(texts, _UNSAFE_BLANK).to_numpy(zero_copy_only=False).astype(bool)
    plain, odd = np.flatnonzero(~unsafe), np.flatnonzero(unsafe)
    lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    heads = np.cumsum(sizes) - sizes
    coded = flat.dictionary_encode()
    # A first piece has no blank in front, all others have one.
    strings = [pc.binary_join_element_wise(pa.scalar(""), coded.dictionary, " "), flat.take(pa.array(heads))]
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    numbers[heads] = len(coded.dictionary) + np.arange(len(heads))
    if len(odd):
        own = [pieces(t) for t in texts.take(pa.array(odd)).to_pylist()]
        first = len(coded.dictionary) + len(heads)
        place = {w: first + k for k, w in enumerate(dict.fromkeys(chain.from_iterable(own)))}
        strings.append(pa.array(list(place), pa.string()))
        numbers = np.concatenate((numbers, np.fromiter(map(place.__getitem__, chain.from_iterable(own)), np.int64)))
        sizes = np.concatenate((sizes, [len(x) for x in own])).astype(np.int64)
    return pa.concat_arrays(strings), numbers, np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), np.concatenate((plain, odd))


class Block:
    """The distinct words of some texts with their numbers, and the texts as numbers.

    Words are numbered by class, then bucket, then as they were found. Classes put the 128 most frequent words first and the next 16 256 behind
    them, so that most numbers take one or two bytes when packed.
    """

    def __init__(self, texts: pa.Array, pattern: str, letter_runs: bool, buckets: int):
        strings, numbers, bounds, self.order = cut_texts(texts)
        words, flat, sizes = split_pieces(strings, pattern, letter_runs)
        times = np.bincount(flat, np.repeat(np.bincount(numbers, minlength=len(strings)), sizes), len(words))
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(words))
        self.kind = (rank >= 1 << 7).astype(np.int8) + (rank >= 1 << 14)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))
        self.bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        number = np.empty(len(words), np.int64)
        number[np.lexsort((self.bucket, self.kind))] = np.arange(len(words))
        # Tells another numbering: words by their places.
        self.check = int((hashes * (2 * number.astype(np.uint64) + np.uint64(1))).sum(dtype=np.uint64) >> np.uint64(1))
        self.words = words
        self._cut = flat, sizes, numbers, bounds, number

    def codes(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, in ``order``, and where each text starts."""
        flat, sizes, numbers, bounds, number = self._cut
        each = sizes[numbers]
        return _gather(number[flat], (np.cumsum(sizes) - sizes)[numbers], each), np.concatenate(([0], np.cumsum(each)))[bounds]

    def bucket_rows(self, block: int) -> pa.RecordBatch:
        """One row per bucket: its words by class one behind the other, their lengths, and how many there are of the first classes."""
        order = np.lexsort((self.kind, self.bucket))
        sent, bucket, kind = self.words.take(pa.array(order)), self.bucket[order], self.kind[order]
        own, starts = np.unique(bucket, return_index=True)
        bounds = np.append(starts, len(bucket)).astype(np.int64)
        size = pc.binary_length(sent).to_numpy(zero_copy_only=False).astype(np.int64)
        data = b"".join(sent.cast(pa.binary()).to_pylist())
        per_class = [np.add.reduceat((kind == c).astype(np.int32), starts) if len(starts) else np.zeros(0, np.int32) for c in (0, 1)]
        n = len(own)
        return pa.RecordBatch.from_arrays(
            [pa.array(own.astype(np.int32)), pa.array(np.full(n, block, np.int64)), pa.array(np.full(n, self.check, np.int64)),
             pa.array(per_class[0], pa.int32()), pa.array(per_class[1], pa.int32()),
             _binary(data, np.concatenate(([0], np.cumsum(size)))[bounds]), _packed(size, bounds)],
            ["bucket", "block", "check", "n0", "n1", "words", "sizes"])


def cut_blocks(
    batches: Iterator[pa.RecordBatch], pattern: str, letter_runs: bool, buckets: int, block_bytes: int
) -> Iterator[tuple[int, pa.RecordBatch, Block]]:
    """Number, rows and ``Block`` of every stretch of a task's rows; the number is the same whenever the task is run."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for part in byte_groups(batch, "text", block_bytes):
            yield number, part, Block(part.column("text"), pattern, letter_runs, buckets)
            number += 1


def _sizes(codes: np.ndarray) -> np.ndarray:
    """Bytes that each number takes when packed."""
    return 1 + sum((codes >= 1 << 7 * k).astype(np.int64) for k in range(1, 4))


def _pack(codes: np.ndarray) -> bytes:
    """Numbers below 2^28 in one to four bytes of seven bits, the last of each below 128."""
    sizes, place = _sizes(codes)[:, None], np.arange(4)[None, :]
    out = ((codes[:, None] >> 7 * place) & 127).astype(np.uint8)
    out[place < sizes - 1] |= 128
    return out[place < sizes].tobytes()


def _packed(codes: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One packed value per stretch of ``bounds``."""
    return _binary(_pack(codes), np.concatenate(([0], np.cumsum(_sizes(codes))))[bounds])


def _binary(data: bytes, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [
        None, pa.py_buffer(bounds.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    value = (raw[starts] & 127).astype(np.int64)
    for k in range(1, 4):
        more = np.flatnonzero(ends - starts >= k)
        value[more] |= (raw[starts[more] + k] & 127).astype(np.int64) << 7 * k
    return value


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values of a column, one behind the other, and where each value starts and the last ends."""
    data = b"".join(packed.to_pylist())
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) < 128)
    cuts = np.cumsum(np.concatenate(([0], pc.binary_length(packed).to_numpy(zero_copy_only=False))))
    return _unpack(data), np.searchsorted(ends, cuts)


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches ``pool[start:start + size]`` one behind the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def encode_buckets(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """Rows of buckets with ``ids`` of all words one behind the other and ``sizes``, packed, how many each has.

    Rows of a bucket lie together, and a word is encoded when a bucket first brings it. Ids take two bytes where the vocabulary allows it.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = make_encoding(path, pattern)
        width = _width(encoding.n_vocab)
        known: dict[bytes, bytes] = {}
        bucket, held, step = None, 0, np.dtype(width).itemsize
        for batch in batches:
            ids, sizes = [], []
            for own, data, lengths in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "sizes")), strict=True):
                if own != bucket or held > KNOWN_BYTES:
                    known, bucket, held = {}, own, 0
                ends = np.cumsum(_unpack(lengths)).tolist()
                words = [data[a:b] for a, b in zip([0, *ends], ends)]
                for w in words:
                    if w not in known:
                        known[w] = np.asarray(encoding.encode_ordinary(w.decode()), width).tobytes()
                        held += len(w) + len(known[w]) + 200
                mine = [known[w] for w in words]
                ids.append(b"".join(mine))
                sizes.append(_pack(np.fromiter(map(len, mine), np.int64, len(mine)) // step))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("block", "bucket", "check", "n0", "n1")), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary()),
                 pa.array([step] * len(ids), pa.int32())], ["block", "bucket", "check", "n0", "n1", "ids", "sizes", "width"])

    return words.mapInArrow(tidy(encode), "block long, bucket int, check long, n0 int, n1 int, ids binary, sizes binary, width int")


def _width(n_vocab: int) -> str:
    return "<u2" if n_vocab <= 1 << 16 else "<i4"


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", letter_runs: bool = False,
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``ids`` (little-endian 32-bit numbers in one binary value), one row per row of ``docs``."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _part, block in cut_blocks(batches, pattern, letter_runs, buckets, block_bytes):
            yield block.bucket_rows(number)

    def numbers_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, block in cut_blocks(batches, pattern, letter_runs, buckets, block_bytes):
            rows = part.select(["doc_id", "text_hash"]).take(pa.array(block.order))
            codes, bounds = block.codes()
            n = len(block.order)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, number, np.int64)), pa.array(np.full(n, block.check, np.int64)), *rows.columns,
                 _packed(codes, bounds)], ["block", "check", "doc_id", "text_hash", "codes"])

    words = keyed.mapInArrow(tidy(words_of), "bucket int, block long, check long, n0 int, n1 int, words binary, sizes binary")
    ids = encode_buckets(words.repartition("bucket").sortWithinPartitions("bucket"), path, pattern)
    texts = keyed.mapInArrow(tidy(numbers_of), f"block long, check long, doc_id {id_type}, text_hash long, codes binary")
    return texts.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(
        _reassemble, f"doc_id {id_type}, text_hash long, ids binary")


def _reassemble(texts: pa.Table, ids: pa.Table) -> pa.Table:
    """Ids of a block's texts, from the numbers of their words and the ids of its buckets."""
    ids = ids.sort_by("bucket")
    if set(texts.column("check").to_pylist()) - {0} != set(ids.column("check").to_pylist()) - {0}:
        raise ValueError("rows came in another order the second time: write them to a table before they are encoded")
    sizes = [_unpack(x) for x in ids.column("sizes").to_pylist()]
    kinds = [np.repeat(np.arange(3, dtype=np.int8), (a, b, len(s) - a - b)) for a, b, s in zip(
        ids.column("n0").to_pylist(), ids.column("n1").to_pylist(), sizes, strict=True)]
    size = np.concatenate([np.empty(0, np.int64), *sizes])
    by_number = np.argsort(np.concatenate([np.empty(0, np.int8), *kinds]), kind="stable")
    width = "<u2" if 2 in ids.column("width").to_pylist() else "<i4"
    pool = np.frombuffer(b"".join(ids.column("ids").to_pylist()), width)
    starts = (np.cumsum(size) - size)[by_number]
    size = size[by_number]
    codes, bounds = _unpacked(texts.column("codes").combine_chunks())
    flat = _gather(pool, starts[codes], size[codes]).astype("<i4")
    cut = 4 * np.concatenate(([0], np.cumsum(size[codes])))[bounds]
    free_unused()
    return pa.table({"doc_id": texts.column("doc_id"), "text_hash": texts.column("text_hash"), "ids": _binary(flat.tobytes(), cut)})


def checked(encoded: DataFrame, path: str) -> DataFrame:
    """``ids`` beside the digests of what ``encode`` returned; fails where the ids do not decode to the text that was encoded."""
    row = F.struct("doc_id", "text_hash", "ids").alias("row")
    back = _with_bytes(encoded.select(row, "ids"), path, "row", "ids", ("ids_sha256", "decoded_sha256", "data")).select(
        "doc_id.*", "n_tokens", "ids_sha256", "decoded_sha256", "data")
    wrong = F.concat(F.lit("ids do not decode to the text of document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    ids = F.when(F.xxhash64("data") == F.col("text_hash"), F.col("ids")).otherwise(F.raise_error(wrong))
    return back.select("doc_id", "n_tokens", ids.alias("ids"), "ids_sha256", "decoded_sha256")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``n_tokens`` and ``data``, the bytes that the ids stand for, per encoded document."""
    return _with_bytes(encoded, path, id_col, ids_col, ("data",))


def digests(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of encoded documents."""
    return _with_bytes(encoded, path, id_col, ids_col, ("ids_sha256", "decoded_sha256"))


def _with_bytes(encoded: DataFrame, path: str, id_col: str, ids_col: str, wanted: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        token_bytes = {i: b for b, i in ranks.items()}
        text = {i: str(i) for i in token_bytes}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, made = [], {c: [] for c in wanted}
                for raw in part.column(1).to_pylist():
                    ids = np.frombuffer(raw or b"", "<i4").tolist()
                    counts.append(len(ids))
                    plain = b"".join(map(token_bytes.__getitem__, ids))
                    if "ids_sha256" in made:
                        made["ids_sha256"].append(hashlib.sha256(" ".join(map(text.__getitem__, ids)).encode()).hexdigest())
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(plain).hexdigest())
                    if "data" in made:
                        made["data"].append(plain)
                columns = [pa.array(v, pa.binary() if c == "data" else pa.string()) for c, v in made.items()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), *columns], ["doc_id", "n_tokens", *made])

    id_type = encoded.schema[id_col].dataType.simpleString()
    kinds = ", ".join(f"{c} {'binary' if c == 'data' else 'string'}" for c in wanted)
    return encoded.select(F.col(id_col).alias("doc_id"), ids_col).mapInArrow(tidy(run), f"doc_id {id_type}, n_tokens long, {kinds}")
