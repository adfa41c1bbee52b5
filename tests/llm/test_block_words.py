from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from pulsegrid.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = {1: "the cat sat on the mat", 2: "x" * 5000 + " the cat", 3: "", 4: "ก" * 100 + " the", 5: " ".join(f"w{i}" for i in range(40_000))}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").repartition(3, "doc_id")


@pytest.mark.parametrize("known_bytes", [1, 1 << 25])
def test_ids_do_not_depend_on_blocks_buckets_or_memory(spark, docs, monkeypatch, known_bytes):
    monkeypatch.setattr(byte_bpe, "KNOWN_BYTES", known_bytes)
    encoding = byte_bpe.make_encoding(RANKS, public_tokenizers.PATTERN)
    want = {i: encoding.encode_ordinary(t) for i, t in TEXTS.items()}
    for buckets, block_bytes in ((1, 10), (3, 1 << 22)):
        monkeypatch.setattr(byte_bpe, "BUCKETS", buckets)
        rows = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_bytes=block_bytes).collect()
        assert {r["doc_id"]: np.frombuffer(r["ids"], "<i4").tolist() for r in rows} == want


def test_a_block_numbers_frequent_words_first():
    find = regex.compile(public_tokenizers.PATTERN).findall
    block = byte_bpe.Block(pa.array([TEXTS[5], "w7 " * 9, " w7"]), public_tokenizers.PATTERN, True, 4)
    sent = block.bucket_rows(9)
    words = set(find(TEXTS[5]) + find("w7 " * 9) + find(" w7"))
    assert sum(len(byte_bpe._unpack(x)) for x in sent.column("sizes").to_pylist()) == len(words)
    assert sum(map(len, sent.column("words").to_pylist())) == sum(map(len, words))
    every, bounds = block.codes()
    codes = [every[a:b] for a, b in zip(bounds, bounds[1:])]
    assert [len(codes[list(block.order).index(i)]) for i in range(3)] == [len(find(t)) for t in (TEXTS[5], "w7 " * 9, " w7")]
    assert max(codes[list(block.order).index(2)]) < 128


def test_rows_in_another_order_are_an_error(spark, docs):
    """The second reading of a frame that deals rows anew each time differs from the first."""
    def shuffled(batches):
        for pdf in batches:
            yield pdf.iloc[np.random.default_rng().permutation(len(pdf))]

    many = spark.range(0, 500, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), F.col("id")).alias("text"))
    loose = many.mapInPandas(shuffled, "doc_id long, text string")
    with pytest.raises(Exception, match="another order"):
        byte_bpe.encode(loose, RANKS, public_tokenizers.PATTERN).collect()


def test_pieces_are_split_as_the_pattern_does():
    strings = [" word", "word", " word.", "Straße!", " naïve?", "it's", " it's", "a1", " 42", "", " ", "  x", "ﬁn", "ǅ,", "日本", "x..", ".", " ×", "ɏ;", "ɐ;"]
    find = regex.compile(public_tokenizers.PATTERN).findall
    for letter_runs in (False, True):
        words, flat, sizes = byte_bpe.split_pieces(pa.array(strings), public_tokenizers.PATTERN, letter_runs)
        told, ends = words.to_pylist(), np.cumsum(sizes)
        assert [[told[k] for k in flat[e - n:e]] for e, n in zip(ends, sizes)] == [find(x) for x in strings]
