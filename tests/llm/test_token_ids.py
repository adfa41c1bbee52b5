from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = {1: "the cat sat on the mat", 2: "x" * 5000 + " the cat", 3: "", 4: "\u0e01" * 100 + " the"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")


def test_stage_returns_ids_and_fails_on_a_difference(spark, docs):
    rows = corpus_pipeline.encode(spark, docs, "").collect()
    encoding = byte_bpe.make_encoding(RANKS, public_tokenizers.PATTERN)
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<i4").tolist() for r in rows} == {
        i: encoding.encode_ordinary(t) for i, t in TEXTS.items()}
    assert {r["doc_id"]: (r["ids_sha256"], r["decoded_sha256"]) for r in rows} == {
        i: tuple(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, encoding.encode_ordinary(t))), t)) for i, t in TEXTS.items()}
    wrong = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).withColumn("text_hash", F.col("text_hash") + 1)
    with pytest.raises(Exception, match="do not decode"):
        byte_bpe.checked(wrong, RANKS).collect()
