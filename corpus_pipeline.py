"""A document corpus from raw rows to token ids, in stages that are each stored before the next one reads them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.functions.scratch import scratch_root
from pulsegrid.llm import byte_bpe, mixing, near_dedup, quality_rules, secret_scan


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality policy."""
    return quality_rules.filter_documents(docs, "v1")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; ``n_chars`` follows the text."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources follow the square root of their sizes, in random order."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian 32-bit numbers); a document whose ids do not decode to its text is an error."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.checked(byte_bpe.encode(docs, path, public_tokenizers.PATTERN, letter_runs=True), path)


STAGES = [
    ("quality_rules", drop_poor),
    ("near_dedup", drop_copies),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix),
    ("byte_bpe", encode),
]

#: Trained models and similarity search over hashes have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage is stored in the shared folder and read again."""
    folder = f"{scratch_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
