"""The operators of this folder as registered queries over whole tables, with DuckDB twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import (
    byte_bpe,
    chat_format,
    fill_middle,
    hard_negatives,
    language_id,
    mixing,
    near_dedup,
    quality_rules,
    secret_scan,
    token_counts,
    toxicity,
    vector_topk,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_windows")


def secret_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.render(F.col("base")), 256).alias("base_sha256"), secret_scan.render(F.col("spans")).alias("spans"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc.doc_id", "doc.source", "copy_no", "n_copies", "shuffle_key", "doc.text")


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, letter_runs=True)
    return byte_bpe.digests(encoded, path)


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(_table(spark, sf_dir, "documents"))


def dedup_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.exact_topk(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.apply_policy(quality_rules.rule_ledger(_table(spark, sf_dir, "documents")), "v1")
    return ledger.withColumn("base_failed", quality_rules.rejected("base")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_mask", "n_lines")


def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def chat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat_format.read_back(chat_format.format_conversations(said.unionByName(marks)))


def middle_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = fill_middle.fill_in_middle(fill_middle.store_frames(_table(spark, sf_dir, "documents")))
    return fill_middle.digests(outputs).drop("n_frames")


QUERIES = {
    "op1_toxicity": toxicity_query,
    "op2_secret_scan": secret_query,
    "op3_mix_sources": mixing_query,
    "op4_byte_bpe": bpe_query,
    "op5_language_id": language_query,
    "op6_near_dedup": dedup_query,
    "op7_token_counts": count_query,
    "op8_warc": warc_query,
    "op9_exact_topk": topk_query,
    "op10_quality_rules": quality_query,
    "op11_hard_negatives": negatives_query,
    "op12_chat_format": chat_query,
    "op13_fill_middle": middle_query,
}

_SPACE = r"[\x20\x09-\x0D]+"
_TRIMMED = r"regexp_replace(regexp_replace({0}, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"

ORACLES = {
    "op3_mix_sources": """
WITH rates AS (
  SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate
  FROM (SELECT coalesce(source, '') AS source, CAST(count(*) AS DOUBLE) AS n, sqrt(CAST(count(*) AS DOUBLE)) AS w FROM documents GROUP BY 1)),
draws AS (
  SELECT doc_id, d.source, text, rate,
    CAST(CAST('0x' || substr(md5('0:count:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN rates r ON r.source = coalesce(d.source, '')),
terms AS (
  SELECT source, k, exp(-rate + k * ln(rate) - lgamma(CAST(k + 1 AS DOUBLE))) AS p
  FROM rates, LATERAL (SELECT unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
counts AS (
  SELECT d.doc_id, d.source, d.text, (SELECT count(*) FROM cdf WHERE cdf.source = coalesce(d.source, '') AND u >= c) AS n FROM draws d)
SELECT doc_id, source, CAST(copy_no AS INTEGER) AS copy_no, CAST(n AS INTEGER) AS n_copies,
  CAST(CAST('0x' || substr(md5('0:order:' || doc_id || ':' || copy_no), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS shuffle_key, text
FROM (SELECT *, unnest(range(1, n + 1)) AS copy_no FROM counts)""",
    "op9_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id))
WHERE rank <= 10""",
    "op10_quality_rules": rf"""
WITH tokens AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM tokens)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS k FROM repeated) GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM tokens),
measured AS (
  SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM tokens t JOIN lines USING (doc_id) LEFT JOIN covered c ON c.doc_id = t.doc_id),
ruled AS (
  SELECT *, CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 5 * n_symbols > word_chars THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 16 ELSE 0 END AS m FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, m & 3 <> 0 AS base_failed, m = 0 AS kept,
  CAST(m AS BIGINT) AS fail_mask, n_lines FROM ruled""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN CAST(last AS BIGINT) END AS refers_to FROM m""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id AS id, a.label = d.label AS same,
    CAST(list_sum(list_transform(list_zip(a.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v d ON a.vec_id % 50 = 0 AND d.vec_id <> a.vec_id),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3""",
    "op12_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before,
    regexp_replace(regexp_replace(role || chr(10) || text, '<(\\*/?s>)', '<\\\1', 'g'), '\[(\\*/?(?:INST|SYS|ROLE)\])', '[\\\1', 'g') AS escaped
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT *, length(escaped) - 1 + CASE role WHEN 'system' THEN 8 WHEN 'user' THEN 12 WHEN 'assistant' THEN 1 ELSE 22 END AS size,
    NOT coalesce(before IS NULL AND role IN ('system', 'user') OR before IN ('system', 'assistant') AND role = 'user'
      OR before = 'user' AND role = 'assistant', FALSE) AS bad FROM e),
g AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS learnt, CAST(sum(size) AS BIGINT) AS formatted_chars,
    min(i) FILTER (bad) AS fault, max_by(role, i) AS last FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars,
  fault IS NULL AND last = 'assistant' AS valid,
  CAST(CASE WHEN fault IS NOT NULL THEN fault WHEN last <> 'assistant' THEN n_turns END AS BIGINT) AS fault_turn FROM g""",
    "op13_fill_middle": """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || doc_id) AS h FROM documents),
d AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
