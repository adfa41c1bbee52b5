"""The kNN join on clustered and on hot vectors against brute force, and what its bounds leave."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import vector_topk

SCHEMA = "vec_id long, embedding array<float>"


def clustered(rows: int, clusters: int, spread: float, seed: int = 7) -> list[tuple[int, list[float]]]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, 16))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return [(i, (centres[i % clusters] + rng.normal(0, spread, 16)).tolist()) for i in range(rows)]


def brute(rows, queries, k):
    ids = np.array([i for i, _ in rows])
    x = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64)
    want = set()
    for q in queries:
        score = x @ x[ids == q][0]
        order = [o for o in np.lexsort((ids, -score)) if ids[o] != q][:k]
        want |= {(q, rank, int(ids[o]), int(score[o])) for rank, o in enumerate(order, 1)}
    return want


@pytest.mark.parametrize(("clusters", "spread"), [(40, 0.01), (40, 0.3), (1, 0.001)])
def test_equals_brute_force(spark, clusters, spread, monkeypatch):
    monkeypatch.setattr(vector_topk, "BUNDLE_QUERIES", 7)  # several bundles, and parts where one group is hot
    monkeypatch.setattr(vector_topk, "CHUNK_ROWS", 900)
    rows = clustered(3000, clusters, spread)
    got = vector_topk.exact_topk(spark.createDataFrame(rows, SCHEMA).repartition(6), F.col("vec_id") % 100 == 0)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, range(0, 3000, 100), 10)


def test_bounds_drop_most_of_clustered_vectors(spark):
    df = spark.createDataFrame(clustered(20_000, 40, 0.01), SCHEMA)
    facts = vector_topk.sent_rows(df, F.col("vec_id") % 1000 == 0).collect()
    assert sum(r["rows_sent"] for r in facts) < 0.25 * facts[0]["all_rows"]
    scattered = vector_topk.sent_rows(spark.createDataFrame(clustered(4000, 4000, 0.0), SCHEMA), F.col("vec_id") % 100 == 0).collect()
    assert [r["rows_sent"] <= r["all_rows"] for r in scattered] == [True] * len(scattered)
    assert vector_topk.sent_rows(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_few_rows_ties_and_null_ids(spark):
    rows = [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [9.0, 9.0]), (8, [2.0])]
    got = vector_topk.exact_topk(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 5, k=10).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(8, 2 << 20), (3, 1 << 20), (3, 1 << 20)]
