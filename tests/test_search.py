from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import search, vector_index


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 5)


def frame(spark, rows, name="vec_id"):
    return spark.createDataFrame(rows, f"{name} long, vec array<double>").repartition(3)


def brute(v, asked, k):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit[asked] @ unit.T).round(4)
    return {(q, int(i), p + 1) for n, q in zip(near, asked) for p, i in enumerate(np.lexsort((np.arange(len(v)), -n))[:k])}


def triples(df):
    return {(r["query_id"], r["vec_id"], r["position"]) for r in df.collect()}


def test_topk_of_more_queries_than_a_block(spark, small_blocks):
    v = np.random.default_rng(2).normal(size=(20, 4)).round(2)
    stored = frame(spark, [(k, x.tolist()) for k, x in enumerate(v)])
    found = search.vector_topk(stored, stored.where("vec_id < 8").withColumnRenamed("vec_id", "query_id"), 2)
    assert triples(found) == brute(v, range(8), 2) and found.count() == 16


def test_topk_of_odd_vectors(spark, small_blocks):
    """Vectors without a length, with nulls or of another size have no similarity and come last; equal ones go by id."""
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0]), (5, [2.0, 0.0]), (6, [None, 1.0]), (7, [0.0, 3.0])]
    stored = frame(spark, rows)
    found = search.vector_topk(stored, frame(spark, [(10, [1.0, 0.0]), (11, [0.0, 0.0]), (12, None), (13, [5.0])], "query_id"), 4).collect()
    got = {q: [(r["vec_id"], r["similarity"]) for r in sorted(found, key=lambda r: r["position"]) if r["query_id"] == q] for q in (10, 11, 12, 13)}
    assert got[10] == [(1, 1.0), (5, 1.0), (7, 0.0), (2, None)]
    assert got[11] == got[12] == [(1, None), (2, None), (3, None), (4, None)]
    assert got[13] == [(4, 1.0), (1, None), (2, None), (3, None)]
    assert search.vector_topk(stored.limit(0), frame(spark, [(1, [1.0])], "query_id"), 2).count() == 0
    assert search.vector_topk(stored, frame(spark, [], "query_id"), 2).count() == 0


def clustered(n, centres=30, size=16):
    rng = np.random.default_rng(4)
    return (rng.normal(size=(centres, size))[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, size))).round(3)


def test_index_holds_every_row_and_finds_most(spark, tmp_path):
    """All lists give the exact result; the measured number of lists finds at least nine tenths of it and reads fewer rows."""
    v = clustered(3_000)
    stored = frame(spark, [(k, x.tolist()) for k, x in enumerate(v)] + [(9_001, None), (9_002, [0.0] * 16)])
    index = vector_index.build(stored, f"file://{tmp_path}/index")
    assert index.rows.count() == 3_002 and index.rows.where("list = -1").count() == 2
    asked = list(range(0, 3_000, 50))
    queries = stored.where("vec_id % 50 = 0 and vec_id < 9000").withColumnRenamed("vec_id", "query_id")
    exact = brute(v, asked, 10)
    assert triples(index.search(queries, 10)) == exact
    probes = index.probes_for(queries, 10)
    assert 1 <= probes < len(index.centroids) / 3
    again = vector_index.load(spark, f"file://{tmp_path}/index")
    found = triples(again.search(queries, 10, probes))
    assert len({x[:2] for x in found} & {x[:2] for x in exact}) >= 0.9 * len(exact)


def test_recall_on_the_given_vectors(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    index = vector_index.build(e, f"file://{tmp_path}/index")
    queries = e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {x[:2] for x in triples(index.search(queries, 10))}
    found = {x[:2] for x in triples(index.search(queries, 10, index.probes_for(queries, 10)))}
    assert len(found & exact) >= 0.9 * len(exact)


def test_a_hot_list_is_cut(spark, small_blocks, tmp_path):
    """Equal vectors fill one list, whose rows and queries go to several tasks."""
    v = np.array([[1.0, 2.0]] * 40 + [[0.0, 1.0], [1.0, 0.0], [-1.0, 0.5]])
    stored = frame(spark, [(k, x.tolist()) for k, x in enumerate(v)])
    index = vector_index.build(stored, f"file://{tmp_path}/index", lists=3)
    queries = stored.where("vec_id < 10").withColumnRenamed("vec_id", "query_id")
    assert triples(index.search(queries, 3, 1)) == brute(v, range(10), 3)
    empty = vector_index.build(stored.limit(0), f"file://{tmp_path}/none")
    assert empty.search(queries, 3, 1).count() == empty.search(queries, 3).count() == 0 and empty.probes_for(queries, 3) == 1
