"""What a Python worker holds at once does not grow with the rows of a task."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import extract, search, vector_index

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def large_batches(spark):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, "10000")
    yield
    spark.conf.set(ROWS, before)


@pytest.mark.parametrize("job", [search.chunks, search.lexical_weights, lambda df: extract.observations(df.selectExpr("doc_id page_id", "text html"), ["links"])])
def test_batches_of_texts_are_small(spark, large_batches, job):
    n = job(spark.range(600).selectExpr("id doc_id", "concat('<a href=/x>word ', id, '</a>') text")).select(job(spark.createDataFrame([(1, "w")], "doc_id long, text string")).columns[0]).distinct().count()
    assert n == 600 and int(spark.conf.get(ROWS)) <= 256


def test_lists_of_many_vectors_take_little_memory():
    rng = np.random.default_rng(1)
    centroids = vector_index.unit_rows(rng.normal(size=(2_000, 8)).tolist(), 8)
    vectors = pd.Series([*rng.normal(size=(4_000, 8)).tolist(), None, [0.0] * 8, [1.0]])
    tracemalloc.start()
    one, three = (vector_index._nearest_lists(centroids, n).func(vectors) for n in (1, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000 and [len(x) for x in three[:4_000]] == [3] * 4_000
    near = vector_index.unit_rows(vectors[:4_000].tolist(), 8) @ centroids.T
    assert [x[0] for x in one[:4_000]] == near.argmax(axis=1).tolist() == [x[0] for x in three[:4_000]]
    assert [list(x) for x in one[4_000:]] == [[-1]] * 3
