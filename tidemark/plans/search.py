"""Vector search, lexical vectors, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import search, vector_index
from tidemark.sources import tables as t


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest stored vectors of every vector whose id is divisible by 50."""
    e = t.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return search.vector_topk(e, e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10)


def _index(spark: SparkSession, d: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    """An index of all embeddings, and every vector whose id is divisible by 50 as queries."""
    e = t.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return vector_index.build(e, f"{t.shared_folder(spark, 'vector_index')}"), e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


def vector_index_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors of each query over all lists of an index, which holds every row."""
    index, queries = _index(spark, d)
    return index.search(queries, 10)


def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest vectors in the lists that find 0.95 of the neighbours in a measured sample, with the position that each has exactly."""
    index, queries = _index(spark, d)
    found = index.search(queries, 10, index.probes_for(queries, 10))
    exact = index.search(queries, 10).select("query_id", "vec_id", F.col("position").alias("exact_position"))
    return found.join(exact, ["query_id", "vec_id"], "left")


def lexical_weights(spark: SparkSession, d: str) -> DataFrame:
    return search.lexical_weights(t.table(spark, d, "documents"))


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    """The five documents nearest to every benchmark item whose id is divisible by 50."""
    return search.lexical_search(t.table(spark, d, "documents"), t.table(spark, d, "benchmark").where("item_id % 50 = 0"), 5)


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = search.chunks(t.table(spark, d, "documents"))
    return rows.select("doc_id", "seq", F.length("chunk").alias("n_chars"), "content_hash")


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Signed feature-hashed vectors of all documents, as their first component's size and length."""
    t.small_batches(spark)
    v = t.table(spark, d, "documents").select("doc_id", search.hashed_vector(256)(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("dimensions"), F.size(F.filter("v", lambda x: x != 0)).alias("used"))


def embedding_build(spark: SparkSession, d: str) -> DataFrame:
    """New chunks of each source with their vectors, where every third document's chunks are stored already."""
    docs = t.table(spark, d, "documents").select(F.col("source").alias("competitor_id"), "doc_id", "text")
    stored = search.chunks(docs.where("doc_id % 3 = 0")).join(docs.select("doc_id", "competitor_id"), "doc_id").select("competitor_id", "content_hash")
    rows = search.embed_new(docs, stored)
    return rows.select("competitor_id", "doc_id", "seq", "content_hash", F.size("vector").alias("dimensions"))


def chunk_search(spark: SparkSession, d: str) -> DataFrame:
    """The three chunks nearest to every benchmark item whose id is divisible by 50, over all documents' chunks."""
    docs = t.table(spark, d, "documents").select(F.col("source").alias("competitor_id"), "doc_id", "text")
    rows = search.chunks(docs).join(docs.select("doc_id", "competitor_id"), "doc_id").select("competitor_id", (F.col("doc_id") * 100_000 + F.col("seq")).alias("vec_id"), "chunk", search.hashed_vector(256)(F.col("chunk")).alias("vector"))
    names = docs.select("competitor_id", F.upper("competitor_id").alias("name")).distinct()
    asked = t.table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    return search.chunk_search(rows, names, asked, 3).select("query_id", "position", "vec_id", "similarity", "name", "is_lexical", F.length("content").alias("n_chars"))


_STOP = "['" + "','".join(sorted(search.STOPWORDS)) + "']"
_LEX = """{name} AS (SELECT {id} AS id, token, 1 + ln(count(*)) AS w FROM (SELECT {id}, unnest(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 2 AND NOT list_contains({stop}, x))) AS token FROM {table}) GROUP BY ALL),
{name}n AS (SELECT id, token, round_even(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM {name})"""

QUERIES = {f.__name__: f for f in (vector_topk, vector_index_exact, vector_index_topk, lexical_weights, lexical_search, chunk_documents, hashed_vectors, embedding_build, chunk_search)}
_TOPK = "SELECT query_id, vec_id, similarity, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS position FROM (SELECT q.vec_id AS query_id, e.vec_id, round_even(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 4) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE position <= 10"
ORACLE_SQL = {
    "vector_topk": _TOPK,
    "vector_index_exact": _TOPK,
    "lexical_weights": f"WITH {_LEX.format(name='d', id='doc_id', table='documents', stop=_STOP)} SELECT id AS doc_id, token, weight FROM dn",
    "lexical_search": f"""WITH {_LEX.format(name='d', id='doc_id', table='documents', stop=_STOP)}, {_LEX.format(name='b', id='item_id', table='benchmark', stop=_STOP)},
s AS (SELECT bn.id AS item_id, dn.id AS doc_id, round_even(sum(dn.weight * bn.weight), 4) AS score FROM dn JOIN bn USING (token) WHERE bn.id % 50 = 0 GROUP BY ALL)
SELECT item_id, doc_id, score, position FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS position FROM s) WHERE position <= 5""",
}
