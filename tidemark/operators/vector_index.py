"""Nearest vectors by cosine: exactly against all rows, or through an index of lists around centroids.

The centroids are fitted on a bounded sample; every row is assigned to its nearest centroid and stored in that list.  A
search sends each query to its nearest lists only, by a shuffle; a list is compared in blocks, so neither a large list nor a
popular one is one task's work, and no query vector passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import small_batches

#: Stored rows and queries that a task compares at once.
BLOCK_ROWS, BLOCK_QUERIES = 8_192, 1_024
#: Of these, vectors that are compared with all stored rows or centroids in one matrix.
MATRIX_ROWS = 64
#: Rows that the centroids are fitted on, and centroids, at most.
SAMPLE_ROWS, MOST_LISTS = 20_000, 4_096
#: Queries that the number of lists to probe is measured with, at most.
SAMPLE_QUERIES = 256


def unit_rows(vectors: list, size: int) -> np.ndarray:
    """Vectors at unit length, a row each; those without a length or with another size are not-a-number."""
    out = np.full((len(vectors), size), np.nan)
    for i, v in enumerate(vectors):
        if v is not None and len(v) == size:
            out[i] = [np.nan if x is None else x for x in v]
    with np.errstate(invalid="ignore", divide="ignore"):
        return out / np.where((norm := np.linalg.norm(out, axis=1, keepdims=True)) == 0, np.nan, norm)


def _blocked(rows: DataFrame, sizes: DataFrame, own: str, own_id: str, other: str) -> DataFrame:
    """``rows(list, ...)`` dealt over their list's ``own`` blocks, once for each of its ``other`` blocks."""
    block = F.pmod(F.xxhash64(own_id), F.col(own)).alias(f"{own}_at")
    rows = rows.join(sizes, "list").select(*[F.col(c).alias(c) for c in rows.columns], block, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(f"{other}_at"))
    return rows.groupBy("list", "rows_at", "queries_at")


def nearest(stored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, similarity, position``: the best ``k`` rows of ``stored(list, vec_id, vec)`` for ``queries(list, query_id, vec)`` of the same list.

    Similarities are rounded to four digits; equal ones go by vec_id, and where a vector has no length or another number of
    components they are null and come last.  Each pair of blocks keeps its best ``k`` per query, which are then merged.
    """
    small_batches(stored.sparkSession, 1_024)
    count = lambda df, c, n: df.groupBy("list").agg(F.ceil(F.count("*") / n).alias(c))
    sizes = count(stored, "rows", BLOCK_ROWS).join(count(queries, "queries", BLOCK_QUERIES), "list")
    of = {name: df.schema[name].dataType.simpleString() for df, name in ((queries, "query_id"), (stored, "vec_id"))}

    def work(s: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        lengths = q["vec"].map(lambda v: -1 if v is None else len(v)).to_numpy()
        of_size = {size: unit_rows(s["vec"].tolist(), size).T for size in set(lengths.tolist()) - {-1} if len(s)}
        ids, best, sims = s["vec_id"].to_numpy(), [], []
        for first in range(0, len(q), MATRIX_ROWS):
            part = q["vec"].iloc[first : first + MATRIX_ROWS]
            near = np.full((len(part), len(s)), np.nan)
            for size, columns in of_size.items():
                at = np.flatnonzero(lengths[first : first + MATRIX_ROWS] == size)
                near[at] = np.round(unit_rows(part.iloc[at].tolist(), size) @ columns, 4)
            order = np.lexsort((np.broadcast_to(ids, near.shape), np.where(np.isnan(near), np.inf, -near)), axis=1)[:, :k]
            best.append(ids[order])
            sims.append(np.take_along_axis(near, order, axis=1))
        best, found = (np.concatenate(x) if x else np.empty((0, 0)) for x in (best, sims))
        found = found.ravel()
        return pd.DataFrame({"query_id": q["query_id"].repeat(best.shape[1]).to_numpy(), "vec_id": best.ravel(), "similarity": pd.Series(found, dtype="Float64").mask(np.isnan(found))})

    rows = _blocked(stored.select("list", "vec_id", "vec"), sizes, "rows", "vec_id", "queries")
    asked = _blocked(queries.select("list", "query_id", "vec"), sizes, "queries", "query_id", "rows")
    best = rows.cogroup(asked).applyInPandas(work, f"query_id {of['query_id']}, vec_id {of['vec_id']}, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc_nulls_last(), "vec_id")
    return best.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def vector_topk(stored: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """:func:`nearest` over all rows of ``stored(vec_id, vec)`` for each row of ``queries(query_id, vec)``, exactly."""
    everywhere = F.lit(0).alias("list")
    return nearest(stored.select(everywhere, "vec_id", "vec"), queries.select(everywhere, "query_id", "vec"), k)


@dataclass
class VectorIndex:
    """Rows ``list, vec_id, vec`` stored by list, and the lists' centroids (unit rows); list -1 has the vectors without length."""

    rows: DataFrame
    centroids: np.ndarray

    def lists_of(self, vec: Column, probes: int) -> Column:
        """The ``probes`` lists nearest to a vector, nearest first."""
        return _nearest_lists(self.centroids, probes)(vec)

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """:func:`nearest` of each row of ``queries(query_id, vec)`` within its ``probes`` nearest lists; without a number in all, exactly.

        Rows without a length are found by the exact search only, where fewer than ``k`` others are.
        """
        if probes is None:
            return vector_topk(self.rows, queries, k)
        asked = queries.select("query_id", "vec", F.explode(self.lists_of(F.col("vec"), probes)).alias("list"))
        return nearest(self.rows, asked, k)

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95) -> int:
        """The fewest lists to probe so that this share of the exact ``k`` nearest rows is found.

        Measured on the ``SAMPLE_QUERIES`` first queries by the hash of their id, against all rows: each exact neighbour
        counts at the rank that its list has for the query.
        """
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE_QUERIES)
        ranked = some.select("query_id", F.posexplode(self.lists_of(F.col("vec"), len(self.centroids))).alias("rank", "list"))
        exact = vector_topk(self.rows, some, k).where("similarity is not null").join(self.rows.select("vec_id", "list"), "vec_id")
        ranks = exact.join(ranked, ["query_id", "list"]).groupBy("rank").count().orderBy("rank").collect()  # a row per list at most
        total, so_far = sum(r["count"] for r in ranks), 0
        for r in ranks:
            so_far += r["count"]
            if so_far >= recall * total:
                return r["rank"] + 1
        return 1


def _nearest_lists(centroids: np.ndarray, probes: int):
    @F.pandas_udf("array<int>")
    def lists(vectors: pd.Series) -> pd.Series:
        out: list = []
        for at in range(0, len(vectors), MATRIX_ROWS):
            near = unit_rows(vectors.iloc[at : at + MATRIX_ROWS].tolist(), centroids.shape[1]) @ centroids.T
            order = near.argmax(axis=1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]
            out += [[-1] if np.isnan(n[0]) else o for n, o in zip(near, order.astype(np.int32))]
        return pd.Series(out, dtype=object)

    return lists


def _has_length(vec: Column) -> Column:
    return vec.isNotNull() & F.exists(vec, lambda x: x != 0) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x))


def build(stored: DataFrame, path: str, lists: int | None = None, seed: int = 1) -> VectorIndex:
    """Index all rows of ``stored(vec_id, vec)`` at ``path``, a Parquet folder with one partition per list.

    There are about as many lists as the root of the number of rows (``MOST_LISTS`` at most).  Centroids are fitted by
    k-means on cosine over the ``SAMPLE_ROWS`` first rows by the hash of their id that have a length; every row is then
    assigned and written.  Rows go to tasks in ranges of list and hash, so a large list is several tasks' files.
    """
    spark = stored.sparkSession
    small_batches(spark, 1_024)
    some = stored.where(_has_length(F.col("vec"))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select(array_to_vector("vec").alias("features")).persist()
    taken = some.count()
    count = max(1, min(lists or round(stored.count() ** 0.5), MOST_LISTS, taken))
    if taken > 1:
        centres = KMeans(k=count, distanceMeasure="cosine", initMode="random", maxIter=8, seed=seed).fit(some).clusterCenters() if count > 1 else [some.first()[0].toArray()]
    else:
        centres = [r[0].toArray() for r in some.collect()] or [np.ones(1)]
    some.unpersist()
    centroids = unit_rows([list(c) for c in centres], len(centres[0]))
    rows = stored.select("vec_id", "vec", _nearest_lists(centroids, 1)(F.col("vec"))[0].alias("list"))
    rows.repartitionByRange("list", F.xxhash64("vec_id")).sortWithinPartitions("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    kinds = f"vec_id {stored.schema['vec_id'].dataType.simpleString()}, vec {stored.schema['vec'].dataType.simpleString()}, list int"
    spark.createDataFrame([(i, c.tolist(), kinds) for i, c in enumerate(centroids)], "list int, centroid array<double>, kinds string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """The index at ``path``; its centroids, a bounded number, are read."""
    centres = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
    return VectorIndex(spark.read.schema(centres[0]["kinds"]).parquet(f"{path}/rows"), np.array([r["centroid"] for r in centres]))
