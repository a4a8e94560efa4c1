"""Shared folders, written tables and connected components."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a session in one process takes a temporary folder and keeps it; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.shared.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.shared.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/tidemark/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later reads neither recompute it nor depend on one executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1_024) -> None:
    """Rows per Arrow batch from now on: some texts are very long, and a task holds a few copies of its batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def kept_by_worker(name: str, make: Callable[[], Any]) -> Any:
    """``make()``'s object, one per Python worker process, which Spark uses for task after task."""
    store = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


class Recent(dict):
    """Remembers what ``make`` gave for a key: at least its last ``size`` new keys and, after ``turn``, at most twice as many."""

    def __init__(self, size: int, make: Callable[[Any], Any] | None = None):
        super().__init__()
        self.size, self.make, self.old = size, make, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        """To be called between batches: forget what has not been asked for since the call before the last."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()

    def missing(self, keys: set) -> list:
        """Those of ``keys`` that the caller has to put in."""
        new = keys - self.keys()
        again = new & self.old.keys()
        self.update((k, self.old[k]) for k in again)
        return list(new - again)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)`` for every node of the undirected ``edges(a, b)`` (longs), root its component's smallest node.

    Alternating large-star and small-star steps: each is one aggregation (combined before the shuffle) and one
    join on the node, so a hub's edges can be split over tasks.  Every round is written to the shared folder.
    Self loops and repeated edges are harmless; no edges give no rows.
    """
    shared_root(edges.sparkSession)
    cur = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(cur)
    for _ in range(rounds):
        both = cur.union(cur.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        moved = large.join(low, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        cur = written(small.distinct(), "edges")
        now = _state(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
