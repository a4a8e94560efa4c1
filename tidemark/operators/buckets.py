"""State tables in buckets: a batch rewrites the buckets that it touches and no others.

Keys are hashed into a fixed number of buckets.  A version's data are the buckets that its batch touched; its manifest, one
small file, names the folder that each bucket is in now.  A version counts only when its manifest is there, so work that
stops before that leaves the state as it was, and a batch that runs again under its number writes the same version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BucketTable:
    """A table of ``schema`` at ``path`` whose rows are in the bucket of their ``keys``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets

    def _manifests(self) -> DataFrame:
        empty = self.spark.createDataFrame([], "bucket int, folder string, version int")
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return empty
        return self.spark.read.schema("bucket int, folder string, version int").parquet(f"{self.path}/manifest").unionByName(empty)

    def manifest(self, before: int | None = None) -> dict[int, str]:
        """The folder of each bucket that has one, in the newest version (of those under ``before``)."""
        rows = self._manifests() if before is None else self._manifests().where(F.col("version") < before)
        newest = rows.agg(F.max("version")).first()[0]
        return {} if newest is None else {r["bucket"]: r["folder"] for r in rows.where((F.col("version") == newest) & (F.col("bucket") >= 0)).collect()}  # a row per bucket

    def version(self) -> int | None:
        return self._manifests().agg(F.max("version")).first()[0]

    def bucket_of(self, *keys: str) -> F.Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _read(self, folders: dict[int, str], buckets: set[int]) -> DataFrame:
        paths = [f"{self.path}/data/{folders[b]}/bucket={b}" for b in sorted(buckets & folders.keys())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The current state."""
        folders = self.manifest()
        return self._read(folders, set(folders))

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> set[int]:
        """Write ``version``: ``combine(old, batch)`` of the buckets that ``batch`` has keys of; returns these.

        ``old`` has all rows of these buckets and ``batch`` is as given; ``combine`` returns ``schema``'s columns and no key
        of another bucket.
        """
        folders, bucket = self.manifest(version), self.bucket_of(*self.keys)
        touched = {r[0] for r in batch.select(bucket).distinct().collect()}  # at most as many as there are buckets
        if touched:
            columns = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
            done = combine(self._read(folders, touched), batch).select(*columns, bucket.alias("bucket"))
            # A large bucket is several tasks' files.
            dealt = done.repartition(F.col("bucket"), F.pmod(F.xxhash64(*columns), F.lit(4)))
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={version}")
        written = {b for b in touched if self._has(version, b)}
        now = {b: f for b, f in folders.items() if b not in touched} | {b: f"version={version}" for b in written}
        rows = self.spark.createDataFrame([(-1, ""), *sorted(now.items())], "bucket int, folder string")  # the first row: a version may be empty
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")
        return touched

    def _has(self, version: int, bucket: int) -> bool:
        """Whether the version has rows of a bucket (all of them may have gone)."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/version={version}/bucket={bucket}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
