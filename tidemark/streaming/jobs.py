"""Streaming jobs: each turns a stream into a stream, or handles micro-batches with a state table.

Every micro-batch is written under its own number and overwritten if it runs again, so a restarted query repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import alerts
from tidemark.operators.buckets import BucketTable
from tidemark.streaming.keyed import ROCKSDB


def events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The event files as a stream, a few files in each micro-batch."""
    path = f"{folder}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path + "*").withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, handle: Callable[[DataFrame, int, str], None], folder: str, mode: str = "append") -> None:
    """Work off what is there, a micro-batch at a time, with ``handle(batch, number, folder)``.

    The checkpoint is in ``folder``: a call with the same one goes on where the last one ended or failed.  Keyed state is in
    RocksDB.
    """
    conf, (name, provider) = stream.sparkSession.conf, ROCKSDB
    before = conf.get(name, None)
    conf.set(name, provider)
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
            .foreachBatch(lambda batch, number: handle(batch, number, folder)).start()
        )
        query.awaitTermination()
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def append(batch: DataFrame, number: int, folder: str) -> None:
    batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")


def last_update(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of an update stream's output, each key's row from the last micro-batch that has one."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("batch").desc()))
    return rows.withColumn("_n", best).where("_n = 1").drop("_n", "batch")


def request_windows(stream: DataFrame, keys: list[str], width: str, limit: int, late: str = "1 hour") -> DataFrame:
    """Requests per key and fixed window, and whether they are over the limit."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "n", (F.col("n") > limit).alias("limited"))


def sliding_counts(stream: DataFrame, key: str, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), key, "n")


def deliver_once(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first delivery of each key within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def monthly_usage(stream: DataFrame, key: str, value: str) -> DataFrame:
    rows = stream.groupBy(key, F.date_format("ts", "yyyy-MM").alias("period"))
    return rows.agg(F.count("*").alias("n"), F.bround(F.sum(value), 2).alias("total"))


def alert_matches(stream: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes ``stream(change_id, organization_id, competitor_id, change_type, severity)`` with each rule that asks for them; see :mod:`tidemark.operators.alerts`."""
    return alerts.match(stream, rules)


def catalogue(table: BucketTable, keys: list[str], values: list[str]) -> Callable[[DataFrame, int, str], None]:
    """A micro-batch handler that keeps each key's values in ``table`` with when it was seen first and last, and in which batch.

    Only the buckets of the batch's keys are rewritten, under the batch's number.  A late row does not replace newer values.
    """

    def combine(old: DataFrame, batch: DataFrame) -> DataFrame:
        best = F.max_by(F.struct(*values), F.struct("ts", "event_id")).alias("n")
        new = batch.groupBy(*keys).agg(best, F.min("ts").alias("first"), F.max("ts").alias("last"), F.first("number").alias("in_batch"))
        both = old.join(new, keys, "full_outer")
        newer = F.col("n").isNotNull() & (F.col("last_seen").isNull() | (F.col("last") >= F.col("last_seen")))
        return both.select(
            *keys, *[F.when(newer, F.col(f"n.{v}")).otherwise(F.col(v)).alias(v) for v in values],
            F.least("first_seen", "first").alias("first_seen"), F.greatest("last_seen", "last").alias("last_seen"), F.coalesce("in_batch", "seen_in").alias("seen_in"),
        )

    def handle(batch: DataFrame, number: int, folder: str) -> None:
        table.merge(batch.withColumn("number", F.lit(number)), combine, number)

    return handle


def current(table: BucketTable) -> DataFrame:
    """A catalogue's rows, with ``is_current`` for the keys of its last batch."""
    return table.rows().withColumn("is_current", F.col("seen_in") == F.lit(table.version())).drop("seen_in")
