"""Delivery of notifications from a stream, with what happened known after any stop.

A micro-batch's rows are in the outbox, a folder of their own, before anything is sent.  Rows are sent in small groups: a
group's claim is written first, then its rows are sent, then its results are written.  Work that starts again takes the
results that are there; a claim without results means that its rows may have been sent, so they are not sent again but
reported as ``uncertain``.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are claimed together.
GROUP = 100
_RESULTS = pa.schema([("notification_id", pa.string()), ("ok", pa.bool_())])


def _write(uri: str, rows: list[dict]) -> None:
    """A small file, whole or not at all."""
    fs, path = arrow_fs.FileSystem.from_uri(uri)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(f"{path}.part") as out:
        pq.write_table(pa.Table.from_pylist(rows, _RESULTS), out)
    fs.move(f"{path}.part", path)


def _read(uri: str) -> list[dict] | None:
    fs, path = arrow_fs.FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == arrow_fs.FileType.NotFound:
        return None
    with fs.open_input_file(path) as file:
        return pq.read_table(file).to_pylist()


def send_group(rows: list[dict], send: Callable[[dict], bool], folder: str) -> list[dict]:
    """``notification_id, ok`` of a group's rows; ok is null where a claim was left without results."""
    ids = [r["notification_id"] for r in rows]
    name = hashlib.sha256("\n".join(ids).encode()).hexdigest()
    known = _read(f"{folder}/done/{name}")
    if known is not None:
        return known
    if _read(f"{folder}/claims/{name}") is not None:
        return [{"notification_id": i, "ok": None} for i in ids]
    _write(f"{folder}/claims/{name}", [{"notification_id": i, "ok": None} for i in ids])
    done = []
    for row in rows:
        try:
            ok = bool(send(row))
        except Exception:  # a delivery that fails for whatever reason is tried again
            ok = False
        done.append({"notification_id": row["notification_id"], "ok": ok})
    _write(f"{folder}/done/{name}", done)
    return done


def outbox(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All rows that were handed over, each once."""
    return spark.read.schema(f"{schema}, batch int").parquet(f"{folder}/outbox").dropDuplicates(["notification_id"])


def results(spark: SparkSession, folder: str) -> DataFrame:
    """``notification_id, attempts, status``: sent, uncertain, or how often it failed."""
    rows = spark.read.schema("notification_id string, ok boolean, batch int").parquet(f"{folder}/results")
    return rows.groupBy("notification_id").agg(F.count("*").alias("attempts"), F.max("ok").alias("ok"), F.bool_or(F.col("ok").isNull()).alias("unknown"))


def statuses(spark: SparkSession, folder: str, schema: str, most: int = 3) -> DataFrame:
    """``notification_id, attempts, status`` of every row of the outbox: sent, uncertain, failed after ``most`` attempts, or pending."""
    rows = outbox(spark, folder, schema).select("notification_id").join(results(spark, folder), "notification_id", "left")
    n = F.coalesce("attempts", F.lit(0))
    status = F.when(F.col("ok"), "sent").when(F.col("unknown"), "uncertain").when(n >= most, "failed").otherwise("pending")
    return rows.select("notification_id", n.alias("attempts"), status.alias("status"))


def deliveries(send: Callable[[dict], bool], schema: str, most: int = 3, parts: int = 8) -> Callable[[DataFrame, int, str], None]:
    """A micro-batch handler that takes rows of ``schema`` (with ``notification_id string``) into the outbox and sends what is pending.

    Rows that failed before are tried again with each micro-batch, up to ``most`` times.  ``send`` runs in tasks, with each
    row as a dictionary.
    """
    columns = [x.strip().split()[0] for x in schema.split(",")]

    def handle(batch: DataFrame, number: int, folder: str) -> None:
        spark = batch.sparkSession
        batch.select(*columns).write.mode("overwrite").parquet(f"{folder}/outbox/batch={number}")
        left = outbox(spark, folder, schema).where(F.col("batch") <= number)
        if number:
            past = results(spark, folder).where(F.col("ok") | F.col("unknown") | (F.col("attempts") >= most)).select("notification_id")
            left = left.join(past, "notification_id", "left_anti")
        place = f"{folder}/groups/{number}"

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows = (r for b in batches for r in b.to_dict("records"))
            while group := list(islice(rows, GROUP)):
                yield pd.DataFrame(send_group(group, send, place), columns=["notification_id", "ok"]).astype({"ok": "boolean"})

        # Dealt and sorted by id, so that a repeated task has the same groups.
        dealt = left.select(*columns).repartition(parts, "notification_id").sortWithinPartitions("notification_id")
        dealt.mapInPandas(work, "notification_id string, ok boolean").write.mode("overwrite").parquet(f"{folder}/results/batch={number}")

    return handle
