"""Tables with a partition per day, kept short by whole days: only expired days are read and rewritten, or dropped.

The tables are those that :func:`tidemark.sources.tables.append_by_date` writes.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def days(spark: SparkSession, path: str, ts: str) -> list[date]:
    """The days that have a partition, from the folders' names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, prefix = root.getFileSystem(spark._jsc.hadoopConfiguration()), f"{ts}_date="
    names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(date.fromisoformat(n[len(prefix) :]) for n in names if n.startswith(prefix) and not n.endswith("__HIVE_DEFAULT_PARTITION__"))


def clear_texts(spark: SparkSession, path: str, schema: str, ts: str, text: str, as_of: date, keep_days: int, since: date | None = None) -> list[date]:
    """Empty ``text`` in the days that are more than ``keep_days`` before ``as_of`` (hashes and all else stay); returns the days rewritten.

    Days before ``since``, that of the last run, are known to be done and not looked at, nor is a day whose texts are empty
    rewritten.  ``keep_days`` of zero or less keeps all.  A day is replaced when its new files are complete.
    """
    if keep_days <= 0:
        return []
    end, day = as_of - timedelta(days=keep_days), f"{ts}_date"
    old = [d for d in days(spark, path, ts) if d < end and (since is None or d >= since)]
    if not old:
        return []
    rows = spark.read.schema(f"{schema}, {day} date").parquet(path).where(F.col(day).isin(old))
    todo = sorted(r[0] for r in rows.where(F.length(text) > 0).select(day).distinct().collect())  # as many as there are days
    if todo:
        done = rows.where(F.col(day).isin(todo)).withColumn(text, F.when(F.col(text).isNotNull(), ""))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    return todo


def drop_days(spark: SparkSession, path: str, ts: str, as_of: date, keep_days: int) -> list[date]:
    """Remove the days that are more than ``keep_days`` before ``as_of``, without reading them; returns them.

    Rows without a time are in no day and stay.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, end = root.getFileSystem(spark._jsc.hadoopConfiguration()), as_of - timedelta(days=keep_days)
    gone = [d for d in days(spark, path, ts) if d < end]
    for d in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, f"{ts}_date={d.isoformat()}"), True)
    return gone
