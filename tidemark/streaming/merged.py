"""Jobs that merge each micro-batch with what earlier ones left open, for all keys at once by window functions.

A step takes the rows that are kept and the new ones, and says of each row what it tells and whether it is kept: late rows
take their place, what they change is corrected by rows with ``sign`` -1 and +1 (:func:`tidemark.streaming.keyed.settled`
adds them up), and what no row can change any more is dropped.  They say what the jobs of :mod:`tidemark.streaming.keyed`
say; those answer key by key, these are for many keys in large micro-batches.

The watermark is the newest event time less the lateness: rows before that of the last micro-batch are dropped, and a
micro-batch's own rows move it on before anything is settled.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Handler = Callable[[DataFrame, int, str], None]
#: Of a kept or new row: ``_old`` tells which; of a step's result: ``_kept``, and ``_said``, rows of what it tells.
_OLD, _KEPT, _SAID = "_old", "_kept", "_said"


def _micros(interval: str) -> int:
    return pd.Timedelta(interval).value // 1_000


def _delete(spark: SparkSession, path: str) -> None:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


def merging(columns: list[str], late: str, step: Callable[[DataFrame, Column], DataFrame]) -> Handler:
    """A micro-batch handler: ``step(rows, passed)`` over the kept rows and the batch's, its output under ``out``.

    ``columns`` are taken from the stream, next to ``us`` made of its ``ts``; rows without a time are dropped.  ``passed`` is the
    watermark in microseconds.  A batch that runs again starts from the same kept rows and overwrites what it wrote.
    """

    def handle(batch: DataFrame, number: int, folder: str) -> None:
        spark = batch.sparkSession
        rows = batch.where("ts is not null").select(*columns, F.unix_micros("ts").alias("us"))
        before = spark.read.schema("newest long").parquet(f"{folder}/newest/batch={number - 1}").first()[0] if number else None
        newest = max((x for x in (before, rows.agg(F.max("us")).first()[0]) if x is not None), default=None)
        spark.range(1).select(F.lit(newest).cast("long").alias("newest")).write.mode("overwrite").parquet(f"{folder}/newest/batch={number}")
        if before is not None:
            rows = rows.where(F.col("us") >= before - _micros(late))
        rows = rows.withColumn(_OLD, F.lit(False))
        if number:
            last = spark.read.parquet(f"{folder}/merged/batch={number - 1}")
            kept = last.where(_KEPT).drop(_KEPT, _SAID).withColumn(_OLD, F.lit(True))
            rows = kept.unionByName(rows, allowMissingColumns=True)
        done = step(rows, F.lit(None if newest is None else newest - _micros(late)).cast("long")).drop(_OLD)
        done.write.mode("overwrite").parquet(f"{folder}/merged/batch={number}")
        done = spark.read.schema(done.schema).parquet(f"{folder}/merged/batch={number}")
        done.where(F.size(_SAID) > 0).select(F.inline(_SAID)).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        _delete(spark, f"{folder}/merged/batch={number - 2}")
        _delete(spark, f"{folder}/newest/batch={number - 2}")

    return handle


def _signed(was: Column, now: Column) -> Column:
    """What is no longer so with ``sign`` -1 and what is so now with +1; ``was`` and ``now`` are functions of a sign, or null."""
    return F.array_compact(F.array(was, now))


def value_changes(keys: list[str], value: str, noise: float, late: str) -> Handler:
    """``keys, event_id, before, after, sign``: rows of ``keys, ts, event_id, value`` that differ from the one before in time by the share ``noise``.

    Values that are null or follow a null or zero are no change.  Of each key the rows from the last one before the
    watermark on are kept.
    """
    by = Window.partitionBy(*keys).orderBy("us", "event_id")
    v = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))

    def step(rows: DataFrame, passed: Column) -> DataFrame:
        # Before an old row: the row before it now, and the last old one.  In structs, since values may be null.
        held = F.when(F.col(_OLD), F.struct(v.alias("v")))
        rows = rows.withColumns({
            "_b": F.lag(v).over(by), "_h": F.last(held, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))["v"], "_next": F.lead("us").over(by),
        })
        found = lambda b: F.coalesce((b != 0) & (F.abs(v - b) / F.abs(b) >= noise), F.lit(False))
        same = F.col(_OLD) & F.col("_h").eqNullSafe(F.col("_b"))
        told = lambda b, sign: F.when(found(b) & ~same, F.struct(*keys, "event_id", b.alias("before"), v.alias("after"), F.lit(sign).alias("sign")))
        said = _signed(F.when(F.col(_OLD), told(F.col("_h"), -1)), told(F.col("_b"), 1))
        kept = passed.isNull() | (F.col("us") >= passed) | F.col("_next").isNull() | (F.col("_next") >= passed)
        return rows.select(*keys, "event_id", value, "us", _OLD, kept.alias(_KEPT), said.alias(_SAID))

    return merging([*keys, "event_id", value], late, step)


def revoked_families(life: str, late: str) -> Handler:
    """``family, token, us, sign``: the first use of any of a family's tokens within ``life`` of that token's last use, from rows ``family, token, ts, event_id``.

    A late use can only move it to an earlier time; what comes after it changes nothing.  A token's uses are kept until
    ``life`` after its last, those of a family until the watermark has passed its revocation, which is kept ``life`` longer.
    """
    span = _micros(life)
    family = Window.partitionBy("family")

    def step(rows: DataFrame, passed: Column) -> DataFrame:
        mark = F.coalesce(F.col("_mark"), F.lit(False)) if "_mark" in rows.columns else F.lit(False)
        rows = rows.select("family", "token", "event_id", "us", _OLD, mark.alias("_mark")).repartition("family")
        place = lambda c: F.struct("us", "event_id", "token") if c is None else F.when(c, F.struct("us", "event_id", "token"))
        rows = rows.withColumn("_was", F.min(place(F.col("_mark"))).over(family))
        rows = rows.where("_mark or _old or _was is null or struct(us, event_id) < struct(_was.us, _was.event_id)")
        use = Window.partitionBy("family", "token", "_mark").orderBy("us", "event_id")
        rows = rows.withColumns({"_gap": F.col("us") - F.lag("us").over(use), "_next": F.lead("us").over(use)})
        rows = rows.withColumn("_last", F.max("us").over(Window.partitionBy("family", "token", "_mark")))
        rows = rows.withColumn("_now", F.min(place(F.col("_mark") | (F.col("_gap") <= span))).over(family))
        # One row of the family speaks for it: the mark that was, or the use that is its revocation now.
        is_now = ~F.col("_mark") & F.col("_now").eqNullSafe(place(None)) & ~F.col("_now").eqNullSafe(F.col("_was"))
        gone = F.col("_mark") & ~F.col("_now").eqNullSafe(F.col("_was"))
        told = lambda c, sign: F.when(c, F.struct("family", "token", "us", F.lit(sign).alias("sign")))
        said = _signed(told(gone, -1), told(is_now, 1))
        over = F.coalesce(F.col("_now.us") < passed, F.lit(False))
        open_ = F.col("_now").isNull() | (F.struct("us", "event_id") < F.struct("_now.us", "_now.event_id"))
        recent = passed.isNull() | ((F.col("_last") + span >= passed) & (F.coalesce(F.col("us") >= passed, F.lit(True)) | F.col("_next").isNull() | (F.col("_next") >= passed)))
        use_kept = ~F.col("_mark") & ~over & open_ & recent
        mark_kept = F.coalesce(F.col("us") + span >= passed, F.lit(True))
        # The use that is the revocation becomes the mark; a mark that still holds stays.
        marks = F.array(F.struct(use_kept.alias("kept"), F.lit(False).alias("mark"), said.alias("said")))
        marks = F.when(is_now, F.array(F.struct(mark_kept.alias("kept"), F.lit(True).alias("mark"), said.alias("said")))).otherwise(
            F.when(F.col("_mark"), F.array(F.struct((~gone & mark_kept).alias("kept"), F.lit(True).alias("mark"), said.alias("said")))).otherwise(marks)
        )
        return rows.select("family", "token", "event_id", "us", _OLD, F.inline(marks)).toDF("family", "token", "event_id", "us", _OLD, _KEPT, "_mark", _SAID)

    return merging(["family", "token", "event_id"], late, step)


def stuck_jobs(minutes: int = 45, attempts: int = 3, silence: str = "7 days", late: str = "1 minute") -> Handler:
    """``job_id, us, attempts, action``: starts of rows ``job_id, ts, event_id, kind`` that nothing of the job follows within ``minutes``.

    ``kind`` is ``start`` or ``finish``, ``us`` the start's event time in microseconds.  The job is to be queued again, or failed
    after ``attempts`` starts since it finished last or was silent for ``silence``.  Said when the watermark has passed; of
    settled rows a job's last start is kept with its number, until the job finishes or is silent.
    """
    patience, quiet = minutes * 60_000_000, _micros(silence)
    by = Window.partitionBy("job_id").orderBy("us", "event_id")

    def step(rows: DataFrame, passed: Column) -> DataFrame:
        held = F.col("_held") if "_held" in rows.columns else F.lit(None).cast("long")
        start, settled = F.col("kind") == "start", F.coalesce(F.col("us") + patience < passed, F.lit(False))
        rows = rows.withColumn("_held", held)  # of a row that is settled since earlier: how many starts it was
        on = F.coalesce(F.lag(start).over(by) & (F.col("us") - F.lag("us").over(by) <= quiet), F.lit(False))
        rows = rows.withColumns({"_next": F.lead("us").over(by), "_run": F.sum((~on).cast("int")).over(by)})
        n = F.sum(F.coalesce("_held", start.cast("long"))).over(Window.partitionBy("job_id", "_run").orderBy("us", "event_id"))
        rows = rows.withColumn("_n", n)
        due = settled & F.col("_held").isNull() & start & (F.col("_next").isNull() | (F.col("_next") > F.col("us") + patience))
        told = F.struct("job_id", "us", F.col("_n").cast("int").alias("attempts"), F.when(F.col("_n") >= attempts, "fail").otherwise("requeue").alias("action"))
        said = F.array_compact(F.array(F.when(due, told)))
        last = settled & start & (F.coalesce(F.col("us") + quiet >= passed, F.lit(True))) & F.coalesce(F.col("_next") + patience >= passed, F.lit(True))
        return rows.select("job_id", "event_id", "kind", "us", _OLD, F.when(settled, F.col("_n")).alias("_held"), (~settled | last).alias(_KEPT), said.alias(_SAID))

    return merging(["job_id", "event_id", "kind"], late, step)
