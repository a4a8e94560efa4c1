"""Retention by day, and start times under a gap."""

from __future__ import annotations

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import usage
from tidemark.sources import daily, tables

SCHEMA = "id long, fetched timestamp, text string, digest string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def day_of(path):
    return path.split("fetched_date=")[1].split("/")[0]


def test_only_expired_days_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/shots"
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=7 * k), f"text {k}", f"d{k}") for k in range(40)] + [(99, None, "no time", "d")]
    tables.append_by_date(spark.createDataFrame(rows[:20] + rows[40:], SCHEMA), f"file://{path}", "fetched")
    tables.append_by_date(spark.createDataFrame(rows[20:40], SCHEMA), f"file://{path}", "fetched")
    before = files(path)
    args = (spark, f"file://{path}", SCHEMA, "fetched", "text", date(2024, 1, 9))
    assert daily.clear_texts(*args, 0) == [] and daily.clear_texts(*args, 30) == []
    assert daily.clear_texts(*args, 5) == [date(2024, 1, d) for d in (1, 2, 3)]
    after = files(path)
    kept = {f for f in before if day_of(f) not in ("2024-01-01", "2024-01-02", "2024-01-03")}
    assert kept == {f for f in before if after.get(f) == before[f]} and len(kept) > 5
    got = {r["id"]: (r["text"], r["digest"]) for r in spark.read.parquet(f"file://{path}").collect()}
    assert got == {i: ("" if ts and ts < datetime(2024, 1, 4) else text, d) for i, ts, text, d in rows}
    assert daily.clear_texts(*args, 5) == [] and files(path) == after
    assert daily.clear_texts(*args, 3, since=date(2024, 1, 5)) == [date(2024, 1, 5)]
    assert daily.drop_days(spark, f"file://{path}", "fetched", date(2024, 1, 9), 6) == [date(2024, 1, 1), date(2024, 1, 2)]
    assert {r["id"] for r in spark.read.parquet(f"file://{path}").collect()} == {i for i, ts, *_ in rows if ts is None or ts >= datetime(2024, 1, 3)}
    assert daily.days(spark, f"file://{tmp_path}/none", "fetched") == []


@pytest.mark.parametrize("split", [True, False])
def test_start_times(spark, split):
    """Against a loop; with a hot key cut into ranges, equal times and rows without key or time."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", not split)
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 1, 1, 2, 3, None]), datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(4_000))) for k in range(300)]
    rows += [(1_000 + k, 7, datetime(2024, 1, 1)) for k in range(50)] + [(2_000, 1, None)]
    out = usage.start_times(spark.createDataFrame(rows, "event_id long, host long, ts timestamp").repartition(5), "host", 20.0)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, last = {}, {}
    for i, host, ts in sorted((r for r in rows if None not in r), key=lambda r: (r[2], r[0])):
        last[host] = want[i] = max(ts, last[host] + timedelta(seconds=20)) if host in last else ts
    assert set(out.columns) == {"host", "event_id", "ts", "start"}
    assert {r["event_id"]: r["start"] for r in out.select("event_id", F.col("start")).collect()} == want
