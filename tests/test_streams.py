"""Streams over files that arrive one after another, late rows, restarts, and what is left of keyed state."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.buckets import BucketTable
from tidemark.streaming import jobs, keyed

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, kind string, value double"


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def arrive(spark, folder, parts, build, mode="append", handle=jobs.append):
    """Each part's rows are written, then the job runs until it has worked them off, from where it was."""
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        jobs.run(build(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")), handle, folder, mode)
    return spark.read.parquet(f"{folder}/out") if handle is jobs.append else None


def state(spark, folder, name):
    rows = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", name).load()
    return [r.asDict(True) for r in rows.collect()]


def mixed(rows, parts, seed):
    """``rows`` in parts by time, some of them a part later."""
    rng, size = random.Random(seed), -(-len(rows) // parts)
    out = [[] for _ in range(parts)]
    for k, r in enumerate(sorted(rows, key=lambda r: r[1])):
        out[min(parts - 1, k // size + (rng.random() < 0.2))].append(r)
    return out


def test_windows_count_late_rows(spark, tmp_path):
    """A late event counts within the watermark and is dropped beyond it."""
    parts = mixed([(k, at(k * 60), k % 2, "view", float(k)) for k in range(50)], 4, 1)
    build = lambda late: lambda s: jobs.request_windows(s, ["user_id"], "1 hour", 2, late)
    kept = arrive(spark, f"{tmp_path}/a", parts, build("2 days"), "update")
    assert kept.select("batch").distinct().count() >= 4 and jobs.last_update(kept, ["window_start", "user_id"]).count() == 50
    lost = arrive(spark, f"{tmp_path}/b", parts, build("1 minute"), "update")
    assert 40 <= jobs.last_update(lost, ["window_start", "user_id"]).count() < 50


def test_a_stream_goes_on_after_a_failure(spark, tmp_path):
    """What a job that failed in the middle has done is neither lost nor done again."""
    lost = []

    def handle(batch, number, folder):
        if number == 1 and not lost:
            lost.append(number)
            raise RuntimeError("lost")
        jobs.append(batch.select("event_id"), number, folder)

    parts = [[(10 * p + k, at(p * 60 + k), k % 2, "view", float(k)) for k in range(10)] for p in range(3)]
    with pytest.raises(Exception):
        arrive(spark, f"{tmp_path}/x", parts, lambda s: s, handle=handle)
    arrive(spark, f"{tmp_path}/x", parts[2:], lambda s: s, handle=handle)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/x/out").collect()) == list(range(30))


def test_changes_correct_what_late_rows_change(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, at(rng.randrange(3_000)), rng.randrange(6), "v", rng.choice([None, 0.0, 10.0, 10.5, 20.0, 30.0])) for k in range(300)]
    parts = mixed(rows, 4, 2) + [[(1_000, at(40_000), 99, "v", 1.0)]]
    out = arrive(spark, f"{tmp_path}/x", parts, lambda s: keyed.value_changes(s, ["user_id"], "value", 0.1, "2 days"))
    assert out.where("sign = -1").count() > 0
    want, last = set(), {}
    for i, _, user, _, value in sorted(rows, key=lambda r: (r[1], r[0])):
        before = last.get(user)
        if None not in (before, value) and before != 0 and abs(value - before) / abs(before) >= 0.1:
            want.add((user, i, before, value))
        last[user] = value
    assert {tuple(r) for r in keyed.settled(out).select("user_id", "event_id", "before", "after").collect()} == want
    assert len(state(spark, f"{tmp_path}/x", "rows")) == 7  # of each key the last row


def test_replays_and_their_state(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, at(rng.randrange(3_000)), rng.randrange(12), str(rng.randrange(25)), 0.0) for k in range(120)]
    build = lambda s: keyed.revoked_families(s.select(F.col("user_id").alias("family"), F.col("kind").cast("long").alias("token"), "ts", "event_id"), "600 minutes", "2 days")
    parts = mixed(rows, 4, 3)
    out = arrive(spark, f"{tmp_path}/x", parts, build)
    want, last = {}, {}
    for i, ts, family, token, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        before = last.get((family, token))
        if before is not None and ts - before <= timedelta(minutes=600):
            want.setdefault(family, (int(token), ts))
        last[family, token] = ts
    found = keyed.settled(out).select("family", "token", F.timestamp_micros("us").alias("ts"))
    assert {r["family"]: (r["token"], r["ts"]) for r in found.collect()} == want and 3 < len(want) < 12
    assert state(spark, f"{tmp_path}/x", "uses")
    arrive(spark, f"{tmp_path}/x", [[(1_000, at(90_000), 77, "1", 0.0)], [(1_001, at(90_001), 77, "2", 0.0)]], build)
    assert {r["key"]["family"] for r in state(spark, f"{tmp_path}/x", "uses")} == {77} and state(spark, f"{tmp_path}/x", "revoked") == []


def test_stuck_jobs_and_their_state(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, at(rng.randrange(4_000)), rng.randrange(15), rng.choice(["start", "start", "finish"]), 0.0) for k in range(260)]
    build = lambda s: keyed.stuck_jobs(s.select(F.col("user_id").alias("job_id"), "ts", "event_id", "kind"), 60, 3, "1 day", "2 days")
    parts = mixed(rows, 4, 4) + [[(1_000, at(90_000), 77, "start", 0.0)], [(1_001, at(90_010), 77, "finish", 0.0)]]
    out = arrive(spark, f"{tmp_path}/x", parts, build)
    want = set()
    for job in range(15):
        mine, tries, before = sorted(r for r in rows if r[2] == job), 0, None
        mine.sort(key=lambda r: (r[1], r[0]))
        for r, following in zip(mine, [*mine[1:], None]):
            if before is not None and r[1] - before > timedelta(days=1):
                tries = 0
            tries, before = (tries + 1, r[1]) if r[3] == "start" else (0, None)
            if r[3] == "start" and (following is None or following[1] > r[1] + timedelta(minutes=60)):
                want.add((job, r[1], tries, "fail" if tries >= 3 else "requeue"))
    found = {(r["job_id"], r["ts"], r["attempts"], r["action"]) for r in out.withColumn("ts", F.timestamp_micros("us")).collect()}
    assert found == want and any(x[3] == "fail" for x in want)
    assert {r["key"]["job_id"] for r in state(spark, f"{tmp_path}/x", "rows")} == {77}
    assert state(spark, f"{tmp_path}/x", "count") == []


def bucket_table(spark, path):
    return BucketTable(spark, path, ["k"], "k long, v string", 8)


def put(old, batch):
    new = batch.select("k", F.col("v").alias("w"))
    return old.join(new, "k", "full_outer").select("k", F.coalesce("w", "v").alias("v")).where("v <> 'gone'")


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    table = bucket_table(spark, f"file://{tmp_path}/t")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    assert table.rows().count() == 0 and table.version() is None
    table.merge(frame([(k, "a") for k in range(100)]), put, 0)
    before = table.manifest()
    touched = table.merge(frame([(3, "b"), (200, "c")]), put, 1)
    after = table.manifest()
    assert len(before) == 8 and len(touched) <= 2 and {b for b in after if after[b] != before[b]} == touched
    assert {r["k"]: r["v"] for r in table.rows().collect()} == {k: "a" for k in range(100)} | {3: "b", 200: "c"}
    table.merge(frame([(k, "gone") for k in [*range(100), 200]]), put, 2)
    assert table.rows().count() == 0 and table.version() == 2
    table.merge(frame([]), put, 3)
    assert table.version() == 3


def test_a_lost_version_leaves_the_state(spark, tmp_path, monkeypatch):
    """Work that ends between the data and the manifest changes nothing, and the batch can run again, also twice."""
    table = bucket_table(spark, f"file://{tmp_path}/t")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    table.merge(frame([(1, "a"), (2, "a")]), put, 0)
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_has", lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.merge(frame([(1, "b")]), put, 1)
    assert {r["k"]: r["v"] for r in table.rows().collect()} == {1: "a", 2: "a"}
    for _ in range(2):
        table.merge(frame([(1, "b")]), put, 1)
        assert {r["k"]: r["v"] for r in table.rows().collect()} == {1: "b", 2: "a"}


def test_catalogue(spark, tmp_path):
    table = BucketTable(spark, f"file://{tmp_path}/t", ["user_id"], "user_id long, value double, first_seen timestamp, last_seen timestamp, seen_in int", 4)
    parts = [[(1, at(0), 1, "v", 1.0), (2, at(5), 2, "v", 2.0)], [(3, at(9), 1, "v", 5.0)], [(4, at(3), 1, "v", 4.0)]]
    arrive(spark, f"{tmp_path}/x", parts, lambda s: s, handle=jobs.catalogue(table, ["user_id"], ["value"]))
    found = {r["user_id"]: (r["value"], r["first_seen"], r["last_seen"], r["is_current"]) for r in jobs.current(table).collect()}
    assert found == {1: (5.0, at(0), at(9), True), 2: (2.0, at(5), at(5), False)}
