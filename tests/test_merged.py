"""Merged micro-batches: late rows, corrections, and what is kept."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.plans import streams
from tidemark.streaming import jobs, keyed, merged

START = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, kind string, value double"


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def arrive(spark, folder, parts, handle, build=lambda s: s, again=None):
    """Each part's rows are written, then the job works them off; ``again`` is a batch that is handled twice."""
    for rows in parts:
        spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        twice = lambda b, n, f: [handle(b, n, f) for _ in range(2 if n == again else 1)]
        jobs.run(build(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")), twice, folder)
    kept = spark.read.parquet(f"{folder}/merged/batch={len(parts) - 1}").where("_kept")
    return spark.read.parquet(f"{folder}/out"), kept


def mixed(rows, parts, seed):
    rng, size = random.Random(seed), -(-len(rows) // parts)
    out = [[] for _ in range(parts)]
    for k, r in enumerate(sorted(rows, key=lambda r: r[1])):
        out[min(parts - 1, k // size + (rng.random() < 0.2))].append(r)
    return out


def test_queries_call_no_python_per_key(spark, small, monkeypatch):
    """One call per key took 110 s over 100,000 events."""
    monkeypatch.setattr("pyspark.sql.GroupedData.transformWithStateInPandas", None)
    assert streams.stream_changes(spark, small).count() and streams.stream_replays(spark, small).count() and streams.stream_stuck_jobs(spark, small).count()


def test_changes(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, at(rng.randrange(3_000)), rng.randrange(6), "v", rng.choice([None, float("nan"), 0.0, 10.0, 10.5, 20.0, 30.0])) for k in range(300)]
    parts = mixed(rows, 4, 2) + [[(1_000, at(40_000), 99, "v", 1.0), (1_002, None, 99, "v", 9.0)], [(1_001, at(100), 3, "v", 77.0)]]  # the last is too late
    out, kept = arrive(spark, f"{tmp_path}/x", parts, merged.value_changes(["user_id"], "value", 0.1, "2 days"), again=2)
    assert out.where("sign = -1").count() > 0
    want, last = set(), {}
    for i, _, user, _, value in sorted(rows, key=lambda r: (r[1], r[0])):
        value, before = None if value is None or value != value else value, last.get(user)
        if None not in (before, value) and before != 0 and abs(value - before) / abs(before) >= 0.1:
            want.add((user, i, before, value))
        last[user] = value
    assert {tuple(r) for r in keyed.settled(out).select("user_id", "event_id", "before", "after").collect()} == want
    assert kept.count() == 7  # of each key the last row


def test_replays(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, at(rng.randrange(3_000)), rng.randrange(12), str(rng.randrange(25)), 0.0) for k in range(120)]
    build = lambda s: s.select(F.col("user_id").alias("family"), F.col("kind").cast("long").alias("token"), "ts", "event_id")
    parts = mixed(rows, 4, 3) + [[(1_000, at(90_000), 77, "1", 0.0)], [(1_001, at(90_001), 77, "2", 0.0)]]
    out, kept = arrive(spark, f"{tmp_path}/x", parts, merged.revoked_families("600 minutes", "2 days"), build, again=1)
    want, last = {}, {}
    for i, ts, family, token, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        before = last.get((family, token))
        if before is not None and ts - before <= timedelta(minutes=600):
            want.setdefault(family, (int(token), ts))
        last[family, token] = ts
    found = keyed.settled(out).select("family", "token", F.timestamp_micros("us").alias("ts"))
    assert {r["family"]: (r["token"], r["ts"]) for r in found.collect()} == want and 3 < len(want) < 12
    assert {r["family"] for r in kept.collect()} == {77} and kept.where("_mark").count() == 0


def test_a_family_starts_anew_after_its_revocation(spark, tmp_path):
    use = lambda i, minutes: (i, at(minutes), 5, "1", 0.0)
    build = lambda s: s.select(F.col("user_id").alias("family"), F.lit(1).cast("long").alias("token"), "ts", "event_id")
    parts = [[use(1, 0), use(2, 10)], [use(3, 50)], [(9, at(900), 6, "1", 0.0)], [use(4, 1_000)], [use(5, 1_030)]]
    out, _ = arrive(spark, f"{tmp_path}/x", parts, merged.revoked_families("60 minutes", "5 minutes"), build)
    assert sorted(r["us"] for r in keyed.settled(out).withColumn("us", (F.timestamp_micros("us").cast("long") - F.lit(START).cast("long")) / 60).collect()) == [10, 1_030]


def test_a_late_use_moves_the_revocation(spark, tmp_path):
    use = lambda i, minutes: (i, at(minutes), 5, "1", 0.0)
    build = lambda s: s.select(F.col("user_id").alias("family"), F.lit(1).cast("long").alias("token"), "ts", "event_id")
    out, kept = arrive(spark, f"{tmp_path}/x", [[use(1, 0), use(2, 30)], [use(3, 10), use(4, 40)]], merged.revoked_families("60 minutes", "1 hour"), build)
    assert sorted((r["sign"], r["us"] // 60_000_000 % 60) for r in out.collect()) == [(-1, 30), (1, 10), (1, 30)]
    assert {(r["event_id"], r["_mark"]) for r in kept.collect()} == {(1, False), (3, True)}


def test_stuck_jobs(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, at(rng.randrange(4_000)), rng.randrange(15), rng.choice(["start", "start", "finish"]), 0.0) for k in range(260)]
    build = lambda s: s.select(F.col("user_id").alias("job_id"), "ts", "event_id", "kind")
    parts = mixed(rows, 4, 4) + [[(1_000, at(90_000), 77, "start", 0.0)], [(1_001, at(90_010), 77, "finish", 0.0)]]
    out, kept = arrive(spark, f"{tmp_path}/x", parts, merged.stuck_jobs(60, 3, "1 day", "2 days"), build, again=3)
    want = set()
    for job in range(15):
        tries, before = 0, None
        mine = sorted((r for r in rows if r[2] == job), key=lambda r: (r[1], r[0]))
        for r, following in zip(mine, [*mine[1:], None]):
            if before is not None and r[1] - before > timedelta(days=1):
                tries = 0
            tries, before = (tries + 1, r[1]) if r[3] == "start" else (0, None)
            if r[3] == "start" and (following is None or following[1] > r[1] + timedelta(minutes=60)):
                want.add((job, r[1], tries, "fail" if tries >= 3 else "requeue"))
    assert {(r["job_id"], r["ts"], r["attempts"], r["action"]) for r in out.withColumn("ts", F.timestamp_micros("us")).collect()} == want and any(x[3] == "fail" for x in want)
    assert {r["job_id"] for r in kept.collect()} == {77}
