"""Usage, quotas, schedules and request hygiene over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import MONITOR_HOURS, PLAN_LIMITS
from tidemark.sources.tables import shared_folder


def monthly(events: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Sums per key and month."""
    return events.groupBy(key, F.date_format("ts", "yyyy-MM").alias("period")).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def quota_status(usage: DataFrame) -> DataFrame:
    """``usage(organization_id, plan, competitors, analyses, pages)`` with limits and what is exhausted."""
    limits = F.create_map(*[x for plan, v in PLAN_LIMITS.items() for x in (F.lit(plan), F.array(*map(F.lit, v)))])
    rows = usage.withColumn("l", F.try_element_at(limits, F.col("plan")))
    names = ("competitors", "analyses", "pages")
    return rows.select("organization_id", "plan", *names, *[F.col("l")[k].alias(f"{n}_limit") for k, n in enumerate(names)], *[(F.col(n) >= F.col("l")[k]).alias(f"{n}_exhausted") for k, n in enumerate(names)])


def next_check(now: Column, importance: Column, enabled: Column) -> Column:
    hours = F.create_map(*[F.lit(x) for pair in MONITOR_HOURS.items() for x in pair])
    return F.when(enabled, now + F.make_interval(hours=F.try_element_at(hours, importance)))


def due(competitors: DataFrame, jobs: DataFrame, now: Column, most: int = 50, stagger: int = 20) -> DataFrame:
    """Competitors to refresh now, oldest first, without those with a job under way, each ``stagger`` seconds after the last."""
    rows = competitors.where((F.col("status") == "active") & F.col("enabled") & (F.col("next_check") <= now))
    rows = rows.join(jobs.where(F.col("status").isin("pending", "running")).select("competitor_id").distinct(), "competitor_id", "left_anti")
    first = rows.orderBy("next_check", "competitor_id").limit(most)
    order = Window.orderBy("next_check", "competitor_id")  # over at most ``most`` rows
    return first.withColumn("delay", (F.row_number().over(order) - 1) * stagger)


def stuck(jobs: DataFrame, now: Column, minutes: int = 45, attempts: int = 3) -> DataFrame:
    """Running jobs started over ``minutes`` ago, to be failed or queued again."""
    rows = jobs.where((F.col("status") == "running") & (F.col("started_at") < now - F.make_interval(mins=F.lit(minutes))))
    return rows.withColumn("action", F.when(F.col("attempts") >= attempts, "fail").otherwise("requeue"))


def short_gaps(requests: DataFrame, key: str, seconds: float) -> DataFrame:
    """Requests that follow their key's last one within ``seconds``."""
    before = F.lag("ts").over(Window.partitionBy(key).orderBy("ts", "event_id"))
    seconds_of = lambda c: c.cast("timestamp").cast("double")
    gap = seconds_of(F.col("ts")) - seconds_of(before)
    return requests.withColumn("gap", gap).where(F.col("gap") < seconds)


def start_times(requests: DataFrame, key: str, seconds: float) -> DataFrame:
    """``requests(key, ts, event_id, ...)`` with ``start``: the earliest time that keeps starts of one key ``seconds`` apart, in order of ts and event_id.

    A start is the later of the request's time and the start before it plus the gap.  So with a request's number i among its
    key's, ``start - i * gap`` is the greatest ``ts - i * gap`` so far: a prefix maximum.  Requests are dealt in ranges of key
    and time, each range numbers and scans its own, and what the ranges of a key before it add is taken from one row per key
    and range; so a key's queue of any length is several tasks' work.  Requests without a key or time have no start.
    """
    spark = requests.sparkSession
    folder, gap = shared_folder(spark, "queues"), F.lit(round(seconds * 1_000_000)).cast("long")
    due = requests.where(F.col(key).isNotNull() & F.col("ts").isNotNull()).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    dealt = due.repartitionByRange(key, "_us", "event_id").withColumn("_range", F.spark_partition_id())
    dealt.write.parquet(f"{folder}/dealt")
    rows = spark.read.schema(dealt.schema).parquet(f"{folder}/dealt")
    own = Window.partitionBy("_range", key).orderBy("_us", "event_id")
    rows = rows.withColumn("_i", F.row_number().over(own))
    rows = rows.withColumn("_m", F.max(F.col("_us") - F.col("_i") * gap).over(own))
    ranges = rows.groupBy(key, "_range").agg(F.count("*").alias("_n"), F.max("_m").alias("_top"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    ranges = ranges.withColumn("_past", F.max(F.col("_top") - F.col("_off") * gap).over(before)).select(key, "_range", "_off", "_past")
    start = F.greatest("_past", F.col("_m") - F.col("_off") * gap) + (F.col("_off") + F.col("_i")) * gap
    return rows.join(ranges, [key, "_range"]).withColumn("start", F.timestamp_micros(start)).drop("_us", "_range", "_i", "_m", "_off", "_past")


def rate_limit(requests: DataFrame, keys: list[str], window: str, limit: int) -> DataFrame:
    """Requests per key and fixed window, and whether they are over the limit."""
    rows = requests.groupBy(F.window("ts", window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("window_start"), *keys, "n", (F.col("n") > limit).alias("limited"))


def replayed_families(uses: DataFrame) -> DataFrame:
    """Families of ``uses(family, token, ts, event_id)`` in which a token is used again, with the first time."""
    again = F.row_number().over(Window.partitionBy("family", "token").orderBy("ts", "event_id")) > 1
    return uses.withColumn("again", again).where("again").groupBy("family").agg(F.min("ts").alias("revoked_at"), F.count("*").alias("replays"))
