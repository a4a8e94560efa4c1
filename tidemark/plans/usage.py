"""Usage, quotas, schedules and request hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.constants import MONITOR_HOURS, PLAN_LIMITS
from tidemark.operators import usage
from tidemark.sources import tables as t


def usage_monthly(spark: SparkSession, d: str) -> DataFrame:
    sums = {"analyses": (F.col("event_type") == "click").cast("long"), "pages": (F.col("event_type") == "view").cast("long"), "errors": (F.col("event_type") == "error").cast("long")}
    return usage.monthly(t.table(spark, d, "events"), "user_id", sums)


def quota_status(spark: SparkSession, d: str) -> DataFrame:
    """Plan limits against orders as analyses and line items as pages, per customer."""
    # As decimals, whose sum does not depend on the order: one that ends in 500 is rounded to even.
    total = F.sum(F.col("o_totalprice").cast("decimal(24,6)"))
    per = t.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("analyses"), F.bround(total / 1000).cast("long").alias("pages"))
    plan = F.array(*map(F.lit, PLAN_LIMITS))[(F.col("c_custkey") % 4).cast("int")]
    rows = t.table(spark, d, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["analyses", "pages"])
    return usage.quota_status(rows.select(F.col("c_custkey").alias("organization_id"), plan.alias("plan"), (F.col("c_nationkey") % 12).alias("competitors"), "analyses", "pages"))


def due_refresh(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    importance = F.array(*map(F.lit, MONITOR_HOURS))[(k % 4).cast("int")]
    rows = t.table(spark, d, "supplier").select(k.alias("competitor_id"), F.when(k % 9 == 0, "archived").otherwise("active").alias("status"), (k % 7 != 0).alias("enabled"), usage.next_check(F.timestamp_seconds(1_705_600_000 + k * 977 % 200_000), importance, F.lit(True)).alias("next_check"))
    jobs = t.table(spark, d, "supplier").where("s_suppkey % 5 = 0").select(k.alias("competitor_id"), F.when(k % 2 == 0, "running").otherwise("done").alias("status"))
    return usage.due(rows, jobs, t.as_of("2024-01-22 00:00:00"), 30).select("competitor_id", "delay")


def stuck_jobs(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").alias("started_at"), (F.col("event_id") % 5).alias("attempts"))
    return usage.stuck(rows, t.as_of()).select("event_id", "attempts", "action")


def politeness_gaps(spark: SparkSession, d: str) -> DataFrame:
    return usage.short_gaps(t.table(spark, d, "events"), "user_id", 600.0).select("event_id", "user_id", F.bround("gap", 3).alias("gap"))


def rate_limit_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = usage.rate_limit(t.table(spark, d, "events"), ["user_id"], "6 hours", 2)
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def token_replay(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").select((F.col("user_id") % 40).alias("family"), F.concat_ws("-", (F.col("event_id") % 700).cast("string"), F.col("event_type")).alias("token"), "ts", "event_id")
    return usage.replayed_families(rows).withColumn("revoked_at", F.date_format("revoked_at", "yyyy-MM-dd HH:mm:ss"))


_LIMITS = lambda k: "CASE c_custkey % 4 " + " ".join(f"WHEN {i} THEN {v[k]}" for i, v in enumerate(PLAN_LIMITS.values())) + " END"
_HOURS = "(CASE s_suppkey % 4 " + " ".join(f"WHEN {i} THEN {h}" for i, h in enumerate(MONITOR_HOURS.values())) + " END)"
def fetch_start_times(spark: SparkSession, d: str) -> DataFrame:
    """When each event of a user may start, four hours apart."""
    rows = usage.start_times(t.table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", 14_400.0)
    return rows.select("event_id", "user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"))


QUERIES = {f.__name__: f for f in (usage_monthly, quota_status, due_refresh, stuck_jobs, politeness_gaps, fetch_start_times, rate_limit_windows, token_replay)}
ORACLE_SQL = {
    "usage_monthly": "SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) FILTER (event_type = 'click') AS analyses, count(*) FILTER (event_type = 'view') AS pages, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL",
    "quota_status": f"""WITH o AS (SELECT o_custkey, count(*) AS n, CAST(round_even(sum(o_totalprice) / 1000, 0) AS BIGINT) AS p FROM orders GROUP BY 1), u AS (SELECT c_custkey AS organization_id, (['free', 'starter', 'growth', 'enterprise'])[c_custkey % 4 + 1] AS plan, c_nationkey % 12 AS competitors, coalesce(n, 0) AS analyses, coalesce(p, 0) AS pages, {_LIMITS(0)} AS competitors_limit, {_LIMITS(1)} AS analyses_limit, {_LIMITS(2)} AS pages_limit FROM customer LEFT JOIN o ON c_custkey = o_custkey)
SELECT *, competitors >= competitors_limit AS competitors_exhausted, analyses >= analyses_limit AS analyses_exhausted, pages >= pages_limit AS pages_exhausted FROM u""",
    "due_refresh": f"""WITH c AS (SELECT s_suppkey, 1705600000 + s_suppkey * 977 % 200000 + {_HOURS} * 3600 AS due FROM supplier WHERE s_suppkey % 9 <> 0 AND s_suppkey % 7 <> 0 AND NOT (s_suppkey % 5 = 0 AND s_suppkey % 2 = 0))
SELECT s_suppkey AS competitor_id, (row_number() OVER (ORDER BY due, s_suppkey) - 1) * 20 AS delay FROM (SELECT * FROM c WHERE due <= 1705881600 ORDER BY due, s_suppkey LIMIT 30)""",
    "stuck_jobs": "SELECT event_id, event_id % 5 AS attempts, CASE WHEN event_id % 5 >= 3 THEN 'fail' ELSE 'requeue' END AS action FROM events WHERE event_type = 'click' AND ts < TIMESTAMP '2024-01-19 23:15:00'",
    "fetch_start_times": """WITH RECURSIVE q AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_id, user_id, i, ts AS start FROM q WHERE i = 1 UNION ALL SELECT q.event_id, q.user_id, q.i, greatest(q.ts, r.start + INTERVAL 4 HOURS) FROM r JOIN q ON q.user_id = r.user_id AND q.i = r.i + 1)
SELECT event_id, user_id, strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start FROM r""",
    "politeness_gaps": "SELECT event_id, user_id, round_even(gap, 3) AS gap FROM (SELECT event_id, user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events) WHERE gap < 600",
    "rate_limit_windows": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2024-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, user_id, count(*) AS n, count(*) > 2 AS limited FROM events GROUP BY ALL",
    "token_replay": "SELECT family, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS revoked_at, count(*) AS replays FROM (SELECT user_id % 40 AS family, ts, row_number() OVER (PARTITION BY user_id % 40, event_id % 700, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k > 1 GROUP BY family",
}
