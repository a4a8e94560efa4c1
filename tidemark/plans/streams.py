"""Streaming jobs run over the event files until they are worked off; each equals its batch SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.constants import SEVERITIES
from tidemark.operators.buckets import BucketTable
from tidemark.plans.usage import ORACLE_SQL as BATCH
from tidemark.sources import crawls
from tidemark.sources import tables as t
from tidemark.streaming import delivery, jobs, keyed, merged

#: How late events of the given tables come at most: every 97th comes with the next third of the month.
LATE, PARTS, EVERY = "15 days", 3, 97


def worked(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", handle: Callable[[DataFrame, int, str], None] = jobs.append, read: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """What a job made of the events, which arrive in parts by time but for the late ones; it is stopped and started again for every part.

    ``read`` gives the result from the job's folder; without it that is what :func:`jobs.append` wrote.
    """
    folder, rows = t.shared_folder(spark, "streams"), t.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = rows.agg(F.min("ts").cast("double"), F.max("ts").cast("double")).first()
    begin, width = bounds[0] or 0.0, max((bounds[1] or 0.0) - (bounds[0] or 0.0), 1.0)
    part = F.least(F.floor((F.col("ts").cast("double") - begin) / width * PARTS), F.lit(PARTS - 1)) + (F.pmod(F.col("event_id") + 1, F.lit(EVERY)) == 0).cast("int")
    for k in range(PARTS):
        rows.where(F.least(part, F.lit(PARTS - 1)) == k).write.mode("append").parquet(f"{folder}/events")
        jobs.run(build(spark.readStream.schema(rows.schema).parquet(f"{folder}/events")), handle, folder, mode)
    return read(folder) if read else spark.read.parquet(f"{folder}/out")


def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    out = worked(spark, d, lambda s: jobs.request_windows(s, ["user_id"], "6 hours", 2, LATE), "update")
    return jobs.last_update(out, ["window_start", "user_id"]).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def stream_sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    out = worked(spark, d, lambda s: jobs.sliding_counts(s, "event_type", "7 days", "1 day", LATE), "update")
    return jobs.last_update(out, ["window_start", "event_type"]).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return worked(spark, d, lambda s: jobs.deliver_once(s, ["event_id"], LATE)).select("event_id", "user_id")


def stream_usage(spark: SparkSession, d: str) -> DataFrame:
    return jobs.last_update(worked(spark, d, lambda s: jobs.monthly_usage(s, "user_id", "value"), "update"), ["user_id", "period"])


def stream_changes(spark: SparkSession, d: str) -> DataFrame:
    """Values that differ by a tenth from the user's last one of the same type; late ones correct what followed them."""
    return keyed.settled(worked(spark, d, lambda s: s, handle=merged.value_changes(["user_id", "event_type"], "value", 0.1, LATE)))


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Events of all users matched with rules made of nations."""
    k = F.col("n_nationkey")
    kinds, levels = F.array(*map(F.lit, ("click", "purchase", "error"))), F.array(*map(F.lit, SEVERITIES))
    rules = t.table(spark, d, "nation").select(
        k.alias("rule_id"), F.lit("o").alias("organization_id"), F.lit(None).cast("long").alias("competitor_id"), F.array(kinds[(k % 3).cast("int")]).alias("change_types"),
        levels[(k % 2 + 1).cast("int")].alias("min_severity"), F.array(F.lit("in_app")).alias("channels"), F.lit(True).alias("is_active"),
    )
    changes = lambda s: s.select("event_id", F.lit("o").alias("organization_id"), F.col("user_id").alias("competitor_id"), F.col("event_type").alias("change_type"), levels[(F.col("event_id") % 3).cast("int")].alias("severity"))
    return worked(spark, d, lambda s: jobs.alert_matches(changes(s), rules)).select("event_id", "rule_id", "severity")


def stream_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Each user's and type's last value with when it was seen first and last."""
    keys = ["user_id", "event_type"]
    table = BucketTable(spark, t.shared_folder(spark, "catalogue"), keys, "user_id long, event_type string, value double, first_seen timestamp, last_seen timestamp, seen_in int")
    rows = worked(spark, d, lambda s: s, handle=jobs.catalogue(table, keys, ["value"]), read=lambda _: jobs.current(table))
    return rows.select(*keys, "value", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("first_seen", "last_seen")])


def stream_replays(spark: SparkSession, d: str) -> DataFrame:
    """Families that are revoked by the second use of a token: users are families, events of one key their tokens."""
    used = lambda s: s.select(F.col("user_id").alias("family"), (F.col("event_id") % 12).alias("token"), "ts", "event_id")
    rows = keyed.settled(worked(spark, d, used, handle=merged.revoked_families("60 days", LATE)))
    return rows.select("family", "token", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("revoked_at"))


def stream_stuck_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that nothing finished in time, as far as the watermark says so: purchases start a user's job, views finish it."""
    kind = F.when(F.col("event_type") == "purchase", "start").when(F.col("event_type") == "view", "finish")
    rows = lambda s: s.select(F.col("user_id").alias("job_id"), "ts", "event_id", kind.alias("kind")).where("kind is not null")
    out = worked(spark, d, rows, handle=merged.stuck_jobs(late=LATE))
    return out.select("job_id", F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd HH:mm:ss").alias("started_at"), "attempts", "action")


def _send(row: dict) -> bool:
    """A receiver that refuses every seventh notification."""
    return int(row["notification_id"][1:]) % 7 != 0


def stream_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Every event as a notification, handed over once and tried once."""
    schema = "notification_id string, channel string"
    rows = lambda s: s.select(F.concat(F.lit("n"), "event_id").alias("notification_id"), F.col("event_type").alias("channel"))
    return worked(spark, d, rows, handle=delivery.deliveries(_send, schema, 1), read=lambda folder: delivery.statuses(spark, folder, schema, 1))


def page_source_stream(spark: SparkSession, d: str) -> DataFrame:
    """Pages as three crawls that finish one after another; the stream is stopped and started again for each."""
    spark.dataSource.register(crawls.CrawlSource)
    path, work, pages = t.shared_folder(spark, "crawls"), t.shared_folder(spark, "streams"), t.table(spark, d, "pages").select("page_id", "url", "html")
    for k in range(3):
        crawls.write_crawl(pages.where(F.col("page_id") % 3 == k), path, f"crawl-{k}", {"has_sitemap": k != 1, "sitemap_url_count": 10 * k})
        jobs.run(spark.readStream.format("crawls").load(path), jobs.append, work)
    return spark.read.parquet(f"{work}/out").select("page_id", "crawl_id", F.sha2("html", 256).alias("digest"), "has_sitemap", "sitemap_url_count")


QUERIES = {f.__name__: f for f in (stream_rate_limit, stream_sliding_counts, stream_dedup, stream_usage, stream_changes, stream_alerts, stream_catalogue, stream_replays, stream_stuck_jobs, stream_delivery, page_source_stream)}
ORACLE_SQL = {
    "stream_rate_limit": BATCH["rate_limit_windows"],
    "stream_sliding_counts": "SELECT strftime(w, '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAYS, date_trunc('day', ts), INTERVAL 1 DAY)) AS w FROM events) GROUP BY ALL",
    "stream_dedup": "SELECT DISTINCT event_id, user_id FROM events",
    "stream_usage": "SELECT user_id, strftime(ts, '%Y-%m') AS period, count(*) AS n, round_even(sum(value), 2) AS total FROM events GROUP BY ALL",
    "stream_changes": "SELECT user_id, event_type, event_id, before, after FROM (SELECT user_id, event_type, event_id, value AS after, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before FROM events) WHERE abs(after - before) / nullif(abs(before), 0) >= 0.1::DOUBLE",
    "stream_catalogue": "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events GROUP BY ALL",
    "stream_replays": "SELECT user_id AS family, event_id % 12 AS token, strftime(ts, '%Y-%m-%d %H:%M:%S') AS revoked_at FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 12 ORDER BY ts, event_id) AS k FROM events) WHERE k > 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1",
    # A start counts as stuck once the watermark, 15 days behind the newest event of the job table, is past its patience.
    "stream_stuck_jobs": """WITH e AS (SELECT user_id AS job_id, ts, event_id, event_type = 'purchase' AS start FROM events WHERE event_type IN ('purchase', 'view')),
g AS (SELECT *, lag(start) OVER w AS before, lag(ts) OVER w AS last, lead(ts) OVER w AS next FROM e WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN before AND ts - last <= INTERVAL 7 DAYS THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS run FROM g),
n AS (SELECT *, count(*) FILTER (start) OVER (PARTITION BY job_id, run ORDER BY ts, event_id) AS attempts FROM r)
SELECT job_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at, attempts, CASE WHEN attempts >= 3 THEN 'fail' ELSE 'requeue' END AS action
FROM n WHERE start AND (next IS NULL OR next > ts + INTERVAL 45 MINUTES) AND ts + INTERVAL 45 MINUTES < (SELECT max(ts) FROM e) - INTERVAL 15 DAYS""",
    "stream_delivery": "SELECT 'n' || event_id AS notification_id, 1 AS attempts, CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'sent' END AS status FROM events",
    "page_source_stream": "SELECT page_id, 'crawl-' || page_id % 3 AS crawl_id, sha256(html) AS digest, page_id % 3 <> 1 AS has_sitemap, page_id % 3 * 10 AS sitemap_url_count FROM pages",
    "stream_alerts": "SELECT event_id, n_nationkey AS rule_id, (['low', 'medium', 'high'])[event_id % 3 + 1] AS severity FROM events JOIN nation ON event_type = (['click', 'purchase', 'error'])[n_nationkey % 3 + 1] WHERE event_id % 3 >= n_nationkey % 2 + 1",
}
