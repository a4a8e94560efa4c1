"""Reports, histories, inboxes and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.state import latest


def price_history(plans: DataFrame, keys: list[str], ts: str, amount: str) -> DataFrame:
    """Each plan's amounts in time, with the one before and the step from it."""
    before = F.lag(amount).over(Window.partitionBy(*keys).orderBy(ts))
    return plans.withColumn("before", before).withColumn("step", F.bround(F.col(amount) - F.col("before"), 2))


def history(scores: DataFrame, keys: list[str], ts: str, tie: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key, with their place in time."""
    rows = latest(scores, keys, ts, tie, n)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(ts, F.col(tie).desc())))


def selection(df: DataFrame, ids: list, column: str, low: int = 2, high: int = 6) -> DataFrame:
    """Rows of the asked ids; an error if there are too few or many, or some are missing."""
    wanted = sorted(set(ids))
    if not low <= len(wanted) <= high:
        raise ValueError(f"{low} to {high} ids are needed")
    rows = df.where(F.col(column).isin(wanted))
    if (found := rows.select(column).distinct().count()) != len(wanted):
        raise ValueError(f"{len(wanted) - found} of the ids do not exist")
    return rows


def admission(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """What to do with each new ``(organization_id, domain)``: conflict with a live one, restore a deleted one, or insert."""
    known = stored.groupBy("organization_id", "domain").agg(F.bool_or(F.col("deleted_at").isNull()).alias("live"))
    both = wanted.join(known, ["organization_id", "domain"], "left")
    return both.withColumn("action", F.when(F.col("live").isNull(), "insert").when(F.col("live"), "conflict").otherwise("restore")).drop("live")


def inbox(notifications: DataFrame, reads: DataFrame) -> DataFrame:
    """In-app notifications with when they were first read (null: unread); reading is an event, no row is changed."""
    first = reads.groupBy("notification_id").agg(F.min("ts").alias("read_at"))
    return notifications.where("channel = 'in_app'").join(first, "notification_id", "left")


def profiles(competitors: DataFrame, products: DataFrame, most: int = 5) -> DataFrame:
    """Each competitor's first products by name as one list; lists are bounded before they are collected."""
    rank = F.row_number().over(Window.partitionBy("competitor_id").orderBy("name"))
    few = products.withColumn("_n", rank).where(F.col("_n") <= most).groupBy("competitor_id").agg(F.array_sort(F.collect_list("name")).alias("products"))
    return competitors.join(few, "competitor_id", "left").withColumn("products", F.coalesce("products", F.array().cast("array<string>")))


def period_report(changes: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    """Changes of the last ``days`` (1 to 365) days by severity, with the period's share of each."""
    days = max(1, min(days, 365))
    rows = changes.where((F.col(ts) >= as_of - F.make_interval(days=F.lit(days))) & (F.col(ts) < as_of))
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("competitor_id").alias("competitors"))
