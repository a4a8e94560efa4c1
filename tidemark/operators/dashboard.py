"""Dashboards, timelines and lists: facts with their competitors' names, counts of a period, the newest and the best of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scoring import worst_threat
from tidemark.operators.state import latest_struct


def with_names(facts: DataFrame, competitors: DataFrame) -> DataFrame:
    """Facts of known competitors with their name; those of others go."""
    return facts.join(competitors.select("competitor_id", "name"), "competitor_id")


def with_latest_score(competitors: DataFrame, scores: DataFrame) -> DataFrame:
    """``competitors`` with ``overall`` and ``threat_level`` of their newest row of ``scores(competitor_id, overall, threat_level, created_at, score_id)``.

    Without one the level is ``unknown`` and the score null.
    """
    new = latest_struct(scores, ["competitor_id"], "created_at", "score_id").select("competitor_id", "overall", "threat_level")
    return competitors.join(new, "competitor_id", "left").withColumn("threat_level", F.coalesce("threat_level", F.lit("unknown")))


def newest(df: DataFrame, keys: list[str], ts: str, tie: str, most: int) -> DataFrame:
    """The newest ``most`` rows of each key with their ``position``; equal times by the smaller ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc_nulls_last(), tie)
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def timeline(df: DataFrame, keys: list[str], ts: str, tie: str, begin: Column, end: Column, most: int) -> DataFrame:
    """The newest ``most`` rows of each key in ``[begin, end)``."""
    return newest(df.where((F.col(ts) >= begin) & (F.col(ts) < end)), keys, ts, tie, most)


def landscape(competitors: DataFrame, most: int = 12) -> DataFrame:
    """Each organisation's best active competitors of ``competitors(organization_id, competitor_id, status, overall, ...)``, unknown scores last."""
    order = Window.partitionBy("organization_id").orderBy(F.col("overall").desc_nulls_last(), "competitor_id")
    return competitors.where("status = 'active'").withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)


def recent_changes(changes: DataFrame, since: Column) -> DataFrame:
    """Changes of each organisation since a time, and how many of them are severe."""
    rows = changes.where(F.col("detected_at") >= since)
    return rows.groupBy("organization_id").agg(F.count("*").alias("changes_last_7_days"), F.count_if(F.col("severity") == "high").alias("high_severity_changes"))


def recent_jobs(jobs: DataFrame, since: Column) -> DataFrame:
    rows = jobs.where(F.col("created_at") >= since)
    return rows.groupBy("organization_id").agg(F.count_if(F.col("status").isin("pending", "running")).alias("running_jobs"), F.count_if(F.col("status") == "failed").alias("failed_jobs"))


def overview(competitors: DataFrame, scores: DataFrame, changes: DataFrame, jobs: DataFrame, analyses: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """One row per organisation: competitors by status, mean score, worst threat, the period's changes and jobs, and whether a recent analysis is a mock.

    ``competitors(organization_id, competitor_id, name, status, last_analyzed_at, latest_overall_score)`` gives the rows;
    every other table is combined per organisation before it is joined.
    """
    since = as_of - F.make_interval(days=F.lit(days))
    key = "organization_id"
    rows = competitors.groupBy(key).agg(
        F.count_if(F.col("status") == "active").alias("competitors_tracked"), F.count_if(F.col("status") == "archived").alias("competitors_archived"),
        F.count_if(F.col("last_analyzed_at").isNotNull()).alias("competitors_analyzed"), F.bround(F.avg("latest_overall_score"), 1).alias("average_score"),
    )
    # Competitors without a score have no level and do not count.
    known = latest_struct(scores, ["competitor_id"], "created_at", "score_id").select("competitor_id", "threat_level")
    worst = worst_threat(competitors.where("status = 'active'").join(known, "competitor_id"), key).withColumnRenamed("worst", "overall_threat_level")
    mock = newest(analyses, [key], "created_at", "analysis_id", 6).groupBy(key).agg(F.bool_or("is_mock").alias("uses_mock_ai"))
    rows = rows.join(recent_changes(changes, since), key, "left").join(recent_jobs(jobs, since), key, "left").join(worst, key, "left").join(mock, key, "left")
    counts = ["changes_last_7_days", "high_severity_changes", "running_jobs", "failed_jobs"]
    return rows.na.fill(0, counts).withColumns({"overall_threat_level": F.coalesce("overall_threat_level", F.lit("unknown")), "uses_mock_ai": F.coalesce("uses_mock_ai", F.lit(False))})


#: Sort keys that a list may be asked for, with column and direction.
SORTS = {
    "created_at": ("created_at", "desc"),
    "name": ("name", "asc"),
    "score": ("latest_overall_score", "desc_nulls_last"),
    "last_analyzed": ("last_analyzed_at", "desc_nulls_last"),
}


def order_of(sort: str | None) -> list[Column]:
    """The order of a whitelisted sort key; any other key sorts by creation."""
    column, way = SORTS.get(sort or "", SORTS["created_at"])
    return [getattr(F.col(column), way)(), F.col("competitor_id")]


def find(competitors: DataFrame, status: str | None = "active", category: str | None = None, importance: str | None = None, tags: list[str] | None = None, text: str | None = None) -> DataFrame:
    """Competitors by equal status, category and importance, by any of some tags, and by a text in name or domain."""
    rows = competitors
    for column, value in (("status", status), ("category", category), ("importance", importance)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    if tags:
        rows = rows.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if text:
        rows = rows.where(F.contains(F.lower("name"), F.lower(F.lit(text))) | F.contains(F.lower("domain"), F.lower(F.lit(text))))
    return rows


def acknowledged(changes: DataFrame, acknowledgements: DataFrame) -> DataFrame:
    """Changes with when they were first acknowledged (null: not yet) and whether they are."""
    first = acknowledgements.groupBy("change_id").agg(F.min("ts").alias("acknowledged_at"))
    return changes.join(first, "change_id", "left").withColumn("acknowledged", F.col("acknowledged_at").isNotNull())


def change_summaries(changes: DataFrame, most: int = 20) -> DataFrame:
    """A headline and an explanation for each competitor's first ``most`` changes in their order."""
    rows = changes.where(F.col("position") <= most)
    told = F.when(F.col("before").isNull() & F.col("after").isNull(), "").otherwise(F.concat_ws("", F.lit(": "), F.coalesce("before", F.lit("nothing")), F.lit(" -> "), F.coalesce("after", F.lit("nothing"))))
    return rows.select("competitor_id", "position", F.col("title").alias("headline"), F.concat(F.replace("change_type", F.lit("_"), F.lit(" ")), F.lit(", "), "severity", told).alias("explanation"))
