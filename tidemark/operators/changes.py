"""What changed between two states of plans, products, features, pages and positioning texts, for all competitors at once.

Every function returns rows of one shape: ``competitor_id, change_type, severity, entity_key, title, magnitude, before,
after``.  States are matched by one shuffle on their keys; a full outer join gives added, removed and changed rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import format_price, jaccard, normalize_name, rank_of

COLUMNS = ("competitor_id", "change_type", "severity", "entity_key", "title", "magnitude", "before", "after")
PRICE_NOISE, PRICE_HIGH, PRICE_MEDIUM = 0.01, 0.20, 0.05
SET_CAP, PAGE_CAP, PAGE_LIST, TEXT_NOISE = 10, 8, 20, 0.15


def last_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest ``order`` of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def plan_diff(old: DataFrame, new: DataFrame, currency_aware: bool = False) -> DataFrame:
    """Changes of plans ``competitor_id, name, amount, currency, billing_period, seq`` matched by normalised name and period.

    With equal keys in one state the last by ``seq`` counts.  A null amount means unpublished; an old amount of zero gives
    no price change.  With ``currency_aware`` a plan in another currency is removed and added.
    """
    keys = ["competitor_id", "key"]

    def state(df: DataFrame, side: str) -> DataFrame:
        parts = [normalize_name(F.col("name")), F.col("billing_period")] + ([F.coalesce("currency", F.lit(""))] if currency_aware else [])
        df = last_wins(df.withColumn("key", F.concat_ws("|", *parts)), keys, "seq")
        return df.select(*keys, F.struct("name", "amount", "currency").alias(side))

    both = state(old, "o").join(state(new, "n"), keys, "full_outer")
    a, b = F.col("o.amount"), F.col("n.amount")
    ratio = F.abs(b - a) / F.nullif(a, F.lit(0.0))
    priced = F.col("o").isNotNull() & F.col("n").isNotNull() & a.isNotNull() & b.isNotNull()
    kind = (
        F.when(F.col("o").isNull(), "plan_added").when(F.col("n").isNull(), "plan_removed")
        .when(a.isNull() & b.isNotNull(), "price_decreased").when(a.isNotNull() & b.isNull(), "price_increased")
        .when(priced & (ratio >= PRICE_NOISE), F.when(b > a, "price_increased").otherwise("price_decreased"))
    )
    severity = F.when(priced, F.when(ratio >= PRICE_HIGH, "high").when(ratio >= PRICE_MEDIUM, "medium").otherwise("low")).otherwise("medium")
    price = lambda side: format_price(F.col(f"{side}.amount"), F.col(f"{side}.currency"))
    title = F.when(F.col("o").isNull() | F.col("n").isNull(), F.concat_ws(": ", F.col("competitor_id"), F.coalesce("n.name", "o.name"))).otherwise(
        F.concat(F.col("competitor_id"), F.lit(": "), F.col("n.name"), F.lit(" "), price("o"), F.lit(" to "), price("n"))
    )
    rows = both.withColumn("change_type", kind).where("change_type is not null")
    return rows.select(
        "competitor_id", "change_type", severity.alias("severity"), F.col("key").alias("entity_key"), title.alias("title"),
        F.when(priced, F.bround(ratio, 4)).alias("magnitude"), F.when(F.col("o").isNotNull(), price("o")).alias("before"), F.when(F.col("n").isNotNull(), price("n")).alias("after"),
    )


def set_diff(old: DataFrame, new: DataFrame, noun: str, added_severity: str, cap: int = SET_CAP) -> DataFrame:
    """Added and removed names of ``competitor_id, name, seq``, matched by normalised name; ``cap`` of each by name order."""

    def state(df: DataFrame) -> DataFrame:
        df = df.where("name is not null and name <> ''").withColumn("entity_key", normalize_name(F.col("name")))
        return last_wins(df, ["competitor_id", "entity_key"], "seq").select("competitor_id", "entity_key", "name")

    o, n = state(old), state(new)
    keys = ["competitor_id", "entity_key"]
    added = n.join(o, keys, "left_anti").withColumns({"change_type": F.lit(f"{noun}_added"), "severity": F.lit(added_severity)})
    removed = o.join(n, keys, "left_anti").withColumns({"change_type": F.lit(f"{noun}_removed"), "severity": F.lit("low")})
    rank = F.row_number().over(Window.partitionBy("competitor_id", "change_type").orderBy("name", "entity_key"))
    rows = added.unionByName(removed).withColumn("_n", rank).where(F.col("_n") <= cap)
    is_new = F.endswith("change_type", F.lit("added"))
    return rows.select(
        "competitor_id", "change_type", "severity", "entity_key", F.concat_ws(": ", "competitor_id", "name").alias("title"), F.lit(None).cast("double").alias("magnitude"),
        F.when(~is_new, F.col("name")).alias("before"), F.when(is_new, F.col("name")).alias("after"),
    )


def page_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added and removed pages of ``competitor_id, url, text_hash`` (at most 8 of each by URL), and one row per competitor
    whose common pages' texts changed, its magnitude their number."""
    o = old.select("competitor_id", "url", F.col("text_hash").alias("oh"), F.lit(True).alias("was"))
    n = new.select("competitor_id", "url", F.col("text_hash").alias("nh"), F.lit(True).alias("now"))
    both = o.join(n, ["competitor_id", "url"], "full_outer")
    kind = F.when(F.col("was").isNull(), "page_added").when(F.col("now").isNull(), "page_removed").when(F.col("oh") != F.col("nh"), "content_changed")
    rows = both.withColumn("change_type", kind).where("change_type is not null")
    rank = F.row_number().over(Window.partitionBy("competitor_id", "change_type").orderBy("url"))
    none = F.lit(None).cast("string")
    moved = rows.where("change_type <> 'content_changed'").withColumn("_n", rank).where(F.col("_n") <= PAGE_CAP)
    is_new = F.col("change_type") == "page_added"
    moved = moved.select(
        "competitor_id", "change_type", F.lit("low").alias("severity"), F.col("url").alias("entity_key"), F.concat_ws(": ", "competitor_id", "url").alias("title"), F.lit(None).cast("double").alias("magnitude"),
        F.when(~is_new, F.col("url")).alias("before"), F.when(is_new, F.col("url")).alias("after"),
    )
    edited = rows.where("change_type = 'content_changed'").withColumn("_n", rank).groupBy("competitor_id").agg(
        F.count("*").alias("c"), F.array_sort(F.collect_list(F.when(F.col("_n") <= PAGE_LIST, F.col("url")))).alias("urls")
    )
    edited = edited.select(
        "competitor_id", F.lit("content_changed").alias("change_type"), F.when(F.col("c") < 3, "low").otherwise("medium").alias("severity"), F.lit("pages").alias("entity_key"),
        F.concat(F.col("competitor_id"), F.lit(": "), F.col("c"), F.lit(" pages changed")).alias("title"), F.col("c").cast("double").alias("magnitude"), none.alias("before"), F.array_join("urls", ",").alias("after"),
    )
    return moved.unionByName(edited)


def positioning_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rewritten texts of ``competitor_id, positioning``: a word-set similarity under 0.85, of high severity under 0.5."""
    both = old.select("competitor_id", F.col("positioning").alias("a")).join(new.select("competitor_id", F.col("positioning").alias("b")), "competitor_id")
    both = both.where("a <> '' and b <> ''").withColumn("j", jaccard(F.col("a"), F.col("b"))).where(F.col("j") < 1 - TEXT_NOISE)
    return both.select(
        "competitor_id", F.lit("positioning_changed").alias("change_type"), F.when(F.col("j") < 0.5, "high").otherwise("medium").alias("severity"), F.lit("positioning").alias("entity_key"),
        F.concat_ws(": ", "competitor_id", F.lit("positioning changed")).alias("title"), F.bround(1 - F.col("j"), 3).alias("magnitude"), F.substring("a", 1, 1000).alias("before"), F.substring("b", 1, 1000).alias("after"),
    )


def all_changes(*streams: DataFrame) -> DataFrame:
    """The change streams together with ``position``: severest first, then in the streams' order and by key."""
    parts = [df.select(*COLUMNS).withColumn("stage", F.lit(k)) for k, df in enumerate(streams)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order = Window.partitionBy("competitor_id").orderBy(rank_of(F.col("severity")).desc(), "stage", "change_type", "entity_key")
    return rows.withColumn("position", F.row_number().over(order)).withColumns({"title": F.substring("title", 1, 300), "entity_key": F.substring("entity_key", 1, 200)}).drop("stage")


def after_baseline(changes: DataFrame, analyses: DataFrame) -> DataFrame:
    """Only changes of competitors with an earlier analysis: a first one has nothing to compare with."""
    return changes.join(analyses.select("competitor_id").distinct(), "competitor_id", "left_semi")


def count_by(changes: DataFrame, *keys: str) -> DataFrame:
    return changes.groupBy(*keys).agg(F.count("*").alias("n"))
