"""Facts read from pages without a model: plans from observed prices, products and features from headings, positioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import PLAN_WORDS


def price_gate(prices: DataFrame, most: int = 60) -> DataFrame:
    """``prices(competitor_id, page_type, seq, ...)`` of pricing pages only where a competitor has any, at most ``most``."""
    has = prices.where("page_type = 'pricing'").select("competitor_id").distinct().withColumn("has", F.lit(True))
    rows = prices.join(has, "competitor_id", "left").where(F.col("has").isNull() | (F.col("page_type") == "pricing")).drop("has")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("competitor_id").orderBy("seq"))).where(F.col("_n") <= most).drop("_n")


def plan_label(preceding: Column, context: Column) -> Column:
    """The last plan word before a price, else the first around it, in title case; null without one."""
    words = F.lit(r"(?i)\b(" + "|".join(PLAN_WORDS) + r")\b")
    before, around = (F.regexp_extract_all(F.coalesce(x, F.lit("")), words, F.lit(1)) for x in (preceding, context))
    return F.initcap(F.coalesce(F.try_element_at(before, F.lit(-1)), F.try_element_at(around, F.lit(1))))


def plans_from_prices(prices: DataFrame, most: int = 12) -> DataFrame:
    """Named plans from the first prices of pages of type pricing or unknown; the first of a name and period counts."""
    rows = prices.where("page_type is null or page_type = 'pricing'")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("competitor_id").orderBy("seq"))).where(F.col("_n") <= most)
    rows = rows.withColumn("name", plan_label(F.col("preceding"), F.col("context"))).where("name is not null")
    first = F.row_number().over(Window.partitionBy("competitor_id", "name", "period").orderBy("seq"))
    return rows.withColumn("_n", first).where("_n = 1").select("competitor_id", "name", "amount", "currency", "period", F.lit("observed").alias("source"))


def pricing_note(named: Column, unnamed: Column, observed: Column) -> Column:
    """Why a site's pricing is as it is: counts of named plans, of candidates without a name, and of all observed prices; null where nothing is to say."""
    n = lambda c: c.cast("string")
    # The notes' texts.
    none = "No prices were found on the crawled pages."
    products = " price(s) were found on this site, but none of them sits next to a recognisable plan name. That usually means the prices belong to products rather than to subscription tiers. Configure an AI provider to interpret them."
    more = " further price(s) were found that could not be matched to a named plan."
    return F.when((named > 0) & (unnamed == 0), None).when(observed == 0, none).when(named == 0, F.concat(n(observed), F.lit(products))).otherwise(F.concat(n(unnamed), F.lit(more)))


def pricing_notes(competitors: DataFrame, prices: DataFrame, most: int = 12) -> DataFrame:
    """``competitor_id, observed, named, confidence, note`` of every competitor, from its ``prices(competitor_id, page_type, seq, preceding, context)``.

    Candidates are the first ``most`` prices of pages of type pricing or unknown; with a named plan the confidence is 0.3, else 0.1.
    """
    seen = prices.groupBy("competitor_id").agg(F.count("*").alias("observed"))
    few = prices.where("page_type is null or page_type = 'pricing'").withColumn("_n", F.row_number().over(Window.partitionBy("competitor_id").orderBy("seq"))).where(F.col("_n") <= most)
    label = plan_label(F.col("preceding"), F.col("context"))
    few = few.groupBy("competitor_id").agg(F.countDistinct(F.lower(label)).alias("named"), F.count_if(label.isNull()).alias("unnamed"))
    rows = competitors.select("competitor_id").join(seen, "competitor_id", "left").join(few, "competitor_id", "left").na.fill(0, ["observed", "named", "unnamed"])
    return rows.select("competitor_id", "observed", "named", F.when(F.col("named") > 0, 0.3).otherwise(0.1).alias("confidence"), pricing_note(F.col("named"), F.col("unnamed"), F.col("observed")).alias("note"))


def catalogue_from_headings(headings: DataFrame) -> DataFrame:
    """``headings(competitor_id, seq, text)``: the first six different ones are products, up to twelve more features."""
    once = headings.withColumn("_n", F.row_number().over(Window.partitionBy("competitor_id", F.lower("text")).orderBy("seq"))).where("_n = 1")
    rows = once.withColumn("position", F.row_number().over(Window.partitionBy("competitor_id").orderBy("seq"))).where("position <= 18")
    return rows.select("competitor_id", F.when(F.col("position") <= 6, "product").otherwise("feature").alias("kind"), F.col("text").alias("name"), "position", F.lit("ai_inference").alias("source"))


def positioning(sites: DataFrame) -> DataFrame:
    """``sites(competitor_id, title, description, words, ctas)`` with a summary and what speaks for and against the site."""
    # The insights' titles.
    strengths = F.array_compact(F.array(F.when(F.col("ctas") > 0, "Clear conversion paths"), F.when(F.col("words") > 1500, "Substantial site content")))
    weaknesses = F.array_compact(F.array(F.when(F.coalesce("description", F.lit("")) == "", "Missing meta description"), F.when((F.col("words") > 0) & (F.col("words") < 400), "Thin page content")))
    return sites.select("competitor_id", F.coalesce("description", "title").alias("summary"), strengths.alias("strengths"), weaknesses.alias("weaknesses"))


def page_budget(pages: DataFrame, budget: int, chars: int) -> DataFrame:
    """The home page, then the most valuable ones, at most ``budget`` per competitor, their texts cut to ``chars``."""
    order = Window.partitionBy("competitor_id").orderBy((F.col("page_type") != "home").cast("int"), F.col("score").desc(), "url")
    rows = pages.withColumn("position", F.row_number().over(order)).where(F.col("position") <= budget)
    return rows.withColumn("text", F.substring("text", 1, chars))


def extract_facts(observed: DataFrame, sites: DataFrame, facts_fn: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """``competitor_id, kind, name, position, source`` of a crawl's pages, by ``facts_fn(observed, sites)``; products and features from headings by default.

    ``sites(page_id, site)`` names the competitor.
    """
    if facts_fn is not None:
        return facts_fn(observed, sites)
    levels = [F.coalesce(h, F.array().cast("array<string>")) for h in ("h1", "h2", "h3")]
    heads = observed.select("page_id", F.posexplode(F.flatten(F.array(*levels))).alias("place", "text")).join(sites.select("page_id", "site"), "page_id")
    return catalogue_from_headings(heads.select(F.col("site").alias("competitor_id"), F.struct("page_id", "place").alias("seq"), "text"))
