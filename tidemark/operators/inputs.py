"""From one crawl's observations and facts to the features that are scored, for all competitors at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = (
    "product_count", "products_with_description", "feature_count", "pricing_plan_count", "plans_with_public_amount", "value_proposition_count", "target_audience_count", "marketing_channel_count",
    "pages_crawled", "pages_missing_title", "pages_missing_meta_description", "pages_missing_h1", "structured_data_type_count", "internal_link_count", "external_link_count", "social_profile_count",
    "case_study_pages", "cta_count", "open_graph_tag_count", "review_count",
)
FLAGS = ("has_free_tier", "has_custom_pricing", "pricing_page_found", "has_positioning_statement", "has_sitemap", "has_robots_txt", "has_blog", "has_favicon")


def scoring_inputs(competitors: DataFrame, products: DataFrame, plans: DataFrame, positioning: DataFrame, seo: DataFrame, reviews: DataFrame) -> DataFrame:
    """The 32 features of each row of ``competitors(competitor_id, favicon_url, key_features, has_sitemap, has_robots_txt)``.

    ``products(competitor_id, description, features)`` and ``plans(competitor_id, amount, is_custom_pricing)`` are combined
    before their shuffles; ``positioning(competitor_id, value_propositions, target_audience, marketing_channels, statement,
    confidence)``, ``seo`` (a row per site of :func:`tidemark.operators.extract.seo_summary`, ``site`` being the
    competitor) and ``reviews(key, review_count, sentiment)`` have a row per competitor at most.  What is missing counts 0.
    """
    p = products.groupBy("competitor_id").agg(
        F.count("*").alias("product_count"), F.count_if(F.coalesce("description", F.lit("")) != "").alias("products_with_description"), F.avg(F.coalesce(F.size("features"), F.lit(0)).cast("double")).alias("features_per_product")
    )
    a = plans.groupBy("competitor_id").agg(
        F.count("*").alias("pricing_plan_count"), F.count_if(F.col("amount").isNotNull()).alias("plans_with_public_amount"), F.coalesce(F.bool_or(F.col("amount") == 0), F.lit(False)).alias("has_free_tier"),
        F.coalesce(F.bool_or("is_custom_pricing"), F.lit(False)).alias("has_custom_pricing"),
    )
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    w = positioning.select(
        "competitor_id", size("value_propositions").alias("value_proposition_count"), size("target_audience").alias("target_audience_count"), size("marketing_channels").alias("marketing_channel_count"),
        (F.coalesce("statement", F.lit("")) != "").alias("has_positioning_statement"), F.col("confidence").alias("ai_confidence"),
    )
    s = seo.withColumnRenamed("site", "competitor_id").withColumn("structured_data_type_count", F.size("structured_data_types")).drop("structured_data_types")
    r = reviews.select(F.col("key").alias("competitor_id"), "review_count", F.col("sentiment").alias("sentiment_score"))
    base = competitors.select("competitor_id", size("key_features").alias("feature_count"), (F.coalesce("favicon_url", F.lit("")) != "").alias("has_favicon"), "has_sitemap", "has_robots_txt")
    rows = base
    for part in (p, a, w, s, r):
        rows = rows.join(part, "competitor_id", "left")
    rows = rows.na.fill(0, list(COUNTS)).na.fill(0.0, ["features_per_product", "avg_word_count"]).na.fill(False, list(FLAGS))
    return rows.select("competitor_id", *COUNTS, "features_per_product", "avg_word_count", "sentiment_score", "ai_confidence", *FLAGS)


def plan_text(name: Column, amount: Column, currency: Column, period: Column, is_custom: Column) -> Column:
    """A plan as a report shows it: its price and period, ``custom``, ``free``, or ``unpublished``."""
    price = F.when(is_custom, "custom").when(amount == 0, "free").when(amount.isNull(), "unpublished").otherwise(F.concat_ws(" ", currency, F.regexp_replace(F.format_string("%.2f", amount), r"\.?0+$", ""), period))
    return F.concat_ws(": ", name, price)


def approximate_tokens(text: Column) -> Column:
    """About how many tokens a text has for a language model."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def token_accounting(stages: DataFrame) -> DataFrame:
    """``analysis_id, tokens_in, tokens_out, confidence`` of ``stages(analysis_id, tokens_in, tokens_out, confidence)``: sums, and the least confidence."""
    return stages.groupBy("analysis_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.min("confidence").alias("confidence"))


def rejected_summary(pages: DataFrame) -> DataFrame:
    """``competitor_id, accepted, rejected, failure`` of ``pages(competitor_id, seq, reject_code)``: the first error where no page was accepted."""
    bad = F.col("reject_code").isNotNull()
    rows = pages.groupBy("competitor_id").agg(F.count_if(~bad).alias("accepted"), F.count_if(bad).alias("rejected"), F.min_by("reject_code", F.when(bad, F.col("seq"))).alias("failure"))
    return rows.withColumn("failure", F.when(F.col("accepted") == 0, F.col("failure")))


def headings(h1: Column, h2: Column, h3: Column) -> Column:
    """All headings of a page in the order of their levels."""
    none = F.array().cast("array<string>")
    return F.flatten(F.array(*[F.coalesce(h, none) for h in (h1, h2, h3)]))


def prompt_blocks(pages: DataFrame, most_pages: int = 12, most_chars: int = 6_000) -> DataFrame:
    """``competitor_id, prompt, tokens``: the text that a model is given on each competitor's first pages.

    ``pages(competitor_id, position, url, title, text)``; pages and characters are bounded before they are collected.
    """
    block = F.concat(F.lit("## "), F.coalesce("title", F.col("url")), F.lit("\n"), "url", F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, most_chars))
    rows = pages.where(F.col("position") <= most_pages).select("competitor_id", F.struct("position", block.alias("block")).alias("b"))
    rows = rows.groupBy("competitor_id").agg(F.array_join(F.array_sort(F.collect_list("b"))["block"], "\n\n").alias("prompt"))
    return rows.withColumn("tokens", approximate_tokens(F.col("prompt")))
