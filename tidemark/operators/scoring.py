"""Eight scores per competitor and their weighted overall; what is not known stays null and out of the weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.constants import THREATS, WEIGHTS


def bounded(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(100.0)), F.lit(0.0))


def scale(value: Column | str, best: float) -> Column:
    """Share of ``best`` in percent, at most 100."""
    col = F.col(value) if isinstance(value, str) else value
    return bounded(col.cast("double") / F.lit(float(best)) * 100.0)


def _share(part: str, whole: str) -> Column:
    return F.col(part).cast("double") / F.col(whole) * 100.0


def _flag(name: str) -> Column:
    return F.col(name).cast("double")


def dimensions() -> dict[str, Column]:
    """Score columns over the 32 features of a competitor; null where a dimension has no data."""
    present = lambda missing: (F.col("pages_crawled") - F.col(missing)).cast("double") / F.col("pages_crawled") * 100.0
    site = 40.0 * _flag("has_sitemap") + 20.0 * _flag("has_robots_txt") + F.least(F.lit(40.0), 13.0 * F.col("structured_data_type_count"))
    signals = F.col("marketing_channel_count") + F.col("social_profile_count") + F.col("case_study_pages") + F.col("cta_count")
    return {
        "product": F.when(F.col("product_count") > 0, bounded(0.5 * scale("product_count", 8) + 0.25 * _share("products_with_description", "product_count") + 0.25 * scale("features_per_product", 6))),
        "pricing": F.when(
            F.col("pricing_page_found") | (F.col("pricing_plan_count") > 0),
            bounded(
                0.45 * F.when(F.col("pricing_plan_count") > 0, _share("plans_with_public_amount", "pricing_plan_count")).otherwise(0.0) + 0.35 * scale("pricing_plan_count", 4)
                + 0.2 * F.least(60.0 * _flag("has_free_tier") + 40.0 * _flag("has_custom_pricing"), F.lit(100.0))
            ),
        ),
        "features": F.when(F.col("feature_count") > 0, scale("feature_count", 25)),
        "positioning": F.when(
            (F.col("value_proposition_count") > 0) | (F.col("target_audience_count") > 0) | F.col("has_positioning_statement"),
            bounded(0.4 * scale("value_proposition_count", 4) + 0.3 * scale("target_audience_count", 3) + 30.0 * _flag("has_positioning_statement")),
        ),
        "seo": F.when(
            F.col("pages_crawled") > 0,
            bounded(
                0.25 * present("pages_missing_title") + 0.2 * present("pages_missing_meta_description") + 0.15 * present("pages_missing_h1") + 0.2 * site
                + 0.2 * (0.5 * scale("avg_word_count", 900) + 50.0 * _flag("has_blog"))
            ),
        ),
        "marketing": F.when(
            signals > 0,
            bounded(0.25 * scale("marketing_channel_count", 5) + 0.2 * scale("social_profile_count", 4) + 0.2 * scale("case_study_pages", 3) + 0.2 * scale("cta_count", 5) + 15.0 * _flag("has_blog")),
        ),
        "brand": F.when(
            F.col("pages_crawled") > 0,
            bounded(0.35 * scale("open_graph_tag_count", 6) + 20.0 * _flag("has_favicon") + 0.25 * scale("external_link_count", 25) + 0.2 * scale("structured_data_type_count", 3)),
        ),
        "sentiment": F.when((F.col("review_count") > 0) & F.col("sentiment_score").isNotNull(), bounded((F.col("sentiment_score") + 1.0) * 50.0)),
    }


def score_dimensions(inputs: DataFrame) -> DataFrame:
    """``competitor_id, dimension, score, weight`` with a row for every dimension, its score null if unknown."""
    scores = inputs.select("competitor_id", *[F.bround(c, 1).alias(k) for k, c in dimensions().items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("score"), F.lit(w).alias("weight")) for k, w in WEIGHTS.items()])
    return scores.select("competitor_id", F.inline(pairs))


def threat_level(overall: Column, completeness: Column) -> Column:
    level = F.when(overall >= 80, "critical").when(overall >= 60, "high").when(overall >= 40, "moderate").otherwise("low")
    return F.when(overall.isNull() | (completeness < 0.5), "unknown").otherwise(level)


def scored(inputs: DataFrame, *keep: str) -> DataFrame:
    """One row per competitor: ``keep``, its eight scores, ``overall, completeness, confidence, threat_level``.

    One projection over the inputs: scores are never shuffled.  Weights are renormalised over known dimensions, the
    overall score is in fives.
    """
    scores = {k: F.bround(c, 1) for k, c in dimensions().items()}
    rows = inputs.select("competitor_id", *keep, "ai_confidence", "pages_crawled", *[c.alias(k) for k, c in scores.items()])
    known = [F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in WEIGHTS.items()]
    weight, n = sum(known, F.lit(0.0)), sum((F.col(k).isNotNull().cast("int") for k in WEIGHTS), F.lit(0))
    value = sum((F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in zip(WEIGHTS, known)), F.lit(0.0))
    rows = rows.withColumns({"overall": F.when(n > 0, F.bround(F.bround(value / F.nullif(weight, F.lit(0.0)), 6) / 5.0, 0) * 5.0), "completeness": F.bround(n / F.lit(8.0), 4)})
    confidence = F.coalesce(0.6 * F.col("completeness") + 0.4 * F.col("ai_confidence"), F.col("completeness")) * F.when(F.col("pages_crawled") < 3, 0.7).otherwise(1.0)
    confidence = F.bround(F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0)), 2)
    return rows.select("competitor_id", *keep, *WEIGHTS, "overall", "completeness", confidence.alias("confidence"), threat_level(F.col("overall"), F.col("completeness")).alias("threat_level"))


def score_overall(inputs: DataFrame) -> DataFrame:
    """``competitor_id, overall, completeness, confidence, threat_level`` of :func:`scored`."""
    return scored(inputs).drop(*WEIGHTS)


def threat_distribution(scores: DataFrame) -> DataFrame:
    return scores.groupBy("threat_level").agg(F.count("*").alias("n"))


def worst_threat(scores: DataFrame, *keys: str) -> DataFrame:
    """The worst level per key; with no keys one row, ``unknown`` for no scores."""
    rank = F.array_position(F.array(*map(F.lit, THREATS)), F.col("threat_level"))
    worst = F.max(F.when(rank > 0, rank))
    return scores.groupBy(*keys).agg(F.when(worst.isNull(), "unknown").otherwise(F.get(F.array(*map(F.lit, THREATS)), F.coalesce(worst, F.lit(1)).cast("int") - 1)).alias("worst"))


def market_gaps(scores: DataFrame, below: float = 55.0, most: int = 4) -> DataFrame:
    """Dimensions of :func:`scored` rows whose mean is low, weakest first, if at least half of the competitors (and two) have a score.

    One aggregate for all dimensions.
    """
    total = scores.agg(F.count("*").alias("total"), *[x for k in WEIGHTS for x in (F.avg(k).alias(f"{k}_mean"), F.count(k).alias(f"{k}_n"))])
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(f"{k}_mean").alias("mean"), F.col(f"{k}_n").alias("n")) for k in WEIGHTS])
    rows = total.select("total", F.inline(each))
    rows = rows.where((F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("total") / 2))) & (F.col("mean") < below))
    return rows.orderBy("mean", "dimension").limit(most).select("dimension", F.bround("mean", 1).alias("mean"), "n")


def comparison_matrix(scores: DataFrame) -> DataFrame:
    """A column per dimension and the overall score of each competitor of :func:`scored` rows."""
    return scores.select("competitor_id", *WEIGHTS, "overall", "threat_level")


def review_sentiment(reviews: DataFrame) -> DataFrame:
    """``key, review_count, rating, sentiment`` of ``reviews(key, rating, max_rating)``; ratings are clamped to 0..1."""
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rating") / F.col("max_rating")))
    return reviews.groupBy("key").agg(F.count("*").alias("review_count"), F.bround(F.avg(unit), 4).alias("rating"), F.bround(2 * F.avg(unit) - 1, 4).alias("sentiment"))
