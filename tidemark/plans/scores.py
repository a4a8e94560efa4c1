"""Scores, dashboards, comparisons and reviews."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.constants import WEIGHTS
from tidemark.operators import scoring
from tidemark.sources import tables as t


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    return t.score_inputs(t.table(spark, d, "supplier"), t.table(spark, d, "lineitem"))


def score_dimensions(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_dimensions(_inputs(spark, d))


def score_overall(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_overall(_inputs(spark, d))


def threat_distribution(spark: SparkSession, d: str) -> DataFrame:
    return scoring.threat_distribution(score_overall(spark, d))


def worst_threat(spark: SparkSession, d: str) -> DataFrame:
    return scoring.worst_threat(scoring.scored(_inputs(spark, d), "organization_id"), "organization_id")


def market_gaps(spark: SparkSession, d: str) -> DataFrame:
    return scoring.market_gaps(scoring.scored(_inputs(spark, d)))


def comparison_matrix(spark: SparkSession, d: str) -> DataFrame:
    return scoring.comparison_matrix(scoring.scored(_inputs(spark, d)))


def comparison_leader(spark: SparkSession, d: str) -> DataFrame:
    """The best competitor of each organisation, and of each dimension within it."""
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).alias("score")) for k in WEIGHTS])
    rows = scoring.scored(_inputs(spark, d), "organization_id").select("competitor_id", "organization_id", F.inline(each)).where("score is not null")
    # Ties are counted per score before the best one is taken.
    rows = rows.groupBy("organization_id", "dimension", "score").agg(F.min("competitor_id").alias("leader"), F.count("*").alias("tied"))
    best = F.max(F.struct("score", "leader", "tied")).alias("b")
    return rows.groupBy("organization_id", "dimension").agg(best).select("organization_id", "dimension", "b.score", "b.leader", "b.tied")


def dashboard_counters(spark: SparkSession, d: str) -> DataFrame:
    """Per organisation: competitors, active and analysed ones, and their mean score."""
    rows = scoring.scored(_inputs(spark, d), "organization_id", "has_favicon")
    return rows.groupBy("organization_id").agg(
        F.count("*").alias("competitors"), F.count_if("has_favicon").alias("active"), F.count_if(~F.col("has_favicon")).alias("archived"), F.count_if(F.col("overall").isNotNull()).alias("analysed"), F.bround(F.avg("overall"), 1).alias("mean_score")
    )


def landscape_top(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best competitors, unknown scores last."""
    return score_overall(spark, d).orderBy(F.col("overall").desc_nulls_last(), "competitor_id").limit(12)


def review_sentiment(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "labels").join(t.table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return scoring.review_sentiment(rows.select(F.col("source").alias("key"), F.col("quality").cast("double").alias("rating"), F.lit(1.0).alias("max_rating")))


def score_report(spark: SparkSession, d: str) -> DataFrame:
    """Each competitor's dimensions as one text, measured ones first by score, then the unknown."""
    rows = score_dimensions(spark, d).withColumn("text", F.when(F.col("score").isNull(), "Insufficient data").otherwise(F.format_string("%.1f", "score")))
    item = F.struct((-F.coalesce("score", F.lit(-1.0))).alias("k"), "dimension", "text")
    return rows.groupBy("competitor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat_ws("=", x["dimension"], x["text"])), ";").alias("section"))


_IN = """s AS (SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, count(*) FILTER (l_discount > 0.05::DOUBLE) AS disc, count(*) FILTER (l_returnflag = 'R') AS ret, count(*) FILTER (l_linenumber = 1) AS firsts, avg(l_quantity) AS qty FROM lineitem GROUP BY l_suppkey),
i AS (SELECT 's' || s_suppkey AS competitor_id, 'o' || (s_nationkey % 5) AS organization_id, s_suppkey AS k, coalesce(n, 0) AS n, coalesce(parts, 0) AS parts, coalesce(disc, 0) AS disc, coalesce(ret, 0) AS ret, coalesce(firsts, 0) AS firsts, coalesce(qty, 0) * 30 AS wordcount FROM supplier LEFT JOIN s ON s_suppkey = l_suppkey),
f AS (SELECT competitor_id, organization_id, k, n % 9 AS pc, least(disc % 9, n % 9) AS pd, parts % 30 AS fc, (parts % 30) / 4.0::DOUBLE AS fpp, ret % 6 AS plans, least(firsts % 6, ret % 6) AS pub, (k % 2 = 0)::INT::DOUBLE AS e2, (k % 3 = 0)::INT::DOUBLE AS e3, k % 4 = 0 AS page, disc % 5 AS vp, ret % 4 AS aud, k % 5 = 0 AS stmt, n % 12 AS pages, least(disc % 3, n % 12) AS mt, least(ret % 3, n % 12) AS mm, least(firsts % 3, n % 12) AS mh,
  parts % 5 AS sd, wordcount, (k % 7 = 0)::INT::DOUBLE AS blog, firsts % 6 AS ch, disc % 4 AS soc, ret % 3 AS cs, n % 5 AS cta, parts % 7 AS og, n % 40 AS ext, ret % 8 AS rev, CASE WHEN k % 3 <> 0 THEN (k % 9 - 4) / 4.0::DOUBLE END AS sent, CASE WHEN k % 4 <> 0 THEN (k % 10) / 10.0::DOUBLE END AS ai FROM i),
v AS (SELECT competitor_id, organization_id, k, pages, ai,
  CASE WHEN pc > 0 THEN round_even(greatest(least(0.5::DOUBLE * sc(pc, 8) + 0.25::DOUBLE * (pd::DOUBLE / pc * 100) + 0.25::DOUBLE * sc(fpp, 6), 100), 0), 1) END AS product,
  CASE WHEN page OR plans > 0 THEN round_even(greatest(least(0.45::DOUBLE * CASE WHEN plans > 0 THEN pub::DOUBLE / plans * 100 ELSE 0 END + 0.35::DOUBLE * sc(plans, 4) + 0.2::DOUBLE * least(60 * e2 + 40 * e3, 100), 100), 0), 1) END AS pricing,
  CASE WHEN fc > 0 THEN round_even(sc(fc, 25), 1) END AS features,
  CASE WHEN vp > 0 OR aud > 0 OR stmt THEN round_even(greatest(least(0.4::DOUBLE * sc(vp, 4) + 0.3::DOUBLE * sc(aud, 3) + 30 * stmt::INT::DOUBLE, 100), 0), 1) END AS positioning,
  CASE WHEN pages > 0 THEN round_even(greatest(least(0.25::DOUBLE * ((pages - mt)::DOUBLE / pages * 100) + 0.2::DOUBLE * ((pages - mm)::DOUBLE / pages * 100) + 0.15::DOUBLE * ((pages - mh)::DOUBLE / pages * 100) + 0.2::DOUBLE * (40 * e2 + 20 * e3 + least(40, 13 * sd)) + 0.2::DOUBLE * (0.5::DOUBLE * sc(wordcount, 900) + 50 * blog), 100), 0), 1) END AS seo,
  CASE WHEN ch + soc + cs + cta > 0 THEN round_even(greatest(least(0.25::DOUBLE * sc(ch, 5) + 0.2::DOUBLE * sc(soc, 4) + 0.2::DOUBLE * sc(cs, 3) + 0.2::DOUBLE * sc(cta, 5) + 15 * blog, 100), 0), 1) END AS marketing,
  CASE WHEN pages > 0 THEN round_even(greatest(least(0.35::DOUBLE * sc(og, 6) + 20 * e2 + 0.25::DOUBLE * sc(ext, 25) + 0.2::DOUBLE * sc(sd, 3), 100), 0), 1) END AS brand,
  CASE WHEN rev > 0 AND sent IS NOT NULL THEN round_even(greatest(least((sent + 1) * 50, 100), 0), 1) END AS sentiment FROM f),
dims AS (SELECT competitor_id, organization_id, k, unnest(['product', 'pricing', 'features', 'positioning', 'seo', 'marketing', 'brand', 'sentiment']) AS dimension, unnest([product, pricing, features, positioning, seo, marketing, brand, sentiment]) AS score, unnest([0.18::DOUBLE, 0.16, 0.14, 0.14, 0.12, 0.12, 0.09, 0.05]) AS weight FROM v),
a AS (SELECT competitor_id, organization_id, k, ai, pages, (coalesce(product * 0.18::DOUBLE, 0) + coalesce(pricing * 0.16::DOUBLE, 0) + coalesce(features * 0.14::DOUBLE, 0) + coalesce(positioning * 0.14::DOUBLE, 0) + coalesce(seo * 0.12::DOUBLE, 0) + coalesce(marketing * 0.12::DOUBLE, 0) + coalesce(brand * 0.09::DOUBLE, 0) + coalesce(sentiment * 0.05::DOUBLE, 0))
  / nullif((product IS NOT NULL)::INT * 0.18::DOUBLE + (pricing IS NOT NULL)::INT * 0.16::DOUBLE + (features IS NOT NULL)::INT * 0.14::DOUBLE + (positioning IS NOT NULL)::INT * 0.14::DOUBLE + (seo IS NOT NULL)::INT * 0.12::DOUBLE + (marketing IS NOT NULL)::INT * 0.12::DOUBLE + (brand IS NOT NULL)::INT * 0.09::DOUBLE + (sentiment IS NOT NULL)::INT * 0.05::DOUBLE, 0) AS mean,
  round_even(((product IS NOT NULL)::INT + (pricing IS NOT NULL)::INT + (features IS NOT NULL)::INT + (positioning IS NOT NULL)::INT + (seo IS NOT NULL)::INT + (marketing IS NOT NULL)::INT + (brand IS NOT NULL)::INT + (sentiment IS NOT NULL)::INT) / 8.0::DOUBLE, 4) AS completeness FROM v),
b AS (SELECT *, round_even(round_even(mean, 6) / 5.0::DOUBLE, 0) * 5 AS overall FROM a),
overall AS (SELECT competitor_id, organization_id, k, overall, completeness, round_even(greatest(least(coalesce(0.6::DOUBLE * completeness + 0.4::DOUBLE * ai, completeness) * CASE WHEN pages < 3 THEN 0.7::DOUBLE ELSE 1 END, 1), 0), 2) AS confidence,
  CASE WHEN overall IS NULL OR completeness < 0.5::DOUBLE THEN 'unknown' WHEN overall >= 80 THEN 'critical' WHEN overall >= 60 THEN 'high' WHEN overall >= 40 THEN 'moderate' ELSE 'low' END AS threat_level FROM b)"""


def _expand(sql: str) -> str:
    """Write the scale function out: share of the best in percent, between 0 and 100."""
    return re.sub(r"\bsc\((\w+), (\d+)\)", r"greatest(least(\1::DOUBLE / \2 * 100, 100), 0)", sql)


_IN = _expand(_IN)
_WORST = "CASE max(CASE threat_level WHEN 'unknown' THEN 1 WHEN 'low' THEN 2 WHEN 'moderate' THEN 3 WHEN 'high' THEN 4 ELSE 5 END) WHEN 1 THEN 'unknown' WHEN 2 THEN 'low' WHEN 3 THEN 'moderate' WHEN 4 THEN 'high' ELSE 'critical' END"
_WIDE = ", ".join(f"max(score) FILTER (dimension = '{k}') AS {k}" for k in WEIGHTS)

QUERIES = {f.__name__: f for f in (score_dimensions, score_overall, threat_distribution, worst_threat, market_gaps, comparison_matrix, comparison_leader, dashboard_counters, landscape_top, review_sentiment, score_report)}
ORACLE_SQL = {
    "score_dimensions": f"WITH {_IN} SELECT competitor_id, dimension, score, weight FROM dims",
    "score_overall": f"WITH {_IN} SELECT competitor_id, overall, completeness, confidence, threat_level FROM overall",
    "threat_distribution": f"WITH {_IN} SELECT threat_level, count(*) AS n FROM overall GROUP BY threat_level",
    "worst_threat": f"WITH {_IN} SELECT organization_id, {_WORST} AS worst FROM overall GROUP BY organization_id",
    "market_gaps": f"WITH {_IN} SELECT dimension, round_even(avg(score), 1) AS mean, count(*) AS n FROM dims WHERE score IS NOT NULL GROUP BY dimension HAVING count(*) >= greatest(2, (SELECT count(*) FROM f) // 2) AND avg(score) < 55 ORDER BY avg(score), dimension LIMIT 4",
    "comparison_matrix": f"WITH {_IN} SELECT competitor_id, {_WIDE}, any_value(overall) AS overall, any_value(threat_level) AS threat_level FROM dims JOIN overall USING (competitor_id) GROUP BY competitor_id",
    "comparison_leader": f"WITH {_IN}, m AS (SELECT organization_id, dimension, max(score) AS score FROM dims WHERE score IS NOT NULL GROUP BY ALL) SELECT organization_id, dimension, score, min(competitor_id) AS leader, count(*) AS tied FROM dims JOIN m USING (organization_id, dimension, score) GROUP BY ALL",
    "dashboard_counters": f"WITH {_IN} SELECT organization_id, count(*) AS competitors, count(*) FILTER (k % 2 = 0) AS active, count(*) FILTER (k % 2 <> 0) AS archived, count(overall) AS analysed, round_even(avg(overall), 1) AS mean_score FROM overall GROUP BY organization_id",
    "landscape_top": f"WITH {_IN} SELECT competitor_id, overall, completeness, confidence, threat_level FROM overall ORDER BY overall DESC NULLS LAST, competitor_id LIMIT 12",
    "review_sentiment": "SELECT source AS key, count(*) AS review_count, round_even(avg(greatest(0, least(1, quality::DOUBLE))), 4) AS rating, round_even(2 * avg(greatest(0, least(1, quality::DOUBLE))) - 1, 4) AS sentiment FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "score_report": f"WITH {_IN} SELECT competitor_id, string_agg(dimension || '=' || coalesce(printf('%.1f', score), 'Insufficient data'), ';' ORDER BY -coalesce(score, -1), dimension) AS section FROM dims GROUP BY competitor_id",
}
