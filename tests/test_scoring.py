from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions.constants import WEIGHTS
from tidemark.operators import scoring

INTS = (
    "product_count products_with_description feature_count pricing_plan_count plans_with_public_amount value_proposition_count target_audience_count pages_crawled pages_missing_title pages_missing_meta_description "
    "pages_missing_h1 structured_data_type_count marketing_channel_count social_profile_count case_study_pages cta_count open_graph_tag_count external_link_count review_count"
).split()
DOUBLES = "features_per_product ai_confidence avg_word_count sentiment_score".split()
FLAGS = "has_free_tier has_custom_pricing pricing_page_found has_positioning_statement has_sitemap has_robots_txt has_blog has_favicon".split()


def row(spark, **given):
    values = {c: 0 for c in INTS} | {c: None if c in ("ai_confidence", "sentiment_score") else 0.0 for c in DOUBLES} | {c: False for c in FLAGS} | given
    schema = "competitor_id string, " + ", ".join([f"{c} int" for c in INTS] + [f"{c} double" for c in DOUBLES] + [f"{c} boolean" for c in FLAGS])
    return spark.createDataFrame([("c", *[values[c] for c in INTS + DOUBLES + FLAGS])], schema)


def test_nothing_known_is_null(spark):
    r = scoring.score_overall(row(spark)).first()
    assert r["overall"] is None and r["threat_level"] == "unknown" and r["completeness"] == 0


def test_few_dimensions_are_renormalised(spark):
    r = scoring.score_overall(row(spark, pages_crawled=2, product_count=3, products_with_description=3, features_per_product=4.0)).first()
    assert r["overall"] > 20 and r["overall"] % 5 == 0 and r["completeness"] < 0.5 and r["threat_level"] == "unknown"


@pytest.mark.parametrize("overall, completeness, level", [(85.0, 1.0, "critical"), (65.0, 1.0, "high"), (45.0, 1.0, "moderate"), (20.0, 1.0, "low"), (90.0, 0.3, "unknown"), (None, 1.0, "unknown")])
def test_threat(spark, overall, completeness, level):
    df = spark.createDataFrame([(overall, completeness)], "o double, c double")
    assert df.select(scoring.threat_level(F.col("o"), F.col("c")).alias("t")).first()["t"] == level


def test_weights_and_dimensions(spark):
    assert abs(sum(WEIGHTS.values()) - 1) < 1e-9
    dims = scoring.score_dimensions(row(spark, review_count=2, sentiment_score=0.5))
    assert dims.count() == 8 and {r["dimension"]: r["score"] for r in dims.collect()}["sentiment"] == 75.0
    assert scoring.worst_threat(spark.createDataFrame([], "threat_level string")).first()["worst"] == "unknown"
