"""Reports as documents: typed sections as JSON, one document per competitor or organisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.constants import WEIGHTS
from tidemark.operators.inputs import plan_text


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _section(kind: str, title: str, body: Column) -> Column:
    """A section as JSON; its body is JSON already."""
    return F.concat(F.lit(f'{{"type":"{kind}","title":"{title}","body":'), body, F.lit("}"))


def _bounded(df: DataFrame, key: str, order: list[Column], value: Column, most: int, name: str) -> DataFrame:
    """``key, name``: the first ``most`` values of each key in order, as a list bounded before it is collected."""
    rows = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_n") <= most)
    rows = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", value.alias("v")))).alias("l"))
    return rows.select(key, F.transform("l", lambda x: x["v"]).alias(name))


def competitor_overview(competitors: DataFrame, scores: DataFrame, products: DataFrame, plans: DataFrame, changes: DataFrame, begin: Column, most: int = 40) -> DataFrame:
    """``competitor_id, document``: figures, products, prices, score breakdown and newest changes of every competitor.

    ``scores`` has the latest row of each; ``plans(competitor_id, name, amount, currency, billing_period, is_custom_pricing)``;
    ``changes(competitor_id, change_id, title, severity, detected_at)`` since ``begin``.  Empty sections are left out.
    """
    key = "competitor_id"
    goods = _bounded(products, key, [F.col("name")], F.col("name"), most, "goods")
    text = plan_text(F.col("name"), F.col("amount"), F.col("currency"), F.col("billing_period"), F.col("is_custom_pricing"))
    prices = _bounded(plans, key, [F.col("amount").asc_nulls_last(), F.col("name"), F.col("billing_period")], text, most, "prices")
    told = F.struct(F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "severity", "title")
    news = _bounded(changes.where(F.col("detected_at") >= begin), key, [F.col("detected_at").desc(), F.col("change_id")], told, most, "news")
    rows = competitors.join(scores, key, "left").join(goods, key, "left").join(prices, key, "left").join(news, key, "left")
    figures = _json(F.struct(F.col("overall").cast("int").alias("overall"), F.coalesce("threat_level", F.lit("unknown")).alias("threat_level"), F.bround(F.col("confidence") * 100, 0).cast("int").alias("confidence")))
    # Measured dimensions first, best score first, then by name.
    dims = F.array(*[F.struct(F.col(k).isNull().alias("none"), (-F.col(k)).alias("order"), F.lit(k).alias("dimension"), F.coalesce(F.bround(F.col(k), 0).cast("int").cast("string"), F.lit("Insufficient data")).alias("score")) for k in WEIGHTS])
    breakdown = F.transform(F.array_sort(dims), lambda x: F.struct(x["dimension"], x["score"]))
    sections = F.array_compact(F.array(
        _section("metrics", "At a glance", figures), F.when(F.col("goods").isNotNull(), _section("table", "Products", _json(F.col("goods")))), F.when(F.col("prices").isNotNull(), _section("table", "Pricing", _json(F.col("prices")))),
        F.when(F.col("threat_level").isNotNull(), _section("table", "Score breakdown", _json(breakdown))), F.when(F.col("news").isNotNull(), _section("timeline", "Changes", _json(F.col("news")))),
    ))
    return rows.select(key, F.concat(F.lit('{"kind":"competitor_overview","sections":['), F.array_join(sections, ","), F.lit("]}")).alias("document"))


def comparison_report(scores: DataFrame) -> DataFrame:
    """One ``document``: a table with a row per dimension and a column per competitor of ``scores``, the few that were asked for.

    ``scores`` has rows of :func:`tidemark.operators.scoring.scored`; values are rounded, unknown ones ``Insufficient data``.
    """
    names = [*WEIGHTS, "overall"]
    text = lambda c: F.coalesce(F.bround(c, 0).cast("int").cast("string"), F.lit("Insufficient data"))
    each = F.array(*[F.struct(F.lit(k).alias("n"), F.lit(dim.capitalize()).alias("dimension"), text(F.col(dim)).alias("text")) for k, dim in enumerate(names)])
    cells = scores.select("competitor_id", F.inline(each)).groupBy("n", "dimension").agg(F.array_sort(F.collect_list(F.struct("competitor_id", "text"))).alias("l"))
    rows = cells.agg(F.array_sort(F.collect_list(F.struct("n", F.concat(F.array("dimension"), F.col("l.text")).alias("row")))).alias("rows"), F.max("l.competitor_id").alias("who"))
    body = F.concat(F.lit('{"columns":'), _json(F.concat(F.array(F.lit("Dimension")), "who")), F.lit(',"rows":'), _json(F.col("rows.row")), F.lit("}"))
    return rows.select(F.concat(F.lit('{"kind":"comparison","sections":['), _section("table", "Score comparison", body), F.lit("]}")).alias("document"))


def intelligence_report(competitors: DataFrame, changes: DataFrame, begin: Column, most: int = 100) -> DataFrame:
    """``organization_id, document``: each organisation's active competitors, changes since ``begin`` by severity, and the newest ``most`` of them.

    ``changes`` has the competitor's ``name``.  Without changes the document says so.
    """
    key = "organization_id"
    rows = changes.where(F.col("detected_at") >= begin)
    counts = rows.groupBy(key).agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("severity") == "medium").alias("medium"))
    told = F.struct(F.date_format("detected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "title", "severity", F.col("name").alias("competitor"))
    news = _bounded(rows, key, [F.col("detected_at").desc(), F.col("change_id")], told, most, "news")
    active = competitors.groupBy(key).agg(F.count_if(F.col("status") == "active").alias("tracked"))
    both = active.join(counts, key, "left").join(news, key, "left").na.fill(0, ["high", "medium"])
    figures = _json(F.struct("tracked", F.coalesce(F.size("news"), F.lit(0)).alias("changes"), "high", "medium"))
    nothing = _section("text", "What changed", F.lit('"No changes were detected in this period."'))
    events = F.when(F.col("news").isNull(), nothing).otherwise(_section("timeline", "What changed", _json(F.col("news"))))
    return both.select(key, F.concat(F.lit('{"kind":"intelligence","sections":['), _section("metrics", "Activity in this period", figures), F.lit(","), events, F.lit("]}")).alias("document"))


def store(documents: DataFrame, path: str) -> None:
    """Append documents as JSON lines, a row each."""
    documents.write.mode("append").json(path)


def detail(competitors: DataFrame, analyses: DataFrame, scores: DataFrame, plans: DataFrame, products: DataFrame, pages: DataFrame, most: int = 50) -> DataFrame:
    """Everything on each competitor in one row: latest analysis and score, plans by amount, products by name, pages by value.

    Lists are bounded before they are collected; a competitor that lacks something has a null there.
    """
    key = "competitor_id"
    new = analyses.groupBy(key).agg(F.max_by(F.struct("analysis_id", "created_at", "confidence"), F.struct("created_at", "analysis_id")).alias("latest_analysis"))
    a = _bounded(plans, key, [F.col("amount").asc_nulls_last(), F.col("name")], F.struct("name", "amount"), most, "pricing_plans")
    b = _bounded(products, key, [F.col("name")], F.col("name"), most, "products")
    c = _bounded(pages, key, [F.col("score").desc(), F.col("url")], F.struct("url", "score"), most, "pages")
    rows = competitors
    for part in (new, scores, a, b, c):
        rows = rows.join(part, key, "left")
    return rows


def rationale(dims: DataFrame) -> DataFrame:
    """``competitor_id, dimension, rationale, inputs`` of the scored features: what each dimension's score rests on, as text and map."""
    n = lambda c: F.col(c).cast("string")
    of = {
        "product": (("product_count", "products_with_description", "features_per_product"), F.concat(n("product_count"), F.lit(" product(s) found, "), n("products_with_description"), F.lit(" with a description."))),
        "pricing": (("pricing_plan_count", "plans_with_public_amount", "has_free_tier", "has_custom_pricing"), F.concat(n("plans_with_public_amount"), F.lit(" of "), n("pricing_plan_count"), F.lit(" plan(s) show a price."))),
        "features": (("feature_count",), F.concat(n("feature_count"), F.lit(" feature(s) found."))),
        "positioning": (("value_proposition_count", "target_audience_count", "has_positioning_statement"), F.concat(n("value_proposition_count"), F.lit(" value proposition(s), "), n("target_audience_count"), F.lit(" audience(s)."))),
        "seo": (
            ("pages_crawled", "pages_missing_title", "pages_missing_meta_description", "pages_missing_h1", "has_sitemap", "has_blog"),
            F.concat(F.lit("Pages read: "), n("pages_crawled"), F.lit("; "), F.coalesce(F.nullif(F.concat_ws(
                ", ", *[F.when(F.col(c) > 0, F.concat(n(c), F.lit(t))) for c, t in (("pages_missing_title", " without a title"), ("pages_missing_meta_description", " without a meta description"), ("pages_missing_h1", " without an H1"))]
            ), F.lit("")), F.lit("nothing missing")), F.when(F.col("has_sitemap"), "; sitemap found").otherwise("; no sitemap"), F.when(F.col("has_blog"), "; blog present.").otherwise(".")),
        ),
        "marketing": (("marketing_channel_count", "social_profile_count", "case_study_pages", "cta_count"), F.concat(n("marketing_channel_count"), F.lit(" channel(s), "), n("social_profile_count"), F.lit(" social profile(s), "), n("cta_count"), F.lit(" call(s) to action."))),
        "brand": (("open_graph_tag_count", "external_link_count", "has_favicon"), F.concat(n("open_graph_tag_count"), F.lit(" Open Graph tag(s), "), n("external_link_count"), F.lit(" external link(s)."))),
        "sentiment": (("review_count", "sentiment_score"), F.concat(n("review_count"), F.lit(" review(s)."))),
    }
    each = F.array(*[F.struct(F.lit(k).alias("dimension"), text.alias("rationale"), F.create_map(*[x for c in cols for x in (F.lit(c), n(c))]).alias("inputs")) for k, (cols, text) in of.items()])
    return dims.select("competitor_id", F.inline(each))


def chart_rows(dims: DataFrame) -> DataFrame:
    """``dims(competitor_id, dimension, score)`` for plotting: dimensions that no competitor has a score of go, other nulls become 0."""
    some = dims.where("score is not null").select("dimension").distinct()
    return dims.join(some, "dimension", "left_semi").withColumn("score", F.coalesce("score", F.lit(0.0)))


def titles(insights: Column, most: int = 5) -> Column:
    """The titles of a list of insights ``array<struct<title, ...>>``, empty ones left out."""
    return F.slice(F.filter(F.transform(insights, lambda x: x["title"]), lambda t: F.coalesce(t, F.lit("")) != ""), 1, most)
