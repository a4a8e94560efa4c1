"""Facts from pages, reports, histories, inboxes, and the whole batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.constants import SEVERITIES
from tidemark.operators import changes, extract, facts, reports, scoring, state
from tidemark.plans.changes import PAGE_CHANGES
from tidemark.plans.scores import ORACLE_SQL as SCORES
from tidemark.sources import tables as t


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """Observed prices made of parts, some next to a plan's name, on pages of three types."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "pricing").when((k % 3 == 1) & (F.col("p_size") > 25), "home")
    name = F.when(k % 4 == 0, "Choose Starter or PRO at").when(k % 4 == 1, "only").otherwise("")
    return t.table(spark, d, "part").select(
        F.col("p_brand").alias("competitor_id"), kind.alias("page_type"), k.alias("seq"), F.col("p_retailprice").alias("amount"), F.lit("EUR").alias("currency"), F.array(*map(F.lit, t.PERIODS))[(F.col("p_size") % 3).cast("int")].alias("period"),
        name.alias("preceding"), F.concat_ws(" ", name, F.when(k % 5 == 0, F.lit("for the team"))).alias("context"),
    )


def observed_price_gate(spark: SparkSession, d: str) -> DataFrame:
    return facts.price_gate(_prices(spark, d).withColumn("page_type", F.when(F.col("competitor_id") != "Brand#11", F.col("page_type")))).select("competitor_id", "seq", "page_type")


def plans_from_prices(spark: SparkSession, d: str) -> DataFrame:
    return facts.plans_from_prices(_prices(spark, d))


def pricing_notes(spark: SparkSession, d: str) -> DataFrame:
    """What there is to say on each brand's prices, of brands without any too."""
    rows = _prices(spark, d)
    brands = rows.select("competitor_id").distinct()
    return facts.pricing_notes(brands, rows.where(F.col("competitor_id") != "Brand#7").withColumn("preceding", F.when(F.col("competitor_id") != "Brand#9", F.col("preceding"))).withColumn("context", F.when(F.col("competitor_id") != "Brand#9", F.col("context"))))


def catalogue_from_headings(spark: SparkSession, d: str) -> DataFrame:
    pages = t.table(spark, d, "pages")
    site = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("competitor_id"))
    heads = extract.observations(pages).select("page_id", F.explode("h1").alias("text")).join(site, "page_id")
    return facts.catalogue_from_headings(heads.select("competitor_id", F.col("page_id").alias("seq"), "text"))


def site_positioning(spark: SparkSession, d: str) -> DataFrame:
    pages = t.table(spark, d, "pages")
    site = pages.select("page_id", urls.domain(F.col("url")).alias("competitor_id"))
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    per = extract.observations(pages).join(site, "page_id").groupBy("competitor_id").agg(F.min_by("title", "page_id").alias("title"), F.min_by("meta_description", "page_id").alias("description"), F.sum(words).alias("words"), F.sum(F.size("ctas")).alias("ctas"))
    return facts.positioning(per).select("competitor_id", "summary", F.array_join("strengths", ",").alias("strengths"), F.array_join("weaknesses", ",").alias("weaknesses"))


def page_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "documents").select(F.col("source").alias("competitor_id"), F.when(F.col("doc_id") % 50 == 0, "home").otherwise("other").alias("page_type"), (F.col("n_chars") % 97).cast("double").alias("score"), F.col("doc_id").cast("string").alias("url"), "text")
    return facts.page_budget(rows, 12, 6000).select("competitor_id", "url", "position", F.length("text").alias("n_chars"))


def price_history(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    rows = rows.withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return reports.price_history(rows, ["o_custkey"], "at", "o_totalprice").select("o_custkey", "o_orderkey", "step")


def score_history(spark: SparkSession, d: str) -> DataFrame:
    return reports.history(t.table(spark, d, "events"), ["user_id"], "ts", "event_id", 5).select("user_id", "event_id", "place")


def selected_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of three asked competitors, all of which must exist."""
    rows = scoring.score_overall(t.score_inputs(t.table(spark, d, "supplier"), t.table(spark, d, "lineitem")))
    return reports.selection(rows, ["s1", "s2", "s3"], "competitor_id")


def domain_admission(spark: SparkSession, d: str) -> DataFrame:
    pages = t.table(spark, d, "pages").select((F.col("page_id") % 3).alias("organization_id"), urls.domain(F.col("url")).alias("domain"), "page_id")
    stored = pages.where("page_id % 4 = 0").select("organization_id", "domain", F.when(F.col("page_id") % 8 == 0, F.lit("2024-01-01")).alias("deleted_at"))
    return reports.admission(pages.where("page_id % 4 <> 0").select("organization_id", "domain").distinct(), stored)


def notification_inbox(spark: SparkSession, d: str) -> DataFrame:
    """Unread and read in-app notifications per user: views are notifications, clicks 100 later read them."""
    e = t.table(spark, d, "events")
    sent = e.select(F.col("event_id").alias("notification_id"), "user_id", F.when(F.col("event_type").isin("view", "signup"), "in_app").otherwise("email").alias("channel"))
    reads = e.where("event_type = 'click'").select((F.col("event_id") - 100).alias("notification_id"), "ts")
    return reports.inbox(sent, reads).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("read_at").isNull()).alias("unread"))


def product_profiles(spark: SparkSession, d: str) -> DataFrame:
    part = t.table(spark, d, "part")
    names = part.select(F.col("p_brand").alias("competitor_id"), F.col("p_name").alias("name")).distinct()
    return reports.profiles(names.select("competitor_id").distinct(), names).select("competitor_id", F.array_join("products", ",").alias("products"))


def weekly_report(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "events").select("ts", F.col("user_id").alias("competitor_id"), F.array(*map(F.lit, SEVERITIES))[(F.col("event_id") % 3).cast("int")].alias("severity"))
    return reports.period_report(rows, "ts", t.as_of(), 7)


def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    """The whole batch for all sites: page states compared, unchanged sites set aside, changes found and counted."""
    pages = t.table(spark, d, "pages")
    old, new = t.page_states(pages, False), t.page_states(pages, True)
    before = state.fingerprint(old, ["competitor_id"]).withColumnRenamed("fingerprint", "was")
    fresh = state.fingerprint(new, ["competitor_id"]).join(before, "competitor_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("was"))).select("competitor_id")
    found = changes.after_baseline(changes.page_diff(old, new), before).join(fresh, "competitor_id", "left_semi")
    return changes.count_by(found, "change_type", "severity")


_P = """p AS (SELECT p_brand AS competitor_id, p_partkey AS seq, p_retailprice AS amount, (['monthly', 'yearly', 'one_time'])[p_size % 3 + 1] AS period, CASE WHEN p_partkey % 3 = 0 THEN 'pricing' WHEN p_partkey % 3 = 1 AND p_size > 25 THEN 'home' END AS page_type,
  CASE WHEN p_partkey % 4 = 0 THEN 'Pro' WHEN p_partkey % 5 = 0 THEN 'Team' END AS name FROM part)"""
QUERIES = {
    f.__name__: f
    for f in (observed_price_gate, plans_from_prices, pricing_notes, catalogue_from_headings, site_positioning, page_budget, price_history, score_history, selected_scores, domain_admission, notification_inbox, product_profiles, weekly_report, batch_summary)
}
_DOM = r"regexp_replace(rtrim(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '.'), '^www\.', '')"


ORACLE_SQL = {
    "observed_price_gate": f"WITH {_P}, q AS (SELECT competitor_id, seq, CASE WHEN competitor_id <> 'Brand#11' THEN page_type END AS page_type FROM p), h AS (SELECT DISTINCT competitor_id FROM q WHERE page_type = 'pricing'), g AS (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY seq) AS k FROM q WHERE page_type = 'pricing' OR competitor_id NOT IN (SELECT * FROM h)) SELECT competitor_id, seq, page_type FROM g WHERE k <= 60",
    "plans_from_prices": f"WITH {_P}, a AS (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY seq) AS k FROM p WHERE page_type IS NULL OR page_type = 'pricing'), b AS (SELECT *, row_number() OVER (PARTITION BY competitor_id, name, period ORDER BY seq) AS m FROM a WHERE k <= 12 AND name IS NOT NULL) SELECT competitor_id, name, amount, 'EUR' AS currency, period, 'observed' AS source FROM b WHERE m = 1",
    "pricing_notes": f"""WITH {_P}, z AS (SELECT competitor_id, seq, page_type, CASE WHEN competitor_id <> 'Brand#9' THEN name END AS name FROM p WHERE competitor_id <> 'Brand#7'), o AS (SELECT competitor_id, count(*) AS observed FROM z GROUP BY 1),
c AS (SELECT *, row_number() OVER (PARTITION BY competitor_id ORDER BY seq) AS k FROM z WHERE page_type IS NULL OR page_type = 'pricing'), m AS (SELECT competitor_id, count(DISTINCT name) AS named, count(*) FILTER (name IS NULL) AS unnamed FROM c WHERE k <= 12 GROUP BY 1),
a AS (SELECT competitor_id, coalesce(observed, 0) AS observed, coalesce(named, 0) AS named, coalesce(unnamed, 0) AS unnamed FROM (SELECT DISTINCT competitor_id FROM p) LEFT JOIN o USING (competitor_id) LEFT JOIN m USING (competitor_id))
SELECT competitor_id, observed, named, CASE WHEN named > 0 THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS confidence, CASE WHEN named > 0 AND unnamed = 0 THEN NULL WHEN observed = 0 THEN 'No prices were found on the crawled pages.' WHEN named = 0 THEN observed || ' price(s) were found on this site, but none of them sits next to a recognisable plan name. That usually means the prices belong to products rather than to subscription tiers. Configure an AI provider to interpret them.' ELSE unnamed || ' further price(s) were found that could not be matched to a named plan.' END AS note FROM a""",
    "page_budget": "SELECT source AS competitor_id, CAST(doc_id AS VARCHAR) AS url, k AS position, least(length(text), 6000) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (doc_id % 50 <> 0)::INT, n_chars % 97 DESC, CAST(doc_id AS VARCHAR)) AS k FROM documents) WHERE k <= 12",
    "price_history": "SELECT o_custkey, o_orderkey, round_even(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS step FROM orders",
    "score_history": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id DESC) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 5",
    "selected_scores": SCORES["score_overall"] + " WHERE competitor_id IN ('s1', 's2', 's3')",
    "domain_admission": f"WITH p AS (SELECT page_id, page_id % 3 AS organization_id, {_DOM} AS domain FROM pages), k AS (SELECT organization_id, domain, bool_or(page_id % 8 <> 0) AS live FROM p WHERE page_id % 4 = 0 GROUP BY ALL) SELECT DISTINCT organization_id, domain, CASE WHEN live IS NULL THEN 'insert' WHEN live THEN 'conflict' ELSE 'restore' END AS action FROM p LEFT JOIN k USING (organization_id, domain) WHERE page_id % 4 <> 0",
    "notification_inbox": "SELECT user_id, count(*) AS n, count(*) FILTER (event_id NOT IN (SELECT event_id - 100 FROM events WHERE event_type = 'click')) AS unread FROM events WHERE event_type IN ('view', 'signup') GROUP BY user_id",
    "product_profiles": "SELECT p_brand AS competitor_id, string_agg(p_name, ',' ORDER BY p_name) AS products FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS k FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE k <= 5 GROUP BY p_brand",
    "weekly_report": "SELECT (['low', 'medium', 'high'])[event_id % 3 + 1] AS severity, count(*) AS n, count(DISTINCT user_id) AS competitors FROM events WHERE ts >= TIMESTAMP '2024-01-13' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1",
    "batch_summary": f"WITH {PAGE_CHANGES}, w AS (SELECT competitor_id, string_agg(url || h, '' ORDER BY url) AS f FROM po GROUP BY 1), n AS (SELECT competitor_id, string_agg(url || h, '' ORDER BY url) AS f FROM pn GROUP BY 1) SELECT change_type, severity, count(*) AS n FROM page_changes WHERE competitor_id IN (SELECT w.competitor_id FROM w JOIN n ON w.competitor_id = n.competitor_id AND w.f <> n.f) GROUP BY ALL",
}
