"""Change detection, alert matching and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import rank_of
from tidemark.operators import alerts, changes, state
from tidemark.sources import tables as t


def plan_diff(spark: SparkSession, d: str) -> DataFrame:
    part = t.table(spark, d, "part")
    return changes.plan_diff(t.plans(part, False), t.plans(part, True))


def plan_diff_by_severity(spark: SparkSession, d: str) -> DataFrame:
    return changes.count_by(plan_diff(spark, d), "change_type", "severity")


def product_set_diff(spark: SparkSession, d: str) -> DataFrame:
    part = t.table(spark, d, "part")
    return changes.set_diff(t.products(part, False), t.products(part, True), "product", "high")


def feature_set_diff(spark: SparkSession, d: str) -> DataFrame:
    part = t.table(spark, d, "part")
    return changes.set_diff(t.products(part, True), t.products(part, False), "feature", "medium")


def page_diff(spark: SparkSession, d: str) -> DataFrame:
    pages = t.table(spark, d, "pages")
    return changes.page_diff(t.page_states(pages, False), t.page_states(pages, True))


def positioning_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = t.table(spark, d, "documents")
    old = docs.select(F.col("doc_id").cast("string").alias("competitor_id"), F.col("text").alias("positioning"))
    new = docs.select((F.col("doc_id") - 1).cast("string").alias("competitor_id"), F.concat_ws(" ", F.col("text"), F.lit("new words")).alias("positioning"))
    new = new.unionByName(docs.where("doc_id % 10 = 0").select((-F.col("doc_id") - 10).cast("string").alias("competitor_id"), F.col("text").alias("positioning")))
    return changes.positioning_diff(old, new).drop("before", "after")


def _all(spark: SparkSession, d: str) -> DataFrame:
    return changes.all_changes(plan_diff(spark, d), product_set_diff(spark, d), page_diff(spark, d))


def change_feed(spark: SparkSession, d: str) -> DataFrame:
    """All changes of competitors with an earlier analysis, in each competitor's order."""
    known = t.table(spark, d, "part").where("p_partkey % 3 = 0").select(F.col("p_brand").alias("competitor_id"))
    rows = changes.after_baseline(_all(spark, d), known)
    return rows.select("competitor_id", "change_type", "severity", "entity_key", "position")


def change_feed_page(spark: SparkSession, d: str) -> DataFrame:
    rows = change_feed(spark, d).where(rank_of(F.col("severity")) >= 1)
    return state.page(rows, [rank_of(F.col("severity")).desc(), F.col("competitor_id"), F.col("entity_key"), F.col("change_type")], 25, 50).drop("position")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules from customers: an organisation per nation, some for one brand, with types, severities and channels."""
    k = F.col("c_custkey")
    types = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.lit("price_increased"), F.lit("price_decreased"))).otherwise(F.array(F.lit("plan_added"), F.lit("bogus")))
    channels = F.when(k % 4 == 0, F.array(F.lit("email"), F.lit("webhook"))).when(k % 4 == 1, F.array(F.lit("pigeon"))).otherwise(F.array(F.lit("in_app"), F.lit("email")))
    rows = t.table(spark, d, "customer").where("c_custkey % 5 = 0").select(
        k.alias("rule_id"), F.col("c_nationkey").alias("organization_id"), F.when(k % 2 == 0, F.concat(F.lit("Brand#"), (k % 5 + 1).cast("string"), (k % 3 + 1).cast("string"))).alias("competitor_id"), (k % 7 != 0).alias("is_active"),
        types.alias("change_types"), F.array(F.lit("low"), F.lit("medium"), F.lit("high"))[(k % 3).cast("int")].alias("min_severity"), channels.alias("channels"), F.when(k % 8 == 0, F.lit("https://hook.example.org")).alias("webhook_url"),
    )
    return alerts.clean_rules(rows, ["price_increased", "price_decreased", "plan_added", "plan_removed"], ["in_app", "email", "webhook"])


def _changes(spark: SparkSession, d: str) -> DataFrame:
    rows = plan_diff(spark, d)
    org = F.substring_index("competitor_id", "#", -1).try_cast("int") % 25
    return rows.select(F.concat_ws("~", "competitor_id", "entity_key").alias("change_id"), org.alias("organization_id"), "competitor_id", "change_type", "severity")


def rule_cleaning(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).select("rule_id", F.array_join("change_types", ",").alias("change_types"), F.array_join("channels", ",").alias("channels"), "violation")


def rule_match_fanout(spark: SparkSession, d: str) -> DataFrame:
    rules = _rules(spark, d).where("violation is null")
    return alerts.notifications(alerts.match(_changes(spark, d), rules)).select("change_id", "rule_id", "organization_id", "channel", "status", "attempts")


def member_recipients(spark: SparkSession, d: str) -> DataFrame:
    customers = t.table(spark, d, "customer")
    users = customers.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_custkey") % 6 != 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@mail.example"))).alias("email"))
    members = t.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("organization_id"))
    return alerts.recipients(users, members)


_NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_FMT = r"CASE WHEN {0}.amount IS NULL THEN 'custom pricing' ELSE {0}.currency || ' ' || regexp_replace(CAST(CAST(floor({0}.amount * 100 + 0.5::DOUBLE) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(CAST(floor({0}.amount * 100 + 0.5::DOUBLE) AS BIGINT) % 100 AS VARCHAR), 2, '0'), '\.?0+$', '') END"


def _plan_state(alias: str, new: bool) -> str:
    amount = "p_retailprice * (1.0::DOUBLE + ((p_partkey % 7) - 3) * 0.05::DOUBLE)" if new else "p_retailprice"
    return f"""{alias} AS (SELECT * FROM (SELECT p_brand AS competitor_id, {_NORM.format('p_name')} || '|' || (['monthly','yearly','one_time'])[p_size % 3 + 1] AS key, p_name AS name,
  CASE WHEN p_partkey % {19 if new else 23} <> 0 THEN {amount} END AS amount, 'EUR' AS currency,
  row_number() OVER (PARTITION BY p_brand, {_NORM.format('p_name')}, p_size % 3 ORDER BY p_partkey DESC) AS rn FROM part WHERE p_partkey % {13 if new else 17} <> 0) WHERE rn = 1)"""


_PLANS = f"""{_plan_state('o', False)}, {_plan_state('n', True)},
j AS (SELECT coalesce(o.competitor_id, n.competitor_id) AS competitor_id, coalesce(o.key, n.key) AS entity_key, o.key IS NULL AS is_new, n.key IS NULL AS is_gone, o.name AS oname, n.name AS nname, o.amount AS a, n.amount AS b,
  CASE WHEN o.key IS NOT NULL THEN {_FMT.format('o')} END AS before, CASE WHEN n.key IS NOT NULL THEN {_FMT.format('n')} END AS after, abs(n.amount - o.amount) / nullif(o.amount, 0) AS ratio
  FROM o FULL OUTER JOIN n ON o.competitor_id = n.competitor_id AND o.key = n.key),
plan_changes AS (SELECT * FROM (SELECT competitor_id, CASE WHEN is_new THEN 'plan_added' WHEN is_gone THEN 'plan_removed' WHEN a IS NULL AND b IS NOT NULL THEN 'price_decreased' WHEN a IS NOT NULL AND b IS NULL THEN 'price_increased'
    WHEN ratio >= 0.01::DOUBLE THEN CASE WHEN b > a THEN 'price_increased' ELSE 'price_decreased' END END AS change_type,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN ratio >= 0.2::DOUBLE THEN 'high' WHEN ratio >= 0.05::DOUBLE THEN 'medium' ELSE 'low' END ELSE 'medium' END AS severity, entity_key,
  CASE WHEN is_new OR is_gone THEN competitor_id || ': ' || coalesce(nname, oname) ELSE competitor_id || ': ' || nname || ' ' || before || ' to ' || after END AS title, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round_even(ratio, 4) END AS magnitude, before, after FROM j) WHERE change_type IS NOT NULL)"""


def _set_sql(old: int, new: int, noun: str, severity: str, cap: int) -> str:
    side = lambda m: f"SELECT * FROM (SELECT p_brand AS competitor_id, {_NORM.format('name')} AS entity_key, name, row_number() OVER (PARTITION BY p_brand, {_NORM.format('name')} ORDER BY p_partkey DESC) AS rn FROM (SELECT *, p_name || ' ' || p_type AS name FROM part WHERE p_partkey % {m} <> 0)) WHERE rn = 1"
    return f"""so AS ({side(old)}), sn AS ({side(new)}),
set_changes AS (SELECT competitor_id, change_type, severity, entity_key, competitor_id || ': ' || name AS title, CAST(NULL AS DOUBLE) AS magnitude, CASE WHEN change_type = '{noun}_removed' THEN name END AS before, CASE WHEN change_type = '{noun}_added' THEN name END AS after FROM (
  SELECT *, row_number() OVER (PARTITION BY competitor_id, change_type ORDER BY name, entity_key) AS k FROM (
    SELECT competitor_id, entity_key, name, '{noun}_added' AS change_type, '{severity}' AS severity FROM sn ANTI JOIN so USING (competitor_id, entity_key)
    UNION ALL SELECT competitor_id, entity_key, name, '{noun}_removed', 'low' FROM so ANTI JOIN sn USING (competitor_id, entity_key))) WHERE k <= {cap})"""


PAGE_CHANGES = """po AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS competitor_id, url || '#' || page_id AS url, sha256(html) AS h FROM pages WHERE page_id % 8 <> 0),
pn AS (SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS competitor_id, url || '#' || page_id AS url, sha256(CASE WHEN page_id % 5 = 0 THEN html || '!' ELSE html END) AS h FROM pages WHERE page_id % 7 <> 0),
pj AS (SELECT *, row_number() OVER (PARTITION BY competitor_id, change_type ORDER BY url) AS k FROM (SELECT coalesce(po.competitor_id, pn.competitor_id) AS competitor_id, coalesce(po.url, pn.url) AS url,
  CASE WHEN po.url IS NULL THEN 'page_added' WHEN pn.url IS NULL THEN 'page_removed' WHEN po.h <> pn.h THEN 'content_changed' END AS change_type FROM po FULL OUTER JOIN pn ON po.competitor_id = pn.competitor_id AND po.url = pn.url) WHERE change_type IS NOT NULL),
page_changes AS (SELECT competitor_id, change_type, 'low' AS severity, url AS entity_key, competitor_id || ': ' || url AS title, CAST(NULL AS DOUBLE) AS magnitude, CASE WHEN change_type = 'page_removed' THEN url END AS before, CASE WHEN change_type = 'page_added' THEN url END AS after FROM pj WHERE change_type <> 'content_changed' AND k <= 8
  UNION ALL SELECT competitor_id, 'content_changed', CASE WHEN count(*) < 3 THEN 'low' ELSE 'medium' END, 'pages', competitor_id || ': ' || count(*) || ' pages changed', count(*)::DOUBLE, NULL, string_agg(CASE WHEN k <= 20 THEN url END, ',' ORDER BY url) FROM pj WHERE change_type = 'content_changed' GROUP BY competitor_id)"""

_RANK = "(CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END)"
_FEED = f"""{_PLANS}, {_set_sql(10, 11, 'product', 'high', 10)}, {PAGE_CHANGES},
feed AS (SELECT competitor_id, change_type, severity, entity_key, row_number() OVER (PARTITION BY competitor_id ORDER BY {_RANK} DESC, stage, change_type, entity_key) AS position FROM (
  SELECT 0 AS stage, * FROM plan_changes UNION ALL SELECT 1, * FROM set_changes UNION ALL SELECT 2, * FROM page_changes) WHERE competitor_id IN (SELECT p_brand FROM part WHERE p_partkey % 3 = 0))"""
_RULES = """r0 AS (SELECT c_custkey AS rule_id, c_nationkey AS organization_id, CASE WHEN c_custkey % 2 = 0 THEN 'Brand#' || (c_custkey % 5 + 1) || (c_custkey % 3 + 1) END AS rule_competitor, c_custkey % 7 <> 0 AS is_active,
  CASE c_custkey % 3 WHEN 0 THEN [] WHEN 1 THEN ['price_increased', 'price_decreased'] ELSE ['plan_added'] END AS change_types, (['low', 'medium', 'high'])[c_custkey % 3 + 1] AS min_severity,
  CASE c_custkey % 4 WHEN 0 THEN ['email', 'webhook'] WHEN 1 THEN ['in_app'] ELSE ['in_app', 'email'] END AS channels, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 8 <> 0 THEN 'webhook_url_missing' END AS violation FROM customer WHERE c_custkey % 5 = 0)"""

QUERIES = {f.__name__: f for f in (plan_diff, plan_diff_by_severity, product_set_diff, feature_set_diff, page_diff, positioning_changes, change_feed, change_feed_page, rule_cleaning, rule_match_fanout, member_recipients)}
ORACLE_SQL = {
    "plan_diff": f"WITH {_PLANS} SELECT * FROM plan_changes",
    "plan_diff_by_severity": f"WITH {_PLANS} SELECT change_type, severity, count(*) AS n FROM plan_changes GROUP BY ALL",
    "product_set_diff": f"WITH {_set_sql(10, 11, 'product', 'high', 10)} SELECT * FROM set_changes",
    "feature_set_diff": f"WITH {_set_sql(11, 10, 'feature', 'medium', 10)} SELECT * FROM set_changes",
    "page_diff": f"WITH {PAGE_CHANGES} SELECT * FROM page_changes",
    "positioning_changes": r"""WITH b AS (SELECT doc_id - 1 AS id, text || ' new words' AS text FROM documents),
w AS (SELECT CAST(d.doc_id AS VARCHAR) AS competitor_id, list_distinct(list_filter(regexp_split_to_array(lower(d.text), '\s+'), lambda x: x <> '')) AS x, list_distinct(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda x: x <> '')) AS y FROM documents d JOIN b ON b.id = d.doc_id WHERE d.text <> ''),
j AS (SELECT competitor_id, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS j FROM w)
SELECT competitor_id, 'positioning_changed' AS change_type, CASE WHEN j < 0.5 THEN 'high' ELSE 'medium' END AS severity, 'positioning' AS entity_key, competitor_id || ': positioning changed' AS title, round_even(1 - j, 3) AS magnitude FROM j WHERE j < 0.85::DOUBLE""",
    "change_feed": f"WITH {_FEED} SELECT * FROM feed",
    "change_feed_page": f"WITH {_FEED}, f AS (SELECT * FROM feed WHERE {_RANK} >= 1) SELECT competitor_id, change_type, severity, entity_key, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 75 AS has_more FROM f ORDER BY {_RANK} DESC, competitor_id, entity_key, change_type LIMIT 25 OFFSET 50",
    "rule_cleaning": f"WITH {_RULES} SELECT rule_id, array_to_string(change_types, ',') AS change_types, array_to_string(channels, ',') AS channels, violation FROM r0",
    "rule_match_fanout": f"""WITH {_PLANS}, {_RULES}, c AS (SELECT competitor_id || '~' || entity_key AS change_id, TRY_CAST(split_part(competitor_id, '#', 2) AS INTEGER) % 25 AS organization_id, * FROM plan_changes)
SELECT change_id, rule_id, r0.organization_id, unnest(channels) AS channel, 'pending' AS status, 0 AS attempts FROM c JOIN r0 ON c.organization_id = r0.organization_id AND is_active AND violation IS NULL AND (rule_competitor IS NULL OR rule_competitor = competitor_id)
  AND (len(change_types) = 0 OR list_contains(change_types, change_type)) AND {_RANK} >= (CASE min_severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END)""",
    "member_recipients": "SELECT DISTINCT o_orderpriority AS organization_id, c_custkey AS user_id, lower(replace(c_name, '#', '.')) || '@mail.example' AS email FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 6 <> 0",
}
