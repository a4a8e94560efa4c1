"""URLs, discovery, page observations and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import prices, urls
from tidemark.functions.constants import BINARY_SUFFIXES, DEFAULT_CAP, NOISE_PATTERN, PAGE_RULES, TRACKING, TYPE_CAPS
from tidemark.operators import discovery, extract, quality
from tidemark.sources import tables as t


def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return t.table(spark, d, "pages").select("page_id", urls.normalize_url(url).alias("canonical"), urls.url_hash(url).alias("url_hash"), urls.domain(url).alias("domain"), urls.same_site(url, F.lit("example.com")).alias("same_site"))


def url_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "pages").select(urls.normalize_url(F.col("url")).alias("canonical"), "page_id")
    return rows.groupBy("canonical").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))


def url_safety(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of keys: private, public, odd ports and names."""
    k = F.col("c_custkey")
    ip = F.concat_ws(".", *[x.cast("string") for x in ((k * 7) % 256, (k * 3) % 256, (k * 5) % 256, k % 256)])
    url = F.when(k % 6 == 0, F.concat(F.lit("http://"), ip, F.lit("/x"))).when(k % 6 == 1, F.concat(F.lit("ftp://h"), k.cast("string"), F.lit(".example.com/"))).when(k % 6 == 2, F.concat(F.lit("https://u:p@h"), k.cast("string"), F.lit(".com/")))
    url = url.when(k % 6 == 3, F.concat(F.lit("https://host:"), (k % 3 * 363 + 80).cast("string"), F.lit("/"))).when(k % 6 == 4, F.concat(F.lit("http://db"), k.cast("string"), F.lit(".internal/"))).otherwise(F.concat(F.lit("https://a"), k.cast("string"), F.lit(".org/p.pdf?x=1")))
    rows = t.table(spark, d, "customer").select(k.alias("id"), url.alias("url"))
    return rows.select("id", "url", urls.safety_code(F.col("url")).alias("code"), urls.is_binary(F.col("url")).alias("binary"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Links of sites made of parts: paths from page words and names, with anchors, noise and depth."""
    k = F.col("p_partkey")
    word = F.array(*[F.lit(w) for _, _, us, _ in PAGE_RULES for w in us])
    path = F.concat(F.lit("/"), F.get(word, (k % F.size(word)).cast("int")), F.when(k % 3 == 0, F.concat(F.lit("/x"), (k % 50).cast("string"))).otherwise(""), F.when(k % 7 == 0, F.lit("/tag/a")).otherwise(""), F.when(k % 11 == 0, F.lit("/guide.pdf")).otherwise(""))
    url = F.concat(F.lit("https://www.S"), (k % 20).cast("string"), F.lit(".example.com"), F.when(k % 41 == 0, F.lit("/")).otherwise(path), F.when(k % 5 == 0, F.lit("?utm_source=x&page=2")).otherwise(F.lit("#top")))
    anchor = F.when(k % 4 == 0, F.lit("Pricing")).when(k % 4 == 1, F.lit("our story and more")).otherwise(F.lit(""))
    return t.table(spark, d, "part").select(F.concat(F.lit("s"), (k % 20).cast("string"), F.lit(".example.com")).alias("site"), url.alias("url"), anchor.alias("anchor"), k.alias("seq"))


def classify_links(spark: SparkSession, d: str) -> DataFrame:
    return discovery.classified(_links(spark, d)).select("site", "url", "page_type", "score")


def rank_links(spark: SparkSession, d: str) -> DataFrame:
    return discovery.ranked(discovery.classified(_links(spark, d)), 12).select("site", "url", "page_type", "score", "position")


def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Pages under rules that each origin's robots file has, made from suppliers."""
    k = F.col("s_suppkey")
    body = F.concat(F.lit("User-agent: *\nDisallow: /en/"), (k % 9 + 1).cast("string"), F.lit("\nAllow: /en/\n# note\nUser-agent: bad\nDisallow: /\nSitemap: https://s.example/map.xml\n"))
    hosts = t.table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("origin")).distinct()
    files = t.table(spark, d, "supplier").select((k - 1).alias("n"), body.alias("body"))
    count = files.count()
    files = hosts.withColumn("n", F.length("origin") % count).join(files, "n").select("origin", "body")
    pages = t.table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("origin"), "url")
    return discovery.allowed(pages, discovery.robots_rules(files)).select("page_id", "allowed")


def sitemap_scan(spark: SparkSession, d: str) -> DataFrame:
    """Sitemaps put together from pages' URLs, the first 500 of each site."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy("x", "page_id"))
    pages = t.table(spark, d, "pages").select(urls.domain(F.col("url")).alias("site"), F.concat(F.lit("<url><loc> "), F.regexp_extract("url", "^([^?#]*)", 1), F.when(F.col("page_id") % 9 == 0, "map.xml").when(F.col("page_id") % 9 == 1, "a.png").otherwise(""), F.lit(" </loc></url>")).alias("x"), "page_id")
    pages = pages.withColumn("_n", rank).where("_n <= 500")
    return discovery.sitemap_urls(pages.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list("x")), "").alias("xml")))


def sitemap_tree(spark: SparkSession, d: str) -> DataFrame:
    """Pages of three levels of sitemaps made of their URLs: an index, eight maps per site, one more below each, and a way back to the index."""
    rank = F.row_number().over(Window.partitionBy("site").orderBy("raw", "page_id"))
    pages = t.table(spark, d, "pages").select(urls.domain(F.col("url")).alias("site"), F.regexp_extract("url", "^([^?#]*)", 1).alias("raw"), "page_id").withColumn("_n", rank).where("_n <= 500")
    loc = lambda *x: F.concat(F.lit("<url><loc>"), *x, F.lit("</loc></url>"))
    at = lambda name, *k: F.concat(F.lit("https://"), F.col("site"), F.lit(f"/{name}"), *k, F.lit(".xml"))
    k = (F.col("page_id") % 8).cast("string")
    sites = pages.select("site").distinct()
    index = sites.select(at("sitemap").alias("url"), F.concat(*[loc(at("map", F.lit(str(i)))) for i in range(8)]).alias("xml"))
    files = pages.groupBy("site", k.alias("k"), (F.col("page_id") % 2 == 1).alias("deep")).agg(F.array_join(F.collect_list(loc(F.col("raw"))), "").alias("own"))
    odd = files.where("deep").select(at("deep", F.col("k")).alias("url"), F.concat("own", loc(at("sitemap"))).alias("xml"))
    maps = sites.select("site", F.explode(F.array(*[F.lit(str(i)) for i in range(8)])).alias("k")).join(files.where("not deep").drop("deep"), ["site", "k"], "left")
    maps = maps.select(at("map", F.col("k")).alias("url"), F.concat(F.coalesce("own", F.lit("")), loc(at("deep", F.col("k")))).alias("xml"))
    return discovery.sitemap_tree(sites.select("site", at("sitemap").alias("url")), index.unionByName(maps).unionByName(odd))


def page_observations(spark: SparkSession, d: str) -> DataFrame:
    o = extract.observations(t.table(spark, d, "pages"), ["title", "lang", "h1", "links", "open_graph", "meta_description"])
    return o.select("page_id", "title", "lang", F.element_at("h1", 1).alias("h1"), F.size("links").alias("n_links"), F.size("open_graph").alias("n_graph"), F.col("meta_description").isNull().alias("no_description"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Distinct link targets of each page as they stand, first of equal ones."""
    pages = t.table(spark, d, "pages")
    o = extract.observations(pages, ["links"]).select("page_id", F.posexplode("links").alias("seq", "l")).select("page_id", "seq", F.col("l.href").alias("href"))
    good = ~F.regexp_like("href", F.lit("(?i)^(#|mailto:|tel:|javascript:|data:)")) & (F.col("href") != "")
    return o.where(good).groupBy("page_id", "href").agg(F.min("seq").cast("long").alias("first_seq"))


def admission(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    rows = t.table(spark, d, "pages").select("page_id", "html", F.when(k % 6 == 0, 404).otherwise(200).alias("status"), F.when(k % 5 == 0, "image/png").otherwise("Text/HTML; charset=utf-8").alias("content_type"))
    return quality.admit(rows, cap=2_000_000).select("page_id", "reject_code", "truncated", F.length("html").alias("kept_chars"))


def price_extract(spark: SparkSession, d: str) -> DataFrame:
    """Prices read back from texts made of parts."""
    k = F.col("p_partkey")
    price = F.format_string("%.2f", "p_retailprice")
    text = F.concat_ws(" ", "p_name", F.when(k % 2 == 0, F.concat(F.lit("Pro EUR "), price)).otherwise(F.concat(F.lit("Team "), price, F.lit(" USD"))), F.when(k % 3 == 0, "per month").when(k % 3 == 1, "/ year, lifetime").otherwise("only"))
    rows = t.table(spark, d, "part").select(k.alias("id"), text.alias("text"))
    return rows.withColumn("period", prices.billing_period(F.col("text"))).select("id", "period", F.inline(prices.prices_in(F.col("text"))))


def parse_amounts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    whole, cents = F.floor("l_extendedprice").cast("string"), F.lpad((k % 100).cast("string"), 2, "0")
    raw = F.when(k % 5 == 0, F.concat(whole, F.lit("."), cents)).when(k % 5 == 1, F.concat(whole, F.lit(","), cents)).when(k % 5 == 2, F.concat(F.lit("1."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(","), cents))
    raw = raw.when(k % 5 == 3, F.concat((k % 90 + 1).cast("string"), F.lit(","), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(F.concat(whole, F.lit("x")))
    return t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", prices.parse_amount(raw).alias("amount"))


def enforce_prices(spark: SparkSession, d: str) -> DataFrame:
    """Claimed plan prices against observed ones: kept, currency cleared, or discarded."""
    part = t.table(spark, d, "part")
    seen = part.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("competitor_id"), F.bround("p_retailprice", 2).alias("amount"), F.when(F.col("p_partkey") % 2 == 0, "EUR").otherwise("USD").alias("currency")).distinct()
    claims = part.select(F.col("p_brand").alias("competitor_id"), F.col("p_partkey").alias("plan"), F.when(F.col("p_partkey") % 10 != 0, F.bround("p_retailprice", 2)).alias("amount"), F.lit("EUR").alias("currency"))
    both = claims.join(seen.withColumn("pair", F.lit(True)), ["competitor_id", "amount", "currency"], "left")
    both = both.join(seen.select("competitor_id", "amount").distinct().withColumn("number", F.lit(True)), ["competitor_id", "amount"], "left")
    keep = F.col("amount").isNull() | F.col("pair").isNotNull()
    note = F.when(keep, None).when(F.col("number").isNotNull(), "currency_cleared").otherwise("price_discarded")
    return both.select("plan", F.when(keep | F.col("number").isNotNull(), F.col("amount")).alias("amount"), F.when(keep, F.col("currency")).alias("currency"), (~keep & F.col("number").isNull()).alias("is_custom"), note.alias("note"))


_HOST = r"rtrim(lower(regexp_extract({0}, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)', 1)), '.')"
_PATH = r"regexp_extract({0}, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#\s]*)', 1)"
_TRACK = "[" + ", ".join(f"'{x}'" for x in TRACKING) + "]"
_CANON = rf"""lower(regexp_extract({{0}}, '^([A-Za-z]+):', 1)) || '://' || {_HOST} || CASE WHEN {_PATH} IN ('', '/') THEN '/' ELSE rtrim({_PATH}, '/') END
  || CASE WHEN len(list_filter(string_split(regexp_extract({{0}}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains({_TRACK}, lower(split_part(p, '=', 1))))) > 0
     THEN '?' || array_to_string(list_sort(list_filter(string_split(regexp_extract({{0}}, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains({_TRACK}, lower(split_part(p, '=', 1))))), '&') ELSE '' END"""


def _canon(col: str) -> str:
    return _CANON.replace("{0}", col).replace("{{0}}", col)


_DOMAIN = f"regexp_replace({_HOST.format('url')}, '^www\\.', '')"
_BIN = r"regexp_matches(lower({0}), '\.(" + "|".join(BINARY_SUFFIXES) + ")$')"


def _rule_sql() -> tuple[str, str]:
    """The classifier's best value and type over ``p`` (path), ``segs`` and ``label``."""
    scores = []
    for _, base, us, an in PAGE_RULES:
        own = [f"CASE WHEN segs[1] = '{w}' THEN {base}::DOUBLE WHEN list_contains(segs, '{w}') THEN {base}::DOUBLE * 0.8::DOUBLE WHEN contains(p, '{w}') THEN {base}::DOUBLE * 0.5::DOUBLE ELSE 0 END" for w in us]
        own += [f"CASE WHEN label = '{w}' THEN {base}::DOUBLE * 0.9::DOUBLE WHEN contains(label, '{w}') THEN {base}::DOUBLE * 0.6::DOUBLE ELSE 0 END" for w in an]
        scores.append("greatest(" + ", ".join(own) + ")")
    names = [r[0] for r in PAGE_RULES]
    best = ", ".join(f"{s} AS s_{n}" for s, n in zip(scores, names))
    kind = "CASE " + " ".join(f"WHEN s_{n} = best AND best > 1 THEN '{n}'" for n in names) + " ELSE 'other' END"
    return best, kind


_BEST, _KIND = _rule_sql()
_WORDS = "[" + ", ".join(f"'{w}'" for _, _, us, _ in PAGE_RULES for w in us) + "]"
_NWORDS = sum(len(us) for _, _, us, _ in PAGE_RULES)
#: From links ``l1(site, url, seq, label)`` to their types and scores.
_RULED = rf"""l2 AS (SELECT *, trim(lower({_PATH.format('url')}), '/') AS p, list_filter(string_split(trim(lower({_PATH.format('url')}), '/'), '/'), lambda x: x <> '') AS segs FROM l1),
l3 AS (SELECT *, {_BEST} FROM l2), l4 AS (SELECT *, greatest(1, {', '.join('s_' + r[0] for r in PAGE_RULES)}) AS best FROM l3),
links AS (SELECT site, url, seq, CASE WHEN p = '' THEN 'home' ELSE {_KIND} END AS page_type, CASE WHEN p = '' THEN 12.0::DOUBLE ELSE round_even(best * CASE WHEN len(segs) > 1 THEN greatest(0.35::DOUBLE, 1.0::DOUBLE - 0.18::DOUBLE * (len(segs) - 1)) ELSE 1 END * CASE WHEN regexp_matches(url, '{NOISE_PATTERN}') THEN 0.3::DOUBLE ELSE 1 END, 3) END AS score FROM l4)"""
_LINKS = rf"""l0 AS (SELECT 's' || (p_partkey % 20) || '.example.com' AS site, p_partkey AS seq, 'https://www.S' || (p_partkey % 20) || '.example.com' || CASE WHEN p_partkey % 41 = 0 THEN '/' ELSE '/' || ({_WORDS})[p_partkey % {_NWORDS} + 1] || CASE WHEN p_partkey % 3 = 0 THEN '/x' || (p_partkey % 50) ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN '/tag/a' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN '/guide.pdf' ELSE '' END END || CASE WHEN p_partkey % 5 = 0 THEN '?utm_source=x&page=2' ELSE '#top' END AS raw,
  CASE p_partkey % 4 WHEN 0 THEN 'pricing' WHEN 1 THEN 'our story and more' ELSE '' END AS label FROM part),
l1 AS (SELECT * FROM (SELECT site, seq, label, {_canon('raw')} AS url, row_number() OVER (PARTITION BY site, {_canon('raw')} ORDER BY seq) AS k FROM l0) WHERE k = 1 AND NOT {_BIN.format(_PATH.format('url'))}),
{_RULED}"""
_CAP = "CASE page_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_CAPS.items()) + f" ELSE {DEFAULT_CAP} END"
_SAFE_IP = " OR ".join(f"(n >= {a} AND n < {b})" for a, b in urls.private_ranges())

QUERIES = {f.__name__: f for f in (url_canonical, url_dedup, url_safety, classify_links, rank_links, robots_allowed, sitemap_scan, sitemap_tree, page_observations, page_links, admission, price_extract, parse_amounts, enforce_prices)}
ORACLE_SQL = {
    "url_canonical": f"SELECT page_id, {_canon('url')} AS canonical, sha256({_canon('url')}) AS url_hash, {_DOMAIN} AS domain, {_DOMAIN} = 'example.com' OR {_DOMAIN} LIKE '%.example.com' AS same_site FROM pages",
    "url_dedup": f"SELECT {_canon('url')} AS canonical, min(page_id) AS first_page, count(*) AS n FROM pages GROUP BY 1",
    "url_safety": f"""WITH u AS (SELECT c_custkey AS id, c_custkey % 6 AS m, ((c_custkey * 7) % 256) * 16777216 + ((c_custkey * 3) % 256) * 65536 + ((c_custkey * 5) % 256) * 256 + c_custkey % 256 AS n,
  CASE c_custkey % 6 WHEN 0 THEN 'http://' || concat_ws('.', (c_custkey * 7) % 256, (c_custkey * 3) % 256, (c_custkey * 5) % 256, c_custkey % 256) || '/x' WHEN 1 THEN 'ftp://h' || c_custkey || '.example.com/' WHEN 2 THEN 'https://u:p@h' || c_custkey || '.com/' WHEN 3 THEN 'https://host:' || (c_custkey % 3 * 363 + 80) || '/' WHEN 4 THEN 'http://db' || c_custkey || '.internal/' ELSE 'https://a' || c_custkey || '.org/p.pdf?x=1' END AS url FROM customer)
SELECT id, url, CASE m WHEN 0 THEN CASE WHEN {_SAFE_IP} THEN 'private_address' END WHEN 1 THEN 'scheme_not_allowed' WHEN 2 THEN 'credentials_in_url' WHEN 3 THEN CASE WHEN id % 3 * 363 + 80 IN (80, 443) THEN 'host_not_allowed' ELSE 'port_not_allowed' END WHEN 4 THEN 'host_not_allowed' END AS code, m = 5 AS binary FROM u""",
    "classify_links": f"WITH {_LINKS} SELECT site, url, page_type, score FROM links",
    "rank_links": f"WITH {_LINKS}, c AS (SELECT *, row_number() OVER (PARTITION BY site, page_type ORDER BY score DESC, length(url), seq) AS k FROM links), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, length(url), seq) AS position FROM c WHERE k <= {_CAP}) SELECT site, url, page_type, score, position FROM r WHERE position <= 12",
    "robots_allowed": f"""WITH f AS (SELECT s_suppkey - 1 AS n, s_suppkey % 9 + 1 AS b FROM supplier), p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS origin, {_PATH.format('url')} AS path FROM pages)
SELECT page_id, NOT starts_with(path, '/en/' || b) OR b IS NULL AS allowed FROM p LEFT JOIN f ON f.n = length(origin) % (SELECT count(*) FROM supplier)""",
    "sitemap_scan": rf"""WITH s AS (SELECT {_DOMAIN} AS site, regexp_extract(url, '^([^?#]*)', 1) || CASE page_id % 9 WHEN 0 THEN 'map.xml' WHEN 1 THEN 'a.png' ELSE '' END AS raw FROM pages QUALIFY row_number() OVER (PARTITION BY site ORDER BY '<url><loc> ' || raw || ' </loc></url>', page_id) <= 500)
SELECT DISTINCT site, {_canon('raw')} AS url, CASE WHEN raw LIKE '%.xml' THEN 'nested' ELSE 'page' END AS kind FROM s WHERE NOT raw LIKE '%.png'""",
    "sitemap_tree": rf"""WITH s AS (SELECT {_DOMAIN} AS site, regexp_extract(url, '^([^?#]*)', 1) AS raw, page_id FROM pages QUALIFY row_number() OVER (PARTITION BY site ORDER BY raw, page_id) <= 500)
SELECT site, {_canon('raw')} AS url, min(CASE WHEN page_id % 2 = 1 THEN 2 ELSE 1 END) AS level FROM s GROUP BY ALL""",
    "page_links": """SELECT page_id, href, min(i) - 1 AS first_seq FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i FROM pages) WHERE href <> '' AND NOT regexp_matches(href, '(?i)^(#|mailto:|tel:|javascript:|data:)') GROUP BY ALL""",
    "admission": "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'http_404' WHEN page_id % 5 = 0 THEN 'content_type' END AS reject_code, length(html) > 2000000 AS truncated, least(length(html), 2000000) AS kept_chars FROM pages",
    "price_extract": "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'monthly' WHEN 1 THEN 'one_time' ELSE 'unknown' END AS period, CAST(printf('%.2f', p_retailprice) AS DOUBLE) AS amount, CASE WHEN p_partkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM part",
    "parse_amounts": """WITH k AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS k, CAST(floor(l_extendedprice) AS BIGINT) AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE k % 5 WHEN 0 THEN CAST(w || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS DOUBLE) WHEN 1 THEN CAST(w || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS DOUBLE) WHEN 2 THEN CAST('1' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') AS DOUBLE) WHEN 3 THEN CAST((k % 90 + 1) * 1000 + k % 1000 AS DOUBLE) END AS amount FROM k""",
    "enforce_prices": """WITH s AS (SELECT DISTINCT p_brand, round_even(p_retailprice, 2) AS amount, CASE WHEN p_partkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency FROM part WHERE p_partkey % 3 = 0), c AS (SELECT p_brand, p_partkey AS plan, CASE WHEN p_partkey % 10 <> 0 THEN round_even(p_retailprice, 2) END AS amount FROM part),
j AS (SELECT plan, c.amount, c.amount IS NULL OR EXISTS (SELECT 1 FROM s WHERE s.p_brand = c.p_brand AND s.amount = c.amount AND s.currency = 'EUR') AS keep, EXISTS (SELECT 1 FROM s WHERE s.p_brand = c.p_brand AND s.amount = c.amount) AS number FROM c)
SELECT plan, CASE WHEN keep OR number THEN amount END AS amount, CASE WHEN keep THEN 'EUR' END AS currency, NOT keep AND NOT number AS is_custom, CASE WHEN keep THEN NULL WHEN number THEN 'currency_cleared' ELSE 'price_discarded' END AS note FROM j""",
}
