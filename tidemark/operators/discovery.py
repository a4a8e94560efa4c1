"""Which pages to read: candidates from links and sitemaps, classified and ranked under caps; robots rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.functions.constants import DEFAULT_CAP, TYPE_CAPS
from tidemark.functions.text import let
from tidemark.operators.state import first_wins
from tidemark.sources.tables import shared_folder


def classified(links: DataFrame) -> DataFrame:
    """``links(site, url, anchor, seq)`` normalised, of their own site, no binaries, the first of equal ones, with type and score."""
    site = F.col("site")
    parts = let(urls.normalize_url(F.col("url")), lambda u: F.struct(u.alias("url"), (urls.same_site(u, site) & ~urls.is_binary(u) & (u != "")).alias("wanted")))
    # As generators, so that filters and windows on their results do not have them computed again.
    rows = links.select("site", "anchor", "seq", F.inline(F.array(parts))).where("wanted")
    rows = first_wins(rows, ["site", "url"], "seq")
    return rows.select("site", "url", "anchor", "seq", F.inline(F.array(urls.classify(F.col("url"), F.col("anchor")))))


def candidates(links: DataFrame, sitemap: DataFrame, homes: DataFrame) -> DataFrame:
    """``site, url, anchor, seq, source``: the home pages, then links, then sitemap pages, each in its own order.

    ``links(site, url, anchor, seq)``, ``sitemap(site, url, seq)``, ``homes(site, url)``; equal URLs stay for the first to win.
    """
    home = homes.select("site", "url", F.lit("").alias("anchor"), F.lit(0).cast("long").alias("seq"), F.lit("home").alias("source"))
    found = links.select("site", "url", "anchor", (F.col("seq") + 1).cast("long").alias("seq"), F.lit("link").alias("source"))
    listed = sitemap.select("site", "url", F.lit("").alias("anchor"), (F.col("seq") + 2**40).cast("long").alias("seq"), F.lit("sitemap").alias("source"))
    return home.unionByName(found).unionByName(listed)


def plan(links: DataFrame, sitemap: DataFrame, homes: DataFrame, budget: int = 25, barred: DataFrame | None = None) -> DataFrame:
    """Which pages of each site to read: candidates of all sources, classified, without ``barred(site, url)``, ranked under caps and budget."""
    rows = classified(candidates(links, sitemap, homes))
    if barred is not None:
        rows = rows.join(barred.select("site", urls.normalize_url(F.col("url")).alias("url")).distinct(), ["site", "url"], "left_anti")
    return ranked(rows, budget)


def after_redirect(pages: DataFrame) -> DataFrame:
    """``pages(url, final_url, page_type, ...)`` with the type of where a redirect led; a home page stays one."""
    moved = F.col("final_url").isNotNull() & (F.col("final_url") != F.col("url")) & (F.col("page_type") != "home")
    return pages.withColumn("page_type", F.when(moved, urls.classify(F.col("final_url"), F.lit(""))["page_type"]).otherwise(F.col("page_type")))


def ranked(pages: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` pages of each site with at most the type's cap of each: best score, shortest URL, first seen.

    A page over its type's cap is never taken and takes no other's place, so two ranks give the greedy choice.
    """
    order = [F.col("score").desc(), F.length("url"), F.col("seq")]
    caps = F.create_map(*[F.lit(x) for pair in TYPE_CAPS.items() for x in pair])
    cap = F.coalesce(F.try_element_at(caps, F.col("page_type")), F.lit(DEFAULT_CAP))
    rows = pages.withColumn("_n", F.row_number().over(Window.partitionBy("site", "page_type").orderBy(*order))).where(F.col("_n") <= cap)
    rows = rows.withColumn("position", F.row_number().over(Window.partitionBy("site").orderBy(*order)))
    return rows.where(F.col("position") <= limit).drop("_n")


def sitemap_urls(files: DataFrame, most: int = 500) -> DataFrame:
    """``site, url, kind`` of ``files(site, xml)``: pages of the site, and nested sitemaps; at most ``most`` per site in order."""
    found = F.regexp_extract_all("xml", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    rows = files.select("site", F.posexplode(found).alias("seq", "raw")).where(F.regexp_like("raw", F.lit("(?i)^https?://")))
    rows = rows.withColumn("url", urls.normalize_url(F.col("raw"))).where(urls.same_site(F.col("url"), F.col("site")))
    nested = F.endswith(F.lower(urls.path(F.col("url"))), F.lit(".xml"))
    rows = rows.withColumn("kind", F.when(nested, "nested").when(~urls.is_binary(F.col("url")), "page")).where("kind is not null")
    rows = first_wins(rows, ["site", "url"], "seq")
    rank = F.row_number().over(Window.partitionBy("site", "kind").orderBy("seq"))
    return rows.withColumn("_n", rank).where(F.col("_n") <= most).select("site", "url", "kind")


def sitemap_tree(roots: DataFrame, files: DataFrame, depth: int = 3, most_files: int = 50, most: int = 500) -> DataFrame:
    """``site, url, level``: pages that the sitemaps of ``roots(site, url)`` and the sitemaps nested in them list; ``files(url, xml)`` has their texts.

    Level by level, a site's new sitemaps are joined with the files and what they nest is the next level's, without those
    visited before: a cycle ends there.  At most ``depth`` levels, ``most_files`` sitemaps (by level, then URL) and ``most``
    pages (by level, then URL) of a site are taken.  A page that several levels list has the first one.
    """
    spark = roots.sparkSession
    files = files.select(urls.normalize_url(F.col("url")).alias("map"), "xml")
    folder = shared_folder(spark, "sitemaps")
    kept = lambda df, name: (df.write.parquet(f"{folder}/{name}"), spark.read.schema(df.schema).parquet(f"{folder}/{name}"))[1]
    front = kept(roots.select("site", urls.normalize_url(F.col("url")).alias("map")).where("map is not null").distinct(), "front0")
    visited, pages = front, None
    for level in range(depth):
        listed = kept(sitemap_urls(front.join(files, "map").select("site", "xml"), most), f"listed{level}")
        found = listed.where("kind = 'page'").select("site", "url", F.lit(level).alias("level"))
        pages = found if pages is None else pages.unionByName(found)
        new = listed.where("kind = 'nested'").select("site", F.col("url").alias("map")).distinct().join(visited, ["site", "map"], "left_anti")
        room = visited.groupBy("site").agg(F.count("*").alias("n"))
        rank = F.row_number().over(Window.partitionBy("site").orderBy("map"))
        front = kept(new.withColumn("_k", rank).join(room, "site").where(F.col("_k") + F.col("n") <= most_files).select("site", "map"), f"front{level + 1}")
        if front.isEmpty():
            break
        visited = visited.unionByName(front)
    first = pages.groupBy("site", "url").agg(F.min("level").alias("level"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("level", "url"))
    return first.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def robots_sitemaps(files: DataFrame, most: int = 10) -> DataFrame:
    """``origin, sitemap`` of ``files(origin, body)``: the directives in order, or the default place without any."""
    found = F.filter(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1)), lambda u: F.regexp_like(u, F.lit("(?i)^https?://")))
    default = F.array(F.concat("origin", F.lit("/sitemap.xml")))
    return files.select("origin", F.explode(F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(default)).alias("sitemap"))


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """``origin, seq, path, allow`` of ``files(origin, body)``: the rules of the group that applies to ``agent``.

    User-agent lines that follow each other name one group; a blank line ends it.  The first group with a name that is
    part of the agent's applies, else the first group of ``*``.  An empty Disallow allows everything.
    """
    rows = files.select("origin", F.posexplode(F.split("body", "\r?\n")).alias("seq", "line")).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", "")))
    key, value = F.lower(F.trim(F.regexp_extract("line", r"^([^:]+):", 1))), F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1))
    kind = F.when(F.col("line") == "", "blank").when(key == "user-agent", "agent").when(key.isin("allow", "disallow"), "rule")
    rows = rows.select("origin", "seq", key.alias("k"), value.alias("v"), kind.alias("kind")).where("kind is not null")
    order = Window.partitionBy("origin").orderBy("seq")
    rows = rows.withColumn("before", F.lag("kind").over(order))
    rows = rows.withColumn("start", (F.col("kind") == "blank") | (F.col("kind") == "agent") & ~F.col("before").eqNullSafe(F.lit("agent")))
    rows = rows.withColumn("group", F.sum(F.col("start").cast("int")).over(order))
    name = F.lower(F.split(F.lit(agent), "/")[0])
    own = F.when(F.col("v") == "*", F.lit(agent == "*")).otherwise((F.col("v") != "") & F.contains(name, F.lower("v")))
    agents = rows.where("kind = 'agent'").groupBy("origin", "group").agg(F.bool_or(own).alias("own"), F.bool_or(F.col("v") == "*").alias("any"))
    rules = rows.where("kind = 'rule'").select("origin", "group", "seq", F.col("v").alias("path"), ((F.col("k") == "allow") | (F.col("v") == "")).alias("allow"))
    # A group without rules that a blank line ends is none.
    agents = agents.join(rules.select("origin", "group").distinct(), ["origin", "group"], "left_semi").where(F.col("own") | F.col("any"))
    chosen = agents.groupBy("origin").agg(F.coalesce(F.min(F.when(F.col("own"), F.col("group"))), F.min("group")).alias("group"))
    return rules.join(chosen, ["origin", "group"]).select("origin", "seq", "path", "allow")


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages(origin, url)`` with ``allowed``: the first rule whose path begins the page's decides, none allows."""
    hit = F.startswith(urls.path(F.col("url")), F.when(F.col("path") == "*", "").otherwise(F.col("path")))
    first = pages.select("origin", "url").distinct().join(rules, "origin").where(hit).groupBy("origin", "url").agg(F.min_by("allow", "seq").alias("allow"))
    return pages.join(first, ["origin", "url"], "left").withColumn("allowed", F.coalesce("allow", F.lit(True))).drop("allow")
