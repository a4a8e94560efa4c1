"""State tables: latest and first rows per key, upserts with first and last sight, reuse by fingerprint, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], ts: str, tie: str, n: int = 1) -> DataFrame:
    """The newest ``n`` rows of each key, equal times by the smaller ``tie``."""
    order = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), F.col(tie))
    return df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def latest_struct(df: DataFrame, keys: list[str], ts: str, tie: str) -> DataFrame:
    """The newest row of each key by an aggregation, which combines before its shuffle; a numeric ``tie`` decides."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(ts), -F.col(tie))).alias("r")
    return df.groupBy(*keys).agg(best).select(*keys, "r.*")


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(seq))).where("_n = 1").drop("_n")


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str], values: list[str], now: Column, seq: str) -> DataFrame:
    """``stored(keys, values, first_seen, last_seen, is_current)`` merged with ``batch(keys, values, seq)``.

    The first row of a key in the batch counts.  Keys in the batch become current and are seen now; all others stay with
    their values and are no longer current.  One full outer join on the keys.
    """
    new = first_wins(batch, keys, seq).select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_in"))
    both = stored.join(new, keys, "full_outer")
    here = F.coalesce("_in", F.lit(False))
    return both.select(
        *keys, *[F.when(here, F.col(f"_{v}")).otherwise(F.col(v)).alias(v) for v in values],
        F.coalesce("first_seen", now).alias("first_seen"), F.when(here, now).otherwise(F.col("last_seen")).alias("last_seen"), here.alias("is_current"),
    )


def fingerprint(pages: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 per key over the set of its pages' URLs and hashes, in whatever order and number they come.

    Each page's own SHA-256 is added up in four parts of 64 bits, so no page is left out and no list of pages is held; sums
    combine before the shuffle.  A null URL or hash is an empty one.
    """
    page = F.sha2(F.concat_ws("\n", F.coalesce("url", F.lit("")), F.coalesce("text_hash", F.lit(""))), 256)
    sums = [F.sum(F.conv(F.substring("_h", 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"_{k}") for k in range(4)]
    total = pages.withColumn("_h", page).groupBy(*keys).agg(F.count("*").cast("string").alias("_n"), *sums)
    return total.select(*keys, F.sha2(F.concat_ws(",", "_n", *[f"_{k}" for k in range(4)]), 256).alias("fingerprint"))


def unchanged(current: DataFrame, analyses: DataFrame) -> DataFrame:
    """``current(competitor_id, fingerprint)`` whose fingerprint an earlier analysis has, with the latest such one."""
    known = latest(analyses, ["competitor_id", "fingerprint"], "created_at", "analysis_id").select("competitor_id", "fingerprint", "analysis_id")
    return current.join(known, ["competitor_id", "fingerprint"])


def new_chunks(chunks: DataFrame, stored: DataFrame, most: int = 200) -> DataFrame:
    """Chunks whose hash the competitor does not have yet, the first of equal ones, at most ``most`` per competitor."""
    keys = ["competitor_id", "content_hash"]
    fresh = first_wins(chunks.join(stored.select(*keys).distinct(), keys, "left_anti"), keys, "seq")
    rank = F.row_number().over(Window.partitionBy("competitor_id").orderBy("seq"))
    return fresh.withColumn("_n", rank).where(F.col("_n") <= most).drop("_n")


def retain(df: DataFrame, ts: str, as_of: Column, days: int, text: str) -> DataFrame:
    """Texts older than ``days`` emptied (hashes stay), with ``cleared``; zero or fewer days keep all."""
    old = (F.col(ts) < as_of - F.make_interval(days=F.lit(days))) & (F.coalesce(F.col(text), F.lit("")) != "") if days > 0 else F.lit(False)
    return df.withColumn("cleared", F.coalesce(old, F.lit(False))).withColumn(text, F.when(F.col("cleared"), "").otherwise(F.col(text)))


def unexpired(df: DataFrame, expires: str, as_of: Column, days: int) -> DataFrame:
    """Rows that have not been expired for ``days`` days or more; those without an expiry stay."""
    return df.where(F.col(expires).isNull() | (F.col(expires) >= as_of - F.make_interval(days=F.lit(days))))


def seen(history: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """When each key was seen first and last."""
    return history.groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def page_upsert(stored: DataFrame, crawl: DataFrame) -> DataFrame:
    """``stored(competitor_id, url_hash, title, page_type, is_active)`` merged with one crawl of the same columns but the last.

    Pages of the crawl are active with their new title and type; stored pages of a crawled competitor that the crawl lacks
    become inactive; pages of competitors that were not crawled stay.  ``action`` tells which it was.
    """
    keys = ["competitor_id", "url_hash"]
    new = crawl.groupBy(*keys).agg(F.max(F.struct("title", "page_type")).alias("n"))
    crawled = crawl.select("competitor_id").distinct().withColumn("crawled", F.lit(True))
    both = stored.join(new, keys, "full_outer").join(crawled, "competitor_id", "left")
    here, stale = F.col("n").isNotNull(), F.col("n").isNull() & F.coalesce("crawled", F.lit(False))
    action = F.when(here & F.col("is_active").isNull(), "insert").when(here, "update").when(stale, "deactivate").otherwise("keep")
    return both.select(
        *keys, F.when(here, F.col("n.title")).otherwise(F.col("title")).alias("title"), F.when(here, F.col("n.page_type")).otherwise(F.col("page_type")).alias("page_type"),
        F.when(here, True).when(stale, False).otherwise(F.col("is_active")).alias("is_active"), action.alias("action"),
    )


def load(plans: DataFrame, products: DataFrame, pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``competitor_id, kind, key, value``: the state that a new crawl is compared with, for all competitors.

    Current plans and products, and the text hash of each active page's newest snapshot.
    """
    p = plans.where("is_current").select("competitor_id", F.lit("plan").alias("kind"), "key", F.col("amount").cast("string").alias("value"))
    q = products.where("is_current").select("competitor_id", F.lit("product").alias("kind"), "key", F.lit(None).cast("string").alias("value"))
    last = latest_struct(snapshots, ["page_id"], "fetched_at", "snapshot_id").select("page_id", "text_hash")
    h = pages.where("is_active").join(last, "page_id").select("competitor_id", F.lit("page").alias("kind"), F.col("url").alias("key"), F.col("text_hash").alias("value"))
    return p.unionByName(q).unionByName(h)


def scoped(df: DataFrame, organization: str | None = None) -> DataFrame:
    """Live rows, of one organisation if it is named."""
    df = df.where("deleted_at is null") if "deleted_at" in df.columns else df
    return df if organization is None else df.where(F.col("organization_id") == organization)


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """A page of ordered rows with ``total`` and ``has_more``; limit at most 100."""
    limit, offset = max(1, min(limit, 100)), max(0, offset)
    total = df.count()
    return df.orderBy(*order).offset(offset).limit(limit).withColumns({"total": F.lit(total), "has_more": F.lit(offset + limit < total)})
