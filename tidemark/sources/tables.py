"""The given tables, and domain inputs derived from them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """At most so many rows per Arrow batch from now on: a Python worker holds a few copies of its batch, whose texts may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which the driver and all executors must share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}/{uuid.uuid4().hex}"


def page_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """A folder of crawled pages in Parquet as a stream; ``schema`` is theirs."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def jdbc_table(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int = 32) -> DataFrame:
    """A database table read in ``parts`` ranges of a numeric column."""
    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=parts)


def append_by_date(df: DataFrame, path: str, ts: str) -> None:
    """Append rows to a Parquet table with a partition per day of ``ts``, one file per day and task at most."""
    day = f"{ts}_date"
    df.withColumn(day, F.to_date(ts)).write.mode("append").partitionBy(day).parquet(path)


def fetched(urls: DataFrame, fetch: Callable[[str], dict]) -> DataFrame:
    """Pages of ``urls(page_id, url)`` as ``fetch`` gives them: ``page_id, url, final_url, status, content_type, html, error``.

    ``fetch`` returns a dictionary of these fields for one URL; an exception is that page's ``error``.  It runs in tasks.
    """
    names = ["page_id", "url", "final_url", "status", "content_type", "html", "error"]

    def one(page_id: int, url: str) -> tuple:
        try:
            got = fetch(url)
            return page_id, url, got.get("final_url", url), got.get("status"), got.get("content_type"), got.get("html"), None
        except Exception as error:  # whatever the caller's function raises is the page's result
            return page_id, url, None, None, None, None, f"{type(error).__name__}: {error}"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(*x) for x in zip(b["page_id"], b["url"])], columns=names).astype({"status": "Int32"})

    return urls.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInPandas(work, "page_id long, url string, final_url string, status int, content_type string, html string, error string")


def deliver(outbox: DataFrame, send: Callable[[dict], bool]) -> DataFrame:
    """``notification_id, ok`` of the pending rows of an outbox, by ``send`` with each row as a dictionary; an exception is a failure."""

    def one(row: dict) -> bool:
        try:
            return bool(send(row))
        except Exception:  # a delivery that fails for whatever reason is tried again
            return False

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"notification_id": b["notification_id"], "ok": [one(r) for r in b.to_dict("records")]})

    kind = outbox.schema["notification_id"].dataType.simpleString()
    return outbox.where("status = 'pending'").mapInPandas(work, f"notification_id {kind}, ok boolean")


def reviews(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Reviews from a Parquet folder; without one, none."""
    schema = "key string, source string, source_url string, rating double, max_rating double"
    return spark.createDataFrame([], schema) if path is None else spark.read.schema(schema).parquet(path)


def demo(spark: SparkSession) -> dict[str, DataFrame]:
    """A small made-up market to try things on: three competitors with plans, products, features, scores and one price change."""
    names = ("Northwind Analytics", "Kestrel CRM", "Palisade Desk")
    plans = [("d0", "Free", 0.0, False), ("d0", "Team", 89.0, False), ("d0", "Business", 249.0, False), ("d0", "Enterprise", None, True), ("d1", "Custom", None, True), ("d2", "Standard", 49.0, False)]
    products = [("d0", "Insights"), ("d0", "Pipelines"), ("d1", "Contacts"), ("d2", "Inbox")]
    features = [(f"d{k % 3}", f"Feature {k + 1}") for k in range(14)]
    change = [("d0", "price_increased", "medium", "team|monthly", 79.0, 89.0, round(10 / 79, 4))]
    return {
        "competitors": spark.createDataFrame([(f"d{k}", "demo", n, f"https://{n.split()[0].lower()}.example/") for k, n in enumerate(names)], "competitor_id string, organization_id string, name string, website string"),
        "plans": spark.createDataFrame(plans, "competitor_id string, name string, amount double, is_custom_pricing boolean"),
        "products": spark.createDataFrame(products, "competitor_id string, name string"),
        "features": spark.createDataFrame(features, "competitor_id string, name string"),
        "scores": spark.createDataFrame([("d0", 75.0, "high"), ("d1", 40.0, "moderate"), ("d2", None, "unknown")], "competitor_id string, overall double, threat_level string"),
        "changes": spark.createDataFrame(change, "competitor_id string, change_type string, severity string, entity_key string, before double, after double, magnitude double"),
    }


PERIODS = ("monthly", "yearly", "one_time")


def plans(part: DataFrame, new: bool) -> DataFrame:
    """Plan states from parts: brands are competitors; the new state lacks some plans, has others, and other prices."""
    key, price = F.col("p_partkey"), F.col("p_retailprice")
    period = F.array(*map(F.lit, PERIODS))[(F.col("p_size") % 3).cast("int")]
    amount = F.when(key % (19 if new else 23) != 0, price * (1.0 + ((key % 7) - 3) * F.lit(0.05)) if new else price)
    return part.where(key % (13 if new else 17) != 0).select(
        F.col("p_brand").alias("competitor_id"), F.col("p_name").alias("name"), amount.alias("amount"), F.lit("EUR").alias("currency"), period.alias("billing_period"), key.alias("seq")
    )


def products(part: DataFrame, new: bool) -> DataFrame:
    """Product states from parts, named by part and type."""
    key = F.col("p_partkey")
    rows = part.where(key % (11 if new else 10) != 0)
    return rows.select(F.col("p_brand").alias("competitor_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), key.alias("seq"))


def page_states(pages: DataFrame, new: bool) -> DataFrame:
    """Page states: hosts are competitors; the new state lacks and gains pages, and some texts differ."""
    site = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    text = F.when(F.lit(new) & (F.col("page_id") % 5 == 0), F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    return pages.where(F.col("page_id") % (7 if new else 8) != 0).select(
        site.alias("competitor_id"), F.concat_ws("#", "url", F.col("page_id").cast("string")).alias("url"), F.sha2(text, 256).alias("text_hash")
    )


def score_inputs(supplier: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The 32 features of a competitor, from counts over a supplier's line items; some have none at all."""
    # By supplier and part first: distinct parts are then plain rows, and both steps combine before their shuffle.
    per = lineitem.groupBy("l_suppkey", "l_partkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_discount") > 0.05).alias("disc"), F.count_if(F.col("l_returnflag") == "R").alias("ret"),
        F.count_if(F.col("l_linenumber") == 1).alias("firsts"), F.sum("l_quantity").alias("q"), F.count("l_quantity").alias("nq"),
    )
    agg = per.groupBy("l_suppkey").agg(*[F.sum(c).alias(c) for c in ("n", "disc", "ret", "firsts")], F.count("l_partkey").alias("parts"), F.try_divide(F.sum("q"), F.sum("nq")).alias("qty"))
    rows = supplier.join(agg, F.col("s_suppkey") == F.col("l_suppkey"), "left").na.fill(0, ["n", "parts", "disc", "ret", "firsts"])
    k = F.col("s_suppkey")
    n, flag = lambda c, m: (F.col(c) % m).cast("int"), lambda m: k % m == 0
    return rows.select(
        F.concat(F.lit("s"), k.cast("string")).alias("competitor_id"), F.concat(F.lit("o"), (F.col("s_nationkey") % 5).cast("string")).alias("organization_id"),
        n("n", 9).alias("product_count"), F.least(n("disc", 9), n("n", 9)).alias("products_with_description"), n("parts", 30).alias("feature_count"), (n("parts", 30) / 4.0).alias("features_per_product"),
        n("ret", 6).alias("pricing_plan_count"), F.least(n("firsts", 6), n("ret", 6)).alias("plans_with_public_amount"), flag(2).alias("has_free_tier"), flag(3).alias("has_custom_pricing"), flag(4).alias("pricing_page_found"),
        n("disc", 5).alias("value_proposition_count"), n("ret", 4).alias("target_audience_count"), flag(5).alias("has_positioning_statement"),
        n("n", 12).alias("pages_crawled"), F.least(n("disc", 3), n("n", 12)).alias("pages_missing_title"), F.least(n("ret", 3), n("n", 12)).alias("pages_missing_meta_description"), F.least(n("firsts", 3), n("n", 12)).alias("pages_missing_h1"),
        n("parts", 5).alias("structured_data_type_count"), flag(2).alias("has_sitemap"), flag(3).alias("has_robots_txt"), (F.coalesce("qty", F.lit(0.0)) * 30).alias("avg_word_count"), flag(7).alias("has_blog"),
        n("firsts", 6).alias("marketing_channel_count"), n("disc", 4).alias("social_profile_count"), n("ret", 3).alias("case_study_pages"), n("n", 5).alias("cta_count"), n("parts", 7).alias("open_graph_tag_count"), flag(2).alias("has_favicon"),
        n("n", 40).alias("external_link_count"), n("ret", 8).alias("review_count"), F.when(k % 3 != 0, (k % 9 - 4) / 4.0).alias("sentiment_score"), F.when(k % 4 != 0, (k % 10) / 10.0).alias("ai_confidence"),
    )


def as_of(value: str = "2024-01-20 00:00:00") -> Column:
    return F.to_timestamp(F.lit(value))
