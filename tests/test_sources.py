"""Crawls as a source, deliveries from a stream, sitemap trees and fingerprints."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import discovery, state
from tidemark.sources import crawls
from tidemark.streaming import delivery, jobs

PAGES = "page_id long, url string, html string"


def crawl(spark, path, name, rows, **flags):
    crawls.write_crawl(spark.createDataFrame(rows, PAGES).repartition(3), path, name, flags)


def test_crawls_in_batch(spark, tmp_path):
    spark.dataSource.register(crawls.CrawlSource)
    path = f"file://{tmp_path}"
    assert spark.read.format("crawls").load(path).count() == 0
    crawl(spark, path, "c1", [(k, f"u{k}", "line\n \U0001f600" * 3) for k in range(700)], has_sitemap=True, sitemap_url_count=4)
    crawl(spark, path, "c2", [(1, None, None)], root_url="https://a/")
    spark.createDataFrame([(9, "u", "h")], PAGES).write.json(f"{path}/c3/pages")  # not finished: no flags
    rows = spark.read.format("crawls").load(path)
    assert rows.groupBy("crawl_id").count().orderBy("crawl_id").collect() == [("c1", 700), ("c2", 1)]
    one = rows.where("page_id = 5").first()
    assert (one["html"], one["has_sitemap"], one["sitemap_url_count"], one["has_robots_txt"]) == ("line\n \U0001f600" * 3, True, 4, None)
    assert rows.where("crawl_id = 'c2'").first()["html"] is None


def test_a_stream_of_crawls_reads_each_page_once(spark, tmp_path):
    """Over restarts, with a crawl that is finished later."""
    spark.dataSource.register(crawls.CrawlSource)
    path, work = f"file://{tmp_path}/crawls", f"file://{tmp_path}/work"
    for part in range(3):
        crawl(spark, path, f"c{part}", [(10 * part + k, "u", "h") for k in range(10)], has_robots_txt=part == 1)
        if part == 1:
            spark.createDataFrame([(99, "u", "h")], PAGES).write.json(f"{path}/c9/pages")
        jobs.run(spark.readStream.format("crawls").load(path), jobs.append, work)
    jobs.run(spark.readStream.format("crawls").load(path), jobs.append, work)
    found = spark.read.parquet(f"{work}/out")
    assert sorted(r["page_id"] for r in found.collect()) == list(range(30)) and found.where("has_robots_txt").count() == 10


SCHEMA = "notification_id string, channel string"


def feed(spark, folder, parts, send, most=3):
    for rows in parts:
        if rows:
            spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        jobs.run(stream, delivery.deliveries(send, SCHEMA, most), folder)
    return {r["notification_id"]: (r["attempts"], r["status"]) for r in delivery.statuses(spark, folder, SCHEMA, most).collect()}


def sender(log, failing=(), stop=None):
    """A send function that leaves a line per call, fails for some ids, and may end the work once."""

    def send(row):
        with open(log, "a") as f:
            f.write(row["notification_id"] + "\n")
        if stop and row["notification_id"] == stop[0] and not os.path.exists(stop[1]):
            open(stop[1], "w").close()
            os._exit(1)  # the worker is lost in the middle of a group
        return row["notification_id"] not in failing

    return send


def test_deliveries(spark, tmp_path):
    folder, log = f"file://{tmp_path}/x", f"{tmp_path}/log"
    parts = [[(f"n{k}", "mail") for k in range(4)], [("n4", "mail"), ("n1", "again")], [("n5", "mail")]]
    got = feed(spark, folder, parts, sender(log, {"n2", "n5"}))
    assert got == {"n0": (1, "sent"), "n1": (1, "sent"), "n2": (3, "failed"), "n3": (1, "sent"), "n4": (1, "sent"), "n5": (1, "pending")}
    assert sorted(open(log).read().split()) == ["n0", "n1", "n2", "n2", "n2", "n3", "n4", "n5"]


def test_a_stop_between_outbox_and_sending(spark, tmp_path, monkeypatch):
    """Nothing is lost, and nothing is sent twice."""
    folder, log = f"file://{tmp_path}/x", f"{tmp_path}/log"
    with monkeypatch.context() as m:
        m.setattr(delivery, "outbox", lambda *x: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception):
            feed(spark, folder, [[(f"n{k}", "mail") for k in range(5)]], sender(log))
    assert not os.path.exists(log)
    assert feed(spark, folder, [[]], sender(log)) == {f"n{k}": (1, "sent") for k in range(5)}
    assert sorted(open(log).read().split()) == [f"n{k}" for k in range(5)]


def test_a_worker_lost_while_sending(spark, tmp_path, monkeypatch):
    """The group's rows are uncertain and not sent again; the others are sent once."""
    monkeypatch.setattr(delivery, "GROUP", 2)
    folder, log = f"file://{tmp_path}/x", f"{tmp_path}/log"
    rows = [{"notification_id": f"n{k}", "channel": "mail"} for k in range(6)]
    sent = []

    def send(row):
        sent.append(row["notification_id"])
        if row["notification_id"] == "n2" and sent.count("n2") == 1:
            raise KeyboardInterrupt  # ends the task, not the row
        return True

    groups = [rows[k : k + 2] for k in (0, 2, 4)]
    with pytest.raises(KeyboardInterrupt):
        for g in groups:
            delivery.send_group(g, send, folder)
    again = [r["ok"] for g in groups for r in delivery.send_group(g, send, folder)]
    assert again == [True, True, None, None, True, True] and sent == ["n0", "n1", "n2", "n4", "n5"]


def test_sitemap_tree(spark):
    """Three levels, a cycle, a map that two list, a missing file and the budgets."""
    xml = lambda *locs: "".join(f"<url><loc>https://a.com/{x}</loc></url>" for x in locs)
    files = [("https://a.com/sitemap.xml", xml("one.xml", "two.xml", "p0")), ("https://a.com/one.xml", xml("p1", "deep.xml", "sitemap.xml")), ("https://a.com/two.xml", xml("p1", "p2", "deep.xml", "gone.xml"))]
    files += [("https://a.com/deep.xml", xml("p3", "p0", "deepest.xml")), ("https://a.com/deepest.xml", xml("p4"))]
    roots = spark.createDataFrame([("a.com", "https://a.com/sitemap.xml"), ("b.com", "https://b.com/none.xml")], "site string, url string")
    frame = spark.createDataFrame(files, "url string, xml string")
    tree = lambda **x: {(r["url"].rpartition("/")[2], r["level"]) for r in discovery.sitemap_tree(roots, frame, **x).collect()}
    assert tree() == {("p0", 0), ("p1", 1), ("p2", 1), ("p3", 2)}
    assert tree(depth=9) == {("p0", 0), ("p1", 1), ("p2", 1), ("p3", 2), ("p4", 3)}
    assert tree(most_files=2) == {("p0", 0), ("p1", 1)} and tree(most=2) == {("p0", 0), ("p1", 1)}


def test_fingerprint_of_many_pages(spark):
    """The 501st page counts; order and dealing do not; a page more or less does."""
    rows = spark.range(1_200).select(F.lit("c").alias("k"), F.concat(F.lit("u"), F.format_string("%05d", "id")).alias("url"), F.col("id").cast("string").alias("text_hash"))
    of = lambda df: state.fingerprint(df, ["k"]).first()["fingerprint"]
    base = of(rows)
    assert base == of(rows.orderBy(F.desc("url"))) == of(rows.repartition(7))
    changed = rows.withColumn("text_hash", F.when(F.col("url") == "u00900", "x").otherwise(F.col("text_hash")))
    assert len({base, of(changed), of(rows.where("url <> 'u00900'")), of(rows.union(rows.where("url = 'u00900'")))}) == 4
