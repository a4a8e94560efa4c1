from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import alerts


def test_mail_totals_are_the_counts_of_all_mails(spark):
    rng = random.Random(3)
    pick = lambda *x: rng.choice(x)
    changes = spark.createDataFrame([(k, pick("a", "b", None), pick("x", "y", None), pick("p", "q", None), pick("low", "medium", "high", None)) for k in range(300)], "change_id long, organization_id string, competitor_id string, change_type string, severity string")
    rules = [(k, pick("a", "b"), pick("x", "y", None), rng.sample(["p", "q", "p"], rng.randrange(4)), pick("low", "high"), pick(["email"], ["in_app", "email"], ["in_app"]), rng.random() < 0.8) for k in range(60)]
    rules = spark.createDataFrame(rules, "rule_id long, organization_id string, competitor_id string, change_types array<string>, min_severity string, channels array<string>, is_active boolean")
    people = spark.createDataFrame([(pick("a", "b"), k, f"{k % 20}@x") for k in range(30)], "organization_id string, user_id long, email string")
    rows = alerts.addressed(alerts.match(changes, rules), people.select("organization_id", "email").distinct())
    want = rows.groupBy("organization_id").agg(F.count("*").alias("mails"), F.countDistinct("email").alias("people"))
    assert sorted(map(tuple, alerts.mail_totals(changes, rules, people).collect())) == sorted(map(tuple, want.collect())) and want.count() == 2


def test_an_address_of_two_users_gets_one_mail(spark):
    changes = spark.createDataFrame([(1, "a", "x", "p", "high")], "change_id long, organization_id string, competitor_id string, change_type string, severity string")
    rules = spark.createDataFrame([(1, "a", None, [], "low", ["email"], True)], "rule_id long, organization_id string, competitor_id string, change_types array<string>, min_severity string, channels array<string>, is_active boolean")
    people = spark.createDataFrame([("a", 1, "m@x"), ("a", 2, "m@x")], "organization_id string, user_id long, email string")
    assert [tuple(r) for r in alerts.mail_totals(changes, rules, people).collect()] == [("a", 1, 1)]
