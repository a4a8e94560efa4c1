from __future__ import annotations

import random

import pytest

from tidemark.operators import alerts, changes

PLAN = "competitor_id string, name string, amount double, currency string, billing_period string, seq long"


def plans(spark, *rows):
    return spark.createDataFrame([("c", name, amount, "EUR", "monthly", k) for k, (name, amount) in enumerate(rows)], PLAN)


@pytest.mark.parametrize(
    "old, new, kinds",
    [
        ([("Pro", 49.0)], [("Pro", 59.0)], [("price_increased", "high")]),
        ([("Pro", 100.0)], [("Pro", 100.5)], []),
        ([("Pro", 100.0)], [("Pro", 103.0)], [("price_increased", "low")]),
        ([("Pro", 100.0)], [("Pro", 90.0)], [("price_decreased", "medium")]),
        ([("Pro", 49.0)], [("Enterprise", None)], [("plan_added", "medium"), ("plan_removed", "medium")]),
        ([("Pro Plan", 49.0)], [("pro plan.", 49.0)], []),
        ([("Pro", None)], [("Pro", 20.0)], [("price_decreased", "medium")]),
        ([("Pro", 20.0)], [("Pro", None)], [("price_increased", "medium")]),
        ([("Free", 0.0)], [("Free", 10.0)], []),
        ([("Pro", 1.0), ("Pro", 49.0)], [("Pro", 49.0)], []),
        ([], [], []),
    ],
)
def test_plan_diff(spark, old, new, kinds):
    rows = changes.plan_diff(plans(spark, *old), plans(spark, *new)).collect()
    assert sorted((r["change_type"], r["severity"]) for r in rows) == sorted(kinds)


def test_plan_titles_and_currency(spark):
    row = changes.plan_diff(plans(spark, ("Pro", 49.0)), plans(spark, ("Pro", 59.5))).first()
    assert row["title"] == "c: Pro EUR 49 to EUR 59.5" and row["magnitude"] == 0.2143
    dollars = spark.createDataFrame([("c", "Pro", 49.0, "USD", "monthly", 0)], PLAN)
    assert changes.plan_diff(plans(spark, ("Pro", 49.0)), dollars).count() == 0
    assert changes.plan_diff(plans(spark, ("Pro", 49.0)), dollars, currency_aware=True).count() == 2


def test_sets_are_capped_and_order_free(spark):
    old = spark.createDataFrame([], "competitor_id string, name string, seq long")
    new = spark.createDataFrame([("c", f"Feature {k}", k) for k in range(60)], "competitor_id string, name string, seq long")
    assert changes.set_diff(old, new, "feature", "medium").count() == 10
    assert changes.set_diff(new, new.orderBy("name"), "feature", "medium").count() == 0


def test_pages(spark):
    schema = "competitor_id string, url string, text_hash string"
    old = spark.createDataFrame([("c", f"/{k}", "a") for k in range(5)], schema)
    new = spark.createDataFrame([("c", f"/{k}", "b") for k in range(5)], schema)
    row = changes.page_diff(old, new).collect()
    assert [(r["change_type"], r["severity"], r["magnitude"]) for r in row] == [("content_changed", "medium", 5.0)]
    assert changes.page_diff(old, old).count() == 0
    assert {r["change_type"] for r in changes.page_diff(old.where("url <> '/1'"), old).collect()} == {"page_added"}


def test_positioning_and_order(spark):
    schema = "competitor_id string, positioning string"
    old = spark.createDataFrame([("a", "the fast platform for teams"), ("b", "one two three four five six seven eight nine ten")], schema)
    new = spark.createDataFrame([("a", "security suite built around banks"), ("b", "one two three four five six seven eight nine")], schema)
    rows = changes.positioning_diff(old, new).collect()
    assert [(r["competitor_id"], r["severity"]) for r in rows] == [("a", "high")]
    both = changes.all_changes(changes.plan_diff(plans(spark, ("A", 1.0)), plans(spark, ("B", 2.0))), changes.plan_diff(plans(spark, ("P", 1.0)), plans(spark, ("P", 2.0)))).orderBy("position").collect()
    assert [r["severity"] for r in both] == ["high", "medium", "medium"]


def test_rules(spark):
    schema = "rule_id long, organization_id long, competitor_id string, is_active boolean, change_types array<string>, min_severity string, channels array<string>, webhook_url string"
    rules = spark.createDataFrame(
        [(1, 1, None, True, [], "low", [], None), (2, 1, "x", True, ["price_increased"], "high", ["email", "in_app"], None), (3, 1, None, False, [], "low", ["email"], None), (4, 1, "y", True, [], "low", ["webhook"], None)], schema
    )
    rules = alerts.clean_rules(rules, ["price_increased"], ["in_app", "email", "webhook"])
    assert [r["violation"] for r in rules.orderBy("rule_id").collect()] == [None, None, None, "webhook_url_missing"]
    change = spark.createDataFrame([("c1", 1, "x", "price_increased", "high"), ("c2", 1, "x", "price_increased", "low"), ("c3", 2, "x", "price_increased", "high")], "change_id string, organization_id long, competitor_id string, change_type string, severity string")
    out = alerts.notifications(alerts.match(change, rules)).collect()
    assert sorted((r["change_id"], r["rule_id"], r["channel"]) for r in out) == [("c1", 1, "in_app"), ("c1", 2, "email"), ("c1", 2, "in_app"), ("c2", 1, "in_app")]
    assert len({r["notification_id"] for r in out}) == 4


@pytest.mark.parametrize("most", [20_000, 0])
def test_rules_meet_changes_by_equality(spark, monkeypatch, most):
    """Against all pairs, sent to all tasks or dealt over slots; the shuffled plan joins on more than the organisation."""
    monkeypatch.setattr(alerts, "BROADCAST_RULES", most)
    rng = random.Random(2)
    kinds, levels = ["a", "b", "c"], ["low", "medium", "high"]
    rules = [(k, rng.choice("xy"), rng.choice([None, 1, 2]), rng.sample(kinds, rng.randrange(4)), rng.choice(levels), ["in_app"], rng.random() < 0.8) for k in range(40)]
    rows = [(k, rng.choice(["x", "y", None]), rng.randrange(3), rng.choice([*kinds, "d", None]), rng.choice([*levels, "odd", None])) for k in range(200)]
    want = {
        (c[0], r[0]) for c in rows for r in rules
        if r[6] and c[1] == r[1] and r[2] in (None, c[2]) and c[3] is not None and (not r[3] or c[3] in r[3]) and c[4] in levels and levels.index(c[4]) >= levels.index(r[4])
    }
    left = spark.createDataFrame(rows, "change_id int, organization_id string, competitor_id int, change_type string, severity string")
    right = spark.createDataFrame(rules, "rule_id int, organization_id string, competitor_id int, change_types array<string>, min_severity string, channels array<string>, is_active boolean")
    found = alerts.match(left, right)
    assert sorted((r["change_id"], r["rule_id"]) for r in found.collect()) == sorted(want) and set(left.columns) < set(found.columns)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "asked_type" in plan and "asked_severity" in plan and ("slot" in plan) == (most == 0)
