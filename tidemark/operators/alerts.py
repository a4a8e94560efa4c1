"""Alert rules: cleaning, matching with changes, and one notification per match and channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.constants import SEVERITIES
from tidemark.functions.text import rank_of

#: Rules that are sent to all tasks at most; more are joined by a shuffle.
BROADCAST_RULES = 20_000
#: Parts over which an organisation's rules of one type and severity are dealt in that shuffle.
SLOTS = 8
#: Stands for any type.
ANY = "*"


def clean_rules(rules: DataFrame, types: list[str], channels: list[str]) -> DataFrame:
    """Allow-listed change types and channels; no channel means in_app; webhooks without a URL are violations."""
    chosen = F.array_intersect("channels", F.array(*map(F.lit, channels)))
    rules = rules.withColumns({"change_types": F.array_intersect("change_types", F.array(*map(F.lit, types))), "channels": F.when(F.size(chosen) == 0, F.array(F.lit("in_app"))).otherwise(chosen)})
    return rules.withColumn("violation", F.when(F.array_contains("channels", "webhook") & F.col("webhook_url").isNull(), "webhook_url_missing"))


def indexed(rules: DataFrame) -> DataFrame:
    """Active rules as rows ``organization_id, asked_type, asked_severity, ..., slot``: one for each type and severity that meets them.

    A rule without types has one row per severity with the type ``*``; severities are the fixed few, so a rule has at most
    that many rows per type.  A change then meets a rule by equality alone.
    """
    r = rules.where("is_active").select("rule_id", "organization_id", F.col("competitor_id").alias("rule_competitor"), "change_types", "min_severity", "channels")
    types = F.when(F.size("change_types") > 0, F.array_distinct("change_types")).otherwise(F.array(F.lit(ANY)))
    levels = F.filter(F.array(*map(F.lit, SEVERITIES)), lambda s: rank_of(s) >= rank_of(F.col("min_severity")))
    r = r.withColumn("asked_type", F.explode(types)).withColumn("asked_severity", F.explode(levels))
    return r.withColumn("slot", F.pmod(F.xxhash64("rule_id"), F.lit(SLOTS)))


def match(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """``changes(change_id, organization_id, competitor_id, change_type, severity)`` with each active rule that asks for them.

    An equality join on organisation, type (or any), severity and a slot: rules are dealt over ``SLOTS`` slots and each change
    goes to all of them, so a large organisation's rules of one kind are several tasks' work.  The competitor is checked
    last.  Few rules are sent to all tasks; their number is checked.  A change without one of these fields meets no rule.
    """
    r = rules.where("is_active")
    few = r.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    r = indexed(rules)
    kinds = F.explode(F.array_distinct(F.array(F.col("change_type"), F.lit(ANY)))).alias("asked_type")
    asked = changes.select("*", F.col("severity").alias("asked_severity"), kinds).where("change_type is not null")
    if few:
        found = asked.join(F.broadcast(r.drop("slot")), ["organization_id", "asked_type", "asked_severity"])
    else:
        slots = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))).alias("slot")
        found = asked.select("*", slots).join(r, ["organization_id", "asked_type", "asked_severity", "slot"]).drop("slot")
    own = F.col("rule_competitor").isNull() | (F.col("rule_competitor") == F.col("competitor_id"))
    return found.where(own).drop("asked_type", "asked_severity")


def notifications(matches: DataFrame) -> DataFrame:
    """The outbox: one pending row per change, rule and channel, its id a hash of the three."""
    rows = matches.select("change_id", "rule_id", "organization_id", F.explode("channels").alias("channel"))
    return rows.withColumns({"notification_id": F.sha2(F.concat_ws("~", "change_id", "rule_id", "channel"), 256), "status": F.lit("pending"), "attempts": F.lit(0)})


def recipients(users: DataFrame, memberships: DataFrame) -> DataFrame:
    return memberships.join(users, "user_id").where("email is not null and email <> ''").select("organization_id", "user_id", "email").distinct()


def after_delivery(outbox: DataFrame, results: DataFrame, most: int = 3) -> DataFrame:
    """``outbox(notification_id, status, attempts)`` after ``results(notification_id, ok)``: sent, failed after ``most`` attempts, or still pending.

    Rows are in the outbox before they are delivered; what is sent already and what was not tried stays as it is.
    """
    rows = outbox.join(results.groupBy("notification_id").agg(F.bool_or("ok").alias("ok")), "notification_id", "left")
    tried = (F.col("status") == "pending") & F.col("ok").isNotNull()
    n = F.when(tried, F.col("attempts") + 1).otherwise(F.col("attempts"))
    status = F.when(~tried, F.col("status")).when(F.col("ok"), "sent").when(n >= most, "failed").otherwise("pending")
    return rows.select("notification_id", status.alias("status"), n.alias("attempts"))


def addressed(matches: DataFrame, recipients: DataFrame) -> DataFrame:
    """Each organisation's matches by e-mail with all of its recipients: a row per change, rule and recipient."""
    mail = matches.where(F.array_contains("channels", "email")).select("change_id", "rule_id", "organization_id")
    return mail.join(recipients, "organization_id")


def mail_totals(changes: DataFrame, rules: DataFrame, recipients: DataFrame) -> DataFrame:
    """``organization_id, mails, people``: how many mails the matches of changes and e-mail rules make, and to how many addresses.

    The same as counting a row per change, rule and address, but none is made: changes are counted by what rules ask for,
    rules by what they ask, and an organisation's addresses once; the counts are multiplied.
    """
    kinds = F.explode(F.array_distinct(F.array(F.col("change_type"), F.lit(ANY)))).alias("asked_type")
    told = changes.where("change_type is not null").groupBy("organization_id", "competitor_id", "change_type", F.col("severity").alias("asked_severity")).agg(F.count("*").alias("n"))
    told = told.select("organization_id", "competitor_id", kinds, "asked_severity", "n")
    keys = ["organization_id", "asked_type", "asked_severity"]
    asked = indexed(rules.where(F.array_contains("channels", "email"))).groupBy(*keys, "rule_competitor").agg(F.count("*").alias("m"))
    own = told.join(asked.where("rule_competitor is not null").withColumnRenamed("rule_competitor", "competitor_id"), [*keys, "competitor_id"])
    all_ = told.join(asked.where("rule_competitor is null").drop("rule_competitor"), keys)
    each = [df.select("organization_id", (F.col("n") * F.col("m")).alias("matches")) for df in (own, all_)]
    matches = each[0].unionByName(each[1]).groupBy("organization_id").agg(F.sum("matches").alias("matches"))
    people = recipients.select("organization_id", "email").distinct().groupBy("organization_id").agg(F.count("*").alias("people"))
    return matches.join(people, "organization_id").select("organization_id", (F.col("matches") * F.col("people")).alias("mails"), "people")
