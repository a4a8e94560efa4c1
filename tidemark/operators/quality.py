"""Admission and hygiene of rows: fetch admission, record rules, redaction of event properties."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.constants import SAFE_KEYS, SENSITIVE_PARTS

#: Levels of nesting that are searched for sensitive keys.
MOST_DEPTH = 4


def admit(pages: DataFrame, types: tuple[str, ...] = ("text/html", "application/xhtml+xml"), cap: int = 2 << 20) -> DataFrame:
    """``pages(status, content_type, html)`` with ``reject_code`` (null: accepted), the body cut at ``cap`` and ``truncated``."""
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    code = F.when(F.col("status") >= 400, F.concat(F.lit("http_"), F.col("status"))).when(~kind.isin(*types), "content_type")
    return pages.withColumns({"reject_code": code, "truncated": F.length("html") > cap, "html": F.substring("html", 1, cap)})


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition does not hold (a null condition counts as broken)."""
    return F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())


def _length(column: str, low: int, high: int, required: bool = False) -> Column:
    fits = F.length(column).between(low, high)
    return fits if required else F.col(column).isNull() | fits


def plan_rules() -> dict[str, Column]:
    """What a pricing plan ``name, amount, currency, features, highlights, source_url`` must keep to."""
    # The bounds of names, amounts, lists and texts.
    return {
        "name_length": _length("name", 1, 120, True), "amount_range": F.col("amount").isNull() | F.col("amount").between(0, 10_000_000), "currency_code": F.col("currency").isNull() | F.regexp_like("currency", F.lit("^[A-Z]{3}$")),
        "features_many": F.coalesce(F.size("features"), F.lit(0)) <= 40, "highlights_length": _length("highlights", 0, 500), "source_url_length": _length("source_url", 0, 2048),
    }


def product_rules() -> dict[str, Column]:
    """What a product ``name, description, category, features, source_url`` must keep to."""
    return {
        "name_length": _length("name", 1, 200, True), "description_length": _length("description", 0, 1000), "category_length": _length("category", 0, 80),
        "features_many": F.coalesce(F.size("features"), F.lit(0)) <= 25, "source_url_length": _length("source_url", 0, 2048),
    }


def split_valid(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The rows that keep all rules, and the others with the ``violations`` they have."""
    judged = rows.withColumn("violations", violations(rules))
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def is_sensitive(key: Column) -> Column:
    hits = F.lit(False)
    for part in SENSITIVE_PARTS:
        hits = hits | F.contains(F.lower(key), F.lit(part))
    return hits & ~F.lower(key).isin(*SAFE_KEYS)


def redacted(value, depth: int = 0):
    """A JSON value with those of sensitive keys redacted, down to ``MOST_DEPTH`` levels of nesting."""
    if depth > MOST_DEPTH:
        return value
    if isinstance(value, dict):
        return {k: "[redacted]" if _sensitive(k) else redacted(v, depth + 1) for k, v in value.items()}
    return [redacted(v, depth + 1) for v in value] if isinstance(value, list) else value


def _sensitive(key: str) -> bool:
    return key.lower() not in SAFE_KEYS and any(part in key.lower() for part in SENSITIVE_PARTS)


@F.pandas_udf(StringType())
def scrub(properties: pd.Series) -> pd.Series:
    """A JSON text with the values of sensitive keys redacted at every level; types stay.  What is no JSON is null."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(redacted(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return properties.map(one)


def audit_events(events: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Events for the audit trail: the map ``metadata`` without sensitive keys."""
    return events.withColumn(metadata, F.map_filter(metadata, lambda k, v: ~is_sensitive(k)))
