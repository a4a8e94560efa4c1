"""Price column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.constants import CURRENCY_CODES, CURRENCY_SYMBOLS, PERIOD_PATTERN, PERIODS
from tidemark.functions.text import let, matches


def parse_amount(raw: Column) -> Column:
    """A localised number: the last separator is decimal, a single one before exactly three digits is for thousands.

    Null for what is no number, negative ones and ones over ten million.
    """
    drop = lambda x, s: F.replace(x, F.lit(s), F.lit(""))

    def plain(c: Column) -> Column:
        tail = F.length(F.regexp_extract(c, "[.,]([^.,]*)$", 1)) == 3
        dots, commas = F.contains(c, F.lit(".")), F.contains(c, F.lit(","))
        last_dot = F.regexp_like(c, F.lit(r"\.[^.,]*$"))
        return (
            F.when(~dots & ~commas, c)
            .when(dots & ~commas, F.when(tail, drop(c, ".")).otherwise(c))
            .when(commas & ~dots, F.when(tail, drop(c, ",")).otherwise(F.replace(c, F.lit(","), F.lit("."))))
            .when(last_dot, drop(c, ","))
            .otherwise(F.replace(drop(c, "."), F.lit(","), F.lit(".")))
        )

    def number(text: Column) -> Column:
        value = F.when(F.regexp_like(text, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)$")), text.try_cast("double"))
        return let(value, lambda v: F.when(v.between(0, 10_000_000), v))

    return let(F.regexp_replace(F.trim(raw), "[ \\u00A0]", ""), lambda c: let(plain(c), number))


def price_pattern(strict: bool = True) -> str:
    """Groups: currency before, amount; amount, currency after.  ``strict`` also reads numbers without separators whole."""
    signs = "|".join([*(s.replace("$", r"\$") for s in CURRENCY_SYMBOLS), *(rf"\b{c}\b" for c in CURRENCY_CODES)])
    whole = r"(?:\d{1,3}(?:[.,\s]\d{3})+|\d+)" if strict else r"\d{1,3}(?:[.,\s]\d{3})*"
    number = whole + r"(?:[.,]\d{1,2})?"
    return rf"(?i)({signs})\s*({number})|({number})\s*({signs})"


def currency_of(token: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in CURRENCY_SYMBOLS.items() for x in pair])
    return F.when(F.upper(token).isin(*CURRENCY_CODES), F.upper(token)).otherwise(F.coalesce(F.try_element_at(known, token), F.try_element_at(known, F.lower(token))))


def prices_in(text: Column, strict: bool = True, most: int = 60) -> Column:
    """``array<struct<amount, currency>>`` in text order, the first of equal ones, at most ``most``."""
    found = F.regexp_extract_all(text, F.lit(price_pattern(strict)), F.lit(0))

    def one(raw: Column) -> Column:
        part = lambda k: F.regexp_extract(raw, price_pattern(strict), k)
        before = part(2) != ""
        return F.struct(parse_amount(F.when(before, part(2)).otherwise(part(3))).alias("amount"), currency_of(F.when(before, part(1)).otherwise(part(4))).alias("currency"))

    good = F.filter(F.transform(found, one), lambda x: x["amount"].isNotNull() & x["currency"].isNotNull())
    return F.slice(F.array_distinct(good), 1, most)


def detected(text: Column, strict: bool = True, most: int = 60, reach: int = 90) -> Column:
    """``array<struct<raw, amount, currency, period, context, preceding>>`` of the prices in a text, the first of equal ones.

    ``context`` has ``reach`` characters on both sides, ``preceding`` those before; ``period`` is the context's first period word.
    """
    pattern = price_pattern(strict)

    def one(m: Column) -> Column:
        part = lambda k: F.regexp_extract(m["value"], pattern, k)
        before, start = part(2) != "", F.greatest(m["start"] - reach, F.lit(0))
        context = F.trim(F.substring(text, start + 1, m["end"] + reach - start))
        period = F.lower(F.concat(F.regexp_extract(context, PERIOD_PATTERN, 1), F.regexp_extract(context, PERIOD_PATTERN, 2)))
        return F.struct(
            F.trim(m["value"]).alias("raw"), parse_amount(F.when(before, part(2)).otherwise(part(3))).alias("amount"), currency_of(F.when(before, part(1)).otherwise(part(4))).alias("currency"),
            F.nullif(period, F.lit("")).alias("period"), context.alias("context"), F.trim(F.substring(text, start + 1, m["start"] - start)).alias("preceding"),
        )

    good = F.filter(F.transform(matches(text, pattern), one), lambda x: x["amount"].isNotNull() & x["currency"].isNotNull())

    def first(found: Column) -> Column:
        keys = F.transform(found, lambda x: F.struct(x["amount"], x["currency"]))
        return F.slice(let(keys, lambda k: F.filter(found, lambda x, i: F.array_position(k, F.struct(x["amount"], x["currency"])) == i + 1)), 1, most)

    return F.when(F.regexp_like(text, F.lit("[0-9]")), let(good, first)).otherwise(F.slice(good, 1, 0))


def billing_period(text: Column) -> Column:
    """The billing period that a text's first period words name; ``unknown`` without any."""
    found = F.lower(F.concat(F.regexp_extract(text, PERIOD_PATTERN, 1), F.regexp_extract(text, PERIOD_PATTERN, 2)))
    known = F.create_map(*[F.lit(x) for pair in PERIODS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_replace(found, " ", "-")), F.lit("unknown"))
