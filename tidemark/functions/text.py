"""Text column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.constants import INJECTIONS, INVISIBLE, SEVERITIES


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of a pattern's leftmost matches, in characters from 0, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("value")))
    empty = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def normalize_name(name: Column) -> Column:
    """Lower case, punctuation as spaces, white space collapsed and trimmed."""
    plain = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def clean_text(text: Column) -> Column:
    """White space collapsed and trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit(""))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def rank_of(name: Column, order: tuple[str, ...] = SEVERITIES) -> Column:
    """Position of ``name`` in ``order``; null for a name outside it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), name), F.lit(0)) - 1


def format_price(amount: Column, currency: Column) -> Column:
    """``EUR 49.5``; ``custom pricing`` without an amount."""
    cents = F.floor(amount * 100 + 0.5).cast("long")
    number = F.regexp_replace(F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")), r"\.?0+$", "")
    return F.when(amount.isNull(), F.lit("custom pricing")).otherwise(F.concat_ws(" ", currency, number))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' word sets: 1 if both are empty, 0 if one is."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    both = F.size(F.array_intersect(x, y)).cast("double") / F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(both)


def injection_flags(text: Column) -> Column:
    """Names of the patterns of texts that address a model."""
    hits = [F.when(F.regexp_like(text, F.lit(p)), F.lit(name)) for name, p in INJECTIONS.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Texts in Unicode's compatibility composition; Spark has no function for it."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def sanitize(text: Column, most: int) -> Column:
    """``struct<text, flags, original_length, truncated>``: the text made harmless and cut, and which patterns the original has."""

    def whole(clean: Column) -> Column:
        return F.struct(F.substring(clean, 1, most).alias("text"), injection_flags(text).alias("flags"), F.length(text).alias("original_length"), (F.length(clean) > most).alias("truncated"))

    return let(defang(nfkc(text)), whole)


def defang(text: Column) -> Column:
    """Text with invisible and control characters gone, and fences, role markers, tool tags and long repeats made harmless."""
    for pattern, put in (
        (INVISIBLE, ""), (r"[\p{C}&&[^\t\n]]", ""), (r"(?i)</?\s*untrusted_content[^>]*>", "[removed-tag]"),
        (r"(?im)^\s*(system|assistant|human|user)\s*:", "[$1]"), (r"(?i)<\s*/?\s*(tool_use|tool_result|function_calls)\b", "[removed-tag]"),
        (r"(.)\1{40,}", "$1$1$1"), (r"\n{4,}", "\n\n\n"),
    ):
        text = F.regexp_replace(text, pattern, put)
    return F.trim(text)


def clean_tags(tags: Column, most: int = 12) -> Column:
    """Trimmed to 40 characters, the first of equal ones (ignoring case), at most ``most``."""
    short = F.filter(F.transform(tags, lambda t: F.substring(F.trim(t), 1, 40)), lambda t: t != "")
    first = F.filter(short, lambda t, i: F.array_position(F.transform(short, F.lower), F.lower(t)) == i + 1)
    return F.slice(first, 1, most)
