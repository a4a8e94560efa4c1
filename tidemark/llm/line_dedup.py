"""Duplicate and near-duplicate lines by a deletion-neighbourhood join; the earliest line stays.

Two lines are near when one word substituted, inserted or deleted turns one into the other.  A line's variants are the
line itself and the line without each one word, as hashed keys.  Lines that share the variant and the place of the
missing word differ in that word alone; a line that equals another's variant has one word less.  So each key needs only
its earliest line, which an aggregation finds before the shuffle: a line is dropped when an earlier line is near, and
no group's pairs are listed.  The earliest near line is then fetched and its edit distance checked.

Before variants are listed, lines that cannot have a near line are set aside: of two lines one word apart, the first or
the last half is the same, so a line none of whose halves occurs in a different line has no neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import let
from tidemark.llm.common import small_batches, written

#: Candidate lines (28 bytes each) that are sent to all tasks at most.
BROADCAST_LINES = 400_000
LAST = 2**63 - 1


def words_of(line: str) -> list[str]:
    """What lines are compared by: their lower-case words between white space."""
    return line.lower().split()


def halves_of(words: list[str]) -> list[int]:
    """Keys of a line's first and last halves, as the shorter and as the longer of two lines one word apart (four, or two and two 0).

    With q = (m - 1) div 2 words, m the shorter length, no one-word edit touches both the first and the last q words.
    """
    n = len(words)
    q, less = (n - 1) // 2, (n - 2) // 2
    digest = xxhash.xxh64_intdigest
    out = [digest(" ".join(words[:q]), 2 * q) | 1, digest(" ".join(words[n - q :]), 2 * q + 1) | 1]
    return out + ([digest(" ".join(words[:less]), 2 * less) | 1, digest(" ".join(words[n - less :]), 2 * less + 1) | 1] if less != q else [0, 0])


def _texts(docs: DataFrame) -> DataFrame:
    """``did, th, text``: the doc_id (the largest long where null), the text's hash, and the text."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), F.col("text").cast("string").alias("text"))
    return rows.select("did", F.xxhash64("text").alias("th"), "text")


HALVES = ("first0", "last0", "first1", "last1")


def lines_of(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """``did, th, line_no, h, g`` and the halves' keys (0 for none) of the lines with at least ``min_words`` words; h and g are the line's hash."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            for at in range(0, len(b), 128):
                texts = b["text"].iloc[at : at + 128].tolist()
                row, number, hashes, halves = [], [], [], []
                for i, text in enumerate(texts):
                    for k, raw in enumerate((text or "").split("\n")):
                        words = raw.lower().split()
                        if len(words) >= min_words:
                            row.append(i)
                            number.append(k)
                            hashes.append(digest(" ".join(words)))
                            halves += halves_of(words) if len(words) >= near_words else (0, 0, 0, 0)
                if row:
                    out = b[["did", "th"]].iloc[at : at + 128].iloc[row].reset_index(drop=True)
                    both = np.frombuffer(b"".join(hashes), np.int64)
                    keys = np.array(halves, np.uint64).view(np.int64).reshape(-1, 4)
                    yield out.assign(line_no=number, h=both[::2], g=both[1::2], **{c: keys[:, k] for k, c in enumerate(HALVES)})

    return _texts(docs).mapInPandas(work, "did long, th long, line_no int, h long, g long, " + ", ".join(f"{c} long" for c in HALVES))


def place_in(lines: DataFrame) -> Column:
    """A line's place in the order of all lines, as one number: a long where doc_ids and line numbers have room in one."""
    real = F.when(F.col("did") != LAST, F.col("did"))
    row = lines.agg(F.min(real).alias("low"), F.max(real).alias("high"), F.max("line_no").alias("lines")).first()
    low, high, bits = row["low"] or 0, row["high"] or 0, int(row["lines"] or 0).bit_length()
    if 0 <= low and (high + 1).bit_length() + bits < 63:
        return F.shiftleft(F.when(F.col("did") == LAST, F.lit(high + 1).cast("long")).otherwise(F.col("did")), bits) + F.col("line_no")
    return F.col("did").cast("decimal(20,0)") * F.lit(2**32).cast("decimal(11,0)") + F.col("line_no")


def fetch(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``h, g, at, line`` of the lines at ``places(did, th, line_no, h, g, at)``, in their compared form.

    The places are sent to all tasks where they are at most ``BROADCAST_LINES``; more are joined by a shuffle.
    """
    few = places.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    wanted = places.groupBy("did", "th").agg(F.collect_set(F.struct("line_no", "h", "g", "at")).alias("places"))
    found = _texts(docs).join(F.broadcast(wanted) if few else wanted, ["did", "th"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text, at in zip(b["text"], b["places"]):
                raw = text.split("\n")
                out += [(p["h"], p["g"], p["at"], " ".join(words_of(raw[p["line_no"]]))) for p in at]
            if out:
                yield pd.DataFrame(out, columns=["h", "g", "at", "line"])

    kind = places.schema["at"].dataType.simpleString()
    return found.select("text", "places").mapInPandas(work, f"h long, g long, at {kind}, line string").dropDuplicates(["h", "g"])


def variants_of(line: str) -> tuple[np.ndarray, np.uint64]:
    """Keys of the line without each word in turn, and of the whole line: polynomials of word hashes modulo 2^64."""
    words = np.array([xxhash.xxh64_intdigest(w) for w in line.split(" ")], np.uint64)
    n, base = len(words), 0x9E3779B97F4A7C15
    powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n - 1, 0), base, np.uint64))])[:n]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(pow(base, -1, 1 << 64))
    return without * np.uint64(2) + np.uint64(n - 1), (sums[-1:] * np.uint64(2) + np.uint64(n))[0]


def variants(lines: DataFrame) -> DataFrame:
    """``key, place, h, at`` of ``lines(line, h, at)``: place is -1 for the whole line, else the missing word's."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 128):
                part = b.iloc[k : k + 128]
                each = [variants_of(line) for line in part["line"]]
                size = [len(without) + 1 for without, _ in each]
                keys = np.concatenate([np.append(without, whole) for without, whole in each])
                place = np.concatenate([np.append(np.arange(s - 1), -1) for s in size])
                yield pd.DataFrame({"key": keys.view(np.int64), "place": place, "h": np.repeat(part["h"].to_numpy(), size), "at": np.repeat(part["at"].to_numpy(), size)})

    return lines.select("line", "h", "at").mapInPandas(work, f"key long, place int, h long, at {lines.schema['at'].dataType.simpleString()}")


def variant_keys(lines: DataFrame) -> DataFrame:
    """``key`` of every variant of ``lines(line)``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 128):
                yield pd.DataFrame({"key": np.concatenate([np.append(*variants_of(line)) for line in b["line"].iloc[k : k + 128]]).view(np.int64)})

    return lines.select("line").mapInPandas(work, "key long")


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether one word substituted, inserted or deleted (or none) turns line ``a`` into line ``b``."""
    swap = F.length(F.replace(a, F.lit(" "), F.lit(""))) - F.length(a) < F.length(F.replace(b, F.lit(" "), F.lit(""))) - F.length(b)
    long, short = (F.split(F.when(swap, x).otherwise(y), " ") for x, y in ((a, b), (b, a)))
    differ = F.zip_with(long, short, lambda x, y: ~x.eqNullSafe(y))
    first = F.coalesce(F.nullif(F.array_position(differ, F.lit(True)), F.lit(0)), F.size(long)).cast("int")
    rest = lambda words, start: F.slice(words, start, F.size(words) + 1)
    same = F.size(long) == F.size(short)
    return F.when(same, rest(long, first + 1) == rest(short, first + 1)).when(F.size(long) == F.size(short) + 1, rest(long, first + 1) == rest(short, first)).otherwise(False)


def near_lines(docs: DataFrame, named: DataFrame, classes: DataFrame, place: Column) -> DataFrame:
    """``h, g`` of every line of ``classes(h, g, at, halves)`` that has an earlier line one word apart; ``named`` has all lines."""
    keys = classes.where("first0 <> 0").select("h", F.explode(F.array_distinct(F.array(*HALVES))).alias("half")).where("half <> 0")
    shared = keys.groupBy("half").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("half")
    wanted = keys.join(shared, "half", "left_semi").select("h").distinct()
    few = classes.join(wanted, "h", "left_semi").select("h", "g", "at")
    # The first place of each: of rows that share a doc_id, that with the smaller text hash.
    places = named.withColumn("at", place).join(few, ["h", "g", "at"], "left_semi").groupBy("h", "g", "at", "did", "line_no").agg(F.min("th").alias("th"))
    lines = written(fetch(docs, written(places, "candidates")), "lines")
    # Most variants have one line only: those of several are found by their keys alone, before anything else is moved.
    several = variant_keys(lines).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    each = written(variants(lines).join(several, "key", "left_semi"), "variants")
    by_place = each.groupBy("key", "place").agg(F.min("at").alias("m"))
    whole, less = F.min(F.when(F.col("place") < 0, F.col("m"))), F.min(F.when(F.col("place") >= 0, F.col("m")))
    by_key = by_place.groupBy("key").agg(whole.alias("whole"), less.alias("less"))
    both = by_place.join(by_key, "key")
    earliest = F.when(F.col("place") < 0, F.col("less")).otherwise(F.least("m", "whole"))  # skips nulls
    best = both.select("key", "place", earliest.alias("near"))
    partner = each.join(best, ["key", "place"]).where("near < at").groupBy("h").agg(F.min("near").alias("near"))
    early = lines.select(F.col("at").alias("near"), F.col("line").alias("early"))
    return partner.join(lines.select("h", "g", "line"), "h").join(early, "near").where(one_word_apart(F.col("line"), F.col("early"))).select("h", "g").distinct()


def dedup_lines(docs: DataFrame, min_words: int = 5, near_words: int = 8) -> DataFrame:
    """``docs`` with duplicate lines taken out of ``text``, and ``tidemark_lines(total, dropped)``; all rows stay.

    Lines are compared by their lower-case words.  A line of ``min_words`` words or more is dropped
    if an earlier one (by doc_id, then line) equals it; one of ``near_words`` or more also if an earlier one is one word
    substitution, insertion or deletion away.  Shorter lines always stay.  Rows without a doc_id come last; rows that share
    a doc_id (or have none) do not drop each other's lines at the same place.  A null text stays null.
    """
    small_batches(docs.sparkSession)
    named = written(lines_of(docs, min_words, near_words), "named_lines")
    place = place_in(named)
    classes = written(named.groupBy("h", "g").agg(F.min(place).alias("at"), F.count("*").alias("c"), *[F.min(s).alias(s) for s in HALVES]), "line_classes")
    near = written(near_lines(docs, named, classes, place), "near_lines").withColumn("near", F.lit(True))
    several = classes.where("c > 1").select("h", "g", "at")
    drop = several.join(near, ["h", "g"], "full_outer").select("h", "g", F.col("at").alias("first"), "near")
    lines = named.select("did", "th", "line_no", "h", "g", place.alias("at"))
    gone = lines.join(drop, ["h", "g"]).where(F.col("near").isNotNull() | (F.col("at") > F.col("first")))
    gone = gone.groupBy("did", "th").agg(F.collect_set("line_no").alias("gone"))
    text = F.col("text").cast("string")
    rows = docs.withColumns({"tidemark_did": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "tidemark_th": F.xxhash64(text)})
    rows = rows.alias("d").join(gone.alias("g"), (F.col("d.tidemark_did") == F.col("g.did")) & (F.col("d.tidemark_th") == F.col("g.th")), "left")
    text = F.col("d.text").cast("string")

    def without(pieces: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("g.gone"))
        return F.array_join(F.transform(left, lambda i: F.get(pieces, i)), "\n")

    left = F.when(F.col("g.gone").isNull(), text).otherwise(let(F.split(text, "\n", -1), without))
    total = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    count = F.struct(total.cast("long").alias("total"), F.coalesce(F.size("g.gone"), F.lit(0)).cast("long").alias("dropped"))
    return rows.select(*[left.alias("text") if c == "text" else F.col(f"d.`{c}`") for c in docs.columns], count.alias("tidemark_lines"))
