"""Personal data in texts: fixed kinds by pattern, and unseen identifiers by bootstrapped contexts.

All of it is DataFrame functions.  Seeds are the spans of the fixed kinds, and strings whose shape alone tells an
identifier (long, letters and digits mixed).  What stands around a seed is its lexical pattern: a word with the marks that
follow it (``token = "``), else two words, and a closing mark behind.  Patterns and the instances they introduce form a
graph, which is scored in rounds: a pattern by the mean score of its instances, plain words among them, an instance by the
patterns that introduce it.  An identifier-like string of any length that no fixed kind covers becomes a span where its
pattern has a high score that enough different seeds support.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

# The kinds' patterns.  The look-behinds and possessive quantifiers only spare the engine starts and
# retries that cannot match, so that one very long run of letters or digits is read once.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign that a text can hold the kind at all.
SIGNS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: An identifier-like string: letters, then a digit, then at least five more letters, digits, hyphens or underscores.
CANDIDATE = r"(?<![A-Za-z0-9_])[A-Za-z_]*+[0-9][A-Za-z0-9_-]{5,}+"
#: A plain word where a value is given: it speaks against its pattern.
PLAIN = r"(?<=[=:]\s?[\"'])[A-Za-z]++(?![A-Za-z0-9_-])"
#: A pattern's left side: a word with the marks after it, or two words; and the characters in which it is looked for.
MARKED, WORDS, REACH = r"\p{L}[\p{L}\p{N}_.-]*\s{0,3}[^\p{L}\p{N}\s]{1,4}\s{0,3}[\"']?$", r"\p{L}+\s+\p{L}+\s*$", 48
#: Marks that close a value.
CLOSING = "\"'`)>]}"
#: Patterns that are sent to all tasks at most; more are joined by a shuffle, each dealt over this many partitions.
BROADCAST_PATTERNS, SALTS = 50_000, 32


def _hits(text: Column, pattern: str, sign: str) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost non-overlapping matches, in code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    zipped = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("value")))
    empty = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")
    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    return F.when(F.regexp_like(text, F.lit(sign)), F.aggregate(zipped, first, step, lambda acc: acc["out"])).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) <= 3, F.concat(F.lit("0"), part(p)).cast("int") <= 255).otherwise(False))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _keeps(kind: str):
    return lambda x: _valid(kind, x["value"])


def _pattern(text: Column, start: Column, end: Column) -> Column:
    """What stands around a span, lower-cased, digits as 0: ``left|closing mark``; empty without a word before it."""
    left = F.substring(text, F.greatest(start - REACH, F.lit(0)) + 1, F.least(start, F.lit(REACH)))
    marked, words = (F.regexp_extract(left, x, 0) for x in (MARKED, WORDS))
    left = F.when(marked != "", marked).otherwise(words)
    right = F.substring(text, end + 1, F.lit(1))
    right = F.when(F.lit(CLOSING).contains(right), right).otherwise("")
    return F.when(left != "", F.concat(F.regexp_replace(F.lower(left), "[0-9]", "0"), F.lit("|"), right)).otherwise("")


def _telling(value: Column) -> Column:
    """Whether a string's shape alone tells an identifier: 20 characters or more, four letters and four digits among them."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (F.length(value) >= 20) & (digits >= 4) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4)


def _scan(docs: DataFrame) -> DataFrame:
    """Per row its spans by kind, and place, pattern and value of each seed, identifier-like string and plain value."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({k: F.filter(_hits(text, p, SIGNS[k]), _keeps(k)) for k, p in KINDS.items()})
    seen = F.concat(*[F.col(k) for k in KINDS])
    rows = rows.withColumn("base", seen).withColumns({"other": _hits(text, CANDIDATE, r"[0-9][A-Za-z0-9_-]{5}"), "plain": _hits(text, PLAIN, r"[=:]\s?[\"'][A-Za-z]")})
    rows = rows.withColumn("other", F.filter("other", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))

    def graph(col: str, seed: Callable[[Column], Column]) -> Column:
        def node(x: Column) -> Column:
            pattern = _pattern(text, x["start"], x["end"])
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), pattern.alias("pattern"), F.xxhash64(x["value"]).alias("instance"), seed(x["value"]).alias("seed"), F.lit(col == "plain").alias("plain"))

        return F.transform(col, node).alias(col)

    place = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    kinds = [F.transform(k, place).alias(k) for k in KINDS]
    edges = graph("base", lambda v: F.lit(True)), graph("other", _telling), graph("plain", lambda v: F.lit(False))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), *kinds, *edges)


def _among(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """``rows(pattern, instance, ...)`` joined with ``patterns(pattern, ...)``, which may hold a large share of the rows each."""
    if patterns.limit(BROADCAST_PATTERNS + 1).count() <= BROADCAST_PATTERNS:
        return rows.join(F.broadcast(patterns), "pattern")
    dealt = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.hash("instance"), F.lit(SALTS))).join(dealt, ["pattern", "salt"]).drop("salt")


def score_patterns(edges: DataFrame, rounds: int = 3, min_seeds: int = 5) -> DataFrame:
    """``(pattern, score, seeds)`` from ``edges(pattern, instance, seed, plain)``, one row per different pattern and instance.

    Patterns with fewer than ``min_seeds`` different seeds take no part.  A seed's score stays 1 and a plain word's 0; any
    other instance starts at 0 and then takes 1 minus the product of (1 - score) over its patterns.  A pattern's score is
    its instances' score sum over their number plus one, so that rare patterns stay low.
    """
    able = written(edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("long")).alias("seeds")).where(F.col("seeds") >= min_seeds), "able")
    edges = written(_among(edges, able), "edges")
    cur = edges.withColumn("s", F.col("seed").cast("double"))
    patterns = None
    for k in range(rounds):
        patterns = written(cur.groupBy("pattern").agg((F.sum("s") / (F.count("*") + 1)).alias("score"), F.first("seeds").alias("seeds")), "patterns")
        if k + 1 < rounds:
            miss = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))
            inst = _among(edges, patterns.select("pattern", "score")).groupBy("instance").agg((1 - F.exp(miss)).alias("i"))
            score = F.when(F.col("seed"), 1.0).when(F.col("plain"), 0.0).otherwise(F.col("i"))
            cur = written(edges.join(inst, "instance").withColumn("s", score).drop("i"), "scored")
    return patterns


def find_pii(docs: DataFrame, min_score: float = 0.6, min_seeds: int = 5, rounds: int = 3) -> DataFrame:
    """Personal data of every row of ``docs(doc_id, text, ...)``, one row each; null texts count as empty.

    Columns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id``: the fixed kinds' counts, the SHA-256 of
    their spans written ``kind:start:end`` (kinds in order, then by start, comma-joined; code points), all spans written
    the same way, and the number of spans of kind ``id``, which the contexts found.  Repeated rows give equal rows.
    """
    rows = written(_scan(docs), "pii")
    each = rows.select(F.explode(F.concat("base", "other", "plain")).alias("x")).select("x.*").where("pattern <> ''")
    edges = written(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.max("plain").alias("plain")), "graph")
    good = written(score_patterns(edges, rounds, min_seeds).where(F.col("score") >= min_score).select("pattern"), "good")
    found = _among(rows.select("doc_id", "text_hash", F.explode("other").alias("x")).select("doc_id", "text_hash", "x.*"), good)
    found = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("id"))
    both = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash")), "left")

    def written_as(kind: str, col: Column) -> Column:
        return F.transform(col, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))

    base = F.concat(*[written_as(k, F.col(f"r.{k}")) for k in KINDS])
    extra = F.coalesce(written_as("id", F.col("f.id")), F.array().cast("array<string>"))
    return both.select(
        F.col("r.doc_id").alias("doc_id"),
        *[F.size(f"r.{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, extra), ",").alias("spans"),
        F.size(extra).cast("long").alias("n_id"),
    )
