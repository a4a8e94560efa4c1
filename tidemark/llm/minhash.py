"""MinHash near-duplicates by an inverted join of signature coordinates.

A text's signature holds, for each of ``COORDINATES`` hash functions, the least hash of its shingles.  Every distinct set of
shingles is posted under each of its coordinate-value pairs.  Sets that are as alike as asked agree in at least
:func:`match_floor` coordinates (but for a stated chance), so that

* values posted once are skipped, and a set left with fewer values than that has no partner at all;
* of the others only a *prefix* is merged: the values of the shortest lists, as many as a partner cannot all miss;
* a pair that meets in a list is a candidate if its signatures agree in that many coordinates, and is a link if the sets
  themselves are as alike as asked.

A list's members are not paired with each other.  Each is first compared with one head of every list that it is in, and what
that links is one component.  Where a list's members are then still in several components (pages of one template, say), its
sets are posted once more, under their rarest shingles: sets that are as alike as asked cannot share none of these.  What
still meets is compared in blocks of bounded size, and only across components, as links within one add nothing to it; a block
yields links only.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, small_batches, written
from tidemark.llm.shingles import alike, shingles

#: Coordinates of a signature.
COORDINATES = 64
#: Chance that a pair of exactly the similarity asked for agrees in too few coordinates.
MISS = 1e-6
#: Coordinates of the finer signature, of eight bits each, of sets whose lists stay in several components.
FINE = 512
#: Members of a list that a task compares with each other, or with as many others, at once.
BLOCK, BLOCK_SHINGLES = 2_048, 2_000_000
#: Orders in which the heads of lists are chosen, by list: a text meets about so many heads or more.
ORDERS = 4
_MIX = np.random.default_rng(11).integers(0, 2**63, (2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_MIX = np.random.default_rng(12).integers(0, 2**63, (2, FINE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def match_floor(percent: int, miss: float = MISS, coordinates: int = COORDINATES, chance: float = 0.0) -> int:
    """Coordinates in which two sets of that Jaccard similarity agree at least, but for the chance ``miss``.

    ``chance`` is that of coordinates that differ to look equal.
    """
    share, below = percent / 100 + (1 - percent / 100) * chance, 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * share**k * (1 - share) ** (coordinates - k)
        if below > miss:
            return k
    return coordinates


def _least(digests: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """The least value of each hash function of ``mix`` over a set's digests, mixed again."""
    low = np.full(mix.shape[1], 2**64 - 1, np.uint64)
    step = 65_536 // mix.shape[1]
    for at in range(0, len(digests), step):
        low = np.minimum(low, ((digests[at : at + step, None] ^ mix[0]) * mix[1]).min(axis=0))
    return low * np.uint64(0x9E3779B97F4A7C15)


def signature(digests: np.ndarray) -> np.ndarray:
    """The signature of a set's digests, 32 bits a coordinate; empty for an empty set."""
    if not len(digests):
        return np.zeros(0, np.int32)
    return (_least(digests, _MIX) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def fine_signature(digests: np.ndarray) -> bytes:
    """``FINE`` coordinates of eight bits."""
    return (_least(digests, _FINE_MIX) >> np.uint64(56)).astype(np.uint8).tobytes()


def described(digests: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """Size, two hashes (together the set's key) and signature of the set of ``digests``."""
    distinct = np.unique(digests)
    raw = distinct.tobytes()
    return len(distinct), *np.array([xxhash.xxh64_intdigest(raw, s) for s in (1, 2)], np.uint64).view(np.int64).tolist(), signature(distinct)


def described_rows(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, th, n, ha, hb, sig`` of every row: th is the text's MD5, the others are those of :func:`described`."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, ha, hb, sig = zip(*[described(shingles(t, width)) for t in b["text"]]) if len(b) else ((),) * 4
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "n": n, "ha": ha, "hb": hb, "sig": list(sig)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.md5("text"))
    out = rows.mapInPandas(work, "doc_id string, th string, n long, ha long, hb long, sig array<int>")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def classes_of(each: DataFrame) -> DataFrame:
    """The distinct non-empty sets of ``each(doc_id, th, n, ha, hb, sig, ...)``: ``ha, hb, id, n, sig, th, first_id``.

    th is one of the set's texts and first_id the least doc_id that has it; id is a number of its own.
    """
    sets = each.where("n > 0").groupBy("ha", "hb").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.min("th").alias("th"), F.min("doc_id").alias("first_id"))
    return written(sets.withColumn("id", F.monotonically_increasing_id()), "classes")


def posting_lists(classes: DataFrame, floor: int) -> DataFrame:
    """``id, prefix``: the sets of ``classes(id, sig)`` that may have partners, with the lists in which all of these must show.

    Values are taken from the shortest list on (then by value), the same order for all sets.
    """
    value = F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posted = classes.select("id", F.posexplode("sig").alias("k", "v")).select("id", value.alias("value"))
    lists = posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    kept = posted.join(lists, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "value")))["value"].alias("values"))
    return kept.where(F.size("values") >= floor).select("id", F.slice("values", F.lit(1), F.size("values") - floor + 1).alias("prefix"))


class Candidates:
    """Sets that may have partners, and the exact test of pairs of them."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.width, self.percent, self.floor = width, percent, match_floor(percent)
        self.sets = written(posting_lists(classes, self.floor).join(classes.select("id", "n", "sig", "th"), "id"), "candidates")
        of = self.sets.select("id", "th")
        texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("th", F.md5("text")).join(of, "th")
        self.texts = written(texts.groupBy("id").agg(F.min("text").alias("text")), "texts")
        self.tested = None

    def lists(self) -> DataFrame:
        """``value, id`` of the lists of coordinate values."""
        return self._several(self.sets.select("id", F.explode("prefix").alias("value"), F.lit(0).alias("m")))

    def rare_lists(self, of: DataFrame) -> DataFrame:
        """``value, id, n, room`` of lists of shingles for the sets ``of(id)``, each under its rarest ones.

        A set of n shingles shares ``percent`` of them at least with a set that is as alike as asked, so one of its rarest
        ``n - ceil(n * percent / 100) + 1`` is among that one's.  Shingles that are in one set only take places of these.
        ``room`` is how many of the set's shingles are not rarer: two sets share no more than the lesser room of the first
        list in which they meet.  Leaves ``id, all, fine`` of these sets, their shingles' hashes and finer signatures, in ``self.open_sets``.
        """
        width = self.width

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                every = [np.unique(shingles(t, width)) for t in b["text"]]
                yield pd.DataFrame({"id": b["id"], "all": [x.view(np.int64) for x in every], "fine": [fine_signature(x) for x in every]})

        texts = self.texts.join(of.distinct(), "id").select("id", "text")
        self.open_sets = written(texts.mapInPandas(work, "id long, all array<long>, fine binary"), "shingles")
        rows = self.open_sets.select("id", F.explode("all").alias("value"))
        shared = rows.join(rows.groupBy("value").agg(F.count("*").alias("m")).where("m > 1"), "value")
        shared = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("m", "value"))).alias("values")).join(self.sets.select("id", "n"), "id")
        places = F.size("values") - F.ceil(F.col("n") * self.percent / 100).cast("int") + 1
        taken = shared.select("id", "n", F.size("values").alias("of"), F.posexplode(F.slice("values", F.lit(1), F.greatest(places, F.lit(0)))).alias("at", "v"))
        return self._several(taken.select("v.value", "id", "n", (F.col("of") - F.col("at")).alias("room"), "v.m"))

    @staticmethod
    def _several(rows: DataFrame) -> DataFrame:
        """The lists ``rows(value, id, m, ...)`` of two members or more; of lists with the same members the first by m, then value."""
        members = rows.groupBy("value").agg(F.min("m").alias("m"), F.count("*").alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("k > 1")
        first = members.groupBy("k", "x", "y").agg(F.min(F.struct("m", "value"))["value"].alias("value")).select("value")
        return written(rows.drop("m").join(first, "value", "left_semi"), "lists")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)``, a smaller, that are as alike as asked; pairs tested before are left out."""
        pairs = pairs.distinct()
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        self.tested = pairs if self.tested is None else self.tested.union(pairs)
        x = self.sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        y = self.sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        matches = F.size(F.filter(F.zip_with("sa", "sb", lambda p, q: p == q), lambda same: same))
        near = pairs.join(x, "a").join(y, "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent) & (matches >= self.floor)).select("a", "b")
        texts = near.join(self.texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(self.texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        width, percent = self.width, self.percent

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.loc[[alike(x, y, width, percent) for x, y in zip(b["x"], b["y"])], ["a", "b"]]

        return written(texts.select("a", "b", "x", "y").mapInPandas(work, "a long, b long"), "links")


def headed(lists: DataFrame, turn: int) -> DataFrame:
    """``a, b``: each member of ``lists(value, id)`` with its list's head."""
    order = F.xxhash64("id", F.pmod("value", F.lit(ORDERS)), F.lit(turn))
    heads = lists.groupBy("value").agg(F.min(F.struct(order.alias("h"), "id"))["id"].alias("head"))
    return lists.join(heads, "value").where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))


def across(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: the members of ``lists(value, id, n, room, root)`` with different roots that are as alike as asked.

    Their room (see :meth:`Candidates.rare_lists`) has to allow it and their finer signatures in ``sets(id, all, fine)`` to agree
    in enough coordinates; then the hashes of their shingles are compared.  A list is cut into blocks of at most ``BLOCK``
    members and about ``BLOCK_SHINGLES`` shingles, and each two blocks are a task's work.
    """
    floor = match_floor(percent, coordinates=FINE, chance=1 / 256)
    sizes = lists.groupBy("value").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks"))
    rows = lists.join(sizes, "value").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("value", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "id", "root", "n", "room").join(sets, "id")

    def work(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        if len(b) < 2:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        ids, roots, own, n, room, every = (b[c].to_numpy() for c in ("id", "root", "own", "n", "room", "all"))
        sig, found = np.frombuffer(b"".join(b["fine"]), np.uint8).reshape(len(b), FINE), []
        for k in np.flatnonzero(own == key[1]):
            # Within one block each pair is met once; of two blocks the first one's members meet the second's.
            others = (roots != roots[k]) & ((own == key[2]) if key[1] != key[2] else (ids > ids[k]))
            others = np.flatnonzero(others & ((100 + percent) * np.minimum(room, room[k]) >= percent * (n + n[k])))
            for j in others[(sig[others] == sig[k]).sum(axis=1) >= floor]:
                both = len(np.intersect1d(every[k], every[j], assume_unique=True))
                if 100 * both >= percent * (n[k] + n[j] - both):
                    found.append((min(ids[k], ids[j]), max(ids[k], ids[j])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.groupBy("value", "p", "q").applyInPandas(work, "a long, b long")


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``id, root`` after ``links(a, b)``, where ids had ``roots(id, root)`` before (others were alone)."""
    if roots is None:
        return written(connected_components(links).select(F.col("node").alias("id"), "root"), "roots")
    of = lambda c: roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    tops = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    tops = connected_components(tops).select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = roots.select("id", "root").union(tops.join(roots, "root", "left_anti").select(F.col("root").alias("id"), "root"))
    return written(old.join(tops, "root", "left").select("id", F.coalesce("top", "root").alias("root")), "roots")


def _open(lists: DataFrame, roots: DataFrame, least: int = 3) -> DataFrame:
    """``lists(value, id, ...)`` with ``root``, of which are left those of ``least`` members or more with several roots."""
    rows = written(lists.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    mixed = rows.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where((F.col("low") != F.col("high")) & (F.col("n") >= least)).select("value")
    return written(rows.join(mixed, "value", "left_semi"), "open")


def components(docs: DataFrame, classes: DataFrame, width: int, percent: int, seeds: DataFrame | None = None) -> DataFrame:
    """``id, root`` of the sets of ``classes`` (see :func:`classes_of`) that are linked with others.

    Two sets are linked if they share ``percent`` of their union at least.  ``docs`` has the texts; ``seeds(a, b)``, a smaller,
    are candidate pairs from elsewhere.
    """
    found = Candidates(docs, classes, width, percent)
    lists = found.lists()
    pairs = headed(lists, 0) if seeds is None else headed(lists, 0).union(seeds)
    roots = _merged(None, found.confirmed(pairs))
    left = _open(lists, roots)
    if not left.isEmpty():
        roots = _merged(roots, found.confirmed(headed(left.select("value", "id"), 1)))
        left = _open(left.select("value", "id"), roots)
    if not left.isEmpty():
        rare = _open(found.rare_lists(left.select("id")), roots, 2)
        roots = _merged(roots, found.confirmed(across(rare, found.open_sets, percent)))
    return roots


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text, ...)``; other columns are ignored.

    Rows whose sets of distinct shingles (of ``width`` lower-cased words; of all words where there are fewer) share ``percent``
    of their union at least are linked; ``component_id`` is the smallest doc_id reachable over links, the row's own
    included, and ``kept`` is whether that is the row's own.  Links are confirmed on whole sets.

    A null or blank text has an empty set, is linked with nothing and kept.  Repeated rows are all returned.  A null doc_id is
    never the smallest: where no row of a component has one, ``component_id`` is null and its rows are kept.
    """
    small_batches(docs.sparkSession)
    each = written(described_rows(docs, width), "described")
    classes = classes_of(each)
    roots = components(docs, classes, width, percent)
    named = classes.select("ha", "hb", "id", "first_id").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(lowest, "root").select("ha", "hb", "component_id")
    rows = each.where("n > 0").select("doc_id", "n", "ha", "hb").join(named, ["ha", "hb"]).select("doc_id", "n", "component_id")
    rows = rows.unionByName(each.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
