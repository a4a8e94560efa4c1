"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most ``2 * h`` bits apart share a variant that is at most ``h`` bits from each.  So every
distinct fingerprint stands for all its variants within ``h`` bits, variants are shuffled, and fingerprints that
collide on a variant are linked after their distance is checked.  A variant is shuffled as the block of the variant
space that holds it: a fingerprint goes to each block (the leading bits of a variant) that its ball reaches, and the
block lists the ball's variants in it.  That moves tens of rows per fingerprint instead of thousands, for the same
collisions.  Within a block a chain through each variant's fingerprints is enough to join them, so a large group of
near copies yields a spanning forest and never all its pairs.

Few bits cover only the closest copies, and now and then texts that are less alike than a stage allows.  So
:func:`keep_first` can take the links as candidates only: their shingle sets are compared, and the other pairs of texts
that are alike come from the coordinates of MinHash signatures (see :mod:`tidemark.llm.minhash`).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import minhash
from tidemark.llm.common import connected_components, small_batches, written
from tidemark.llm.shingles import shingles

#: Variants that a task lists at once; a larger block is cut by further bits first.
BLOCK_VARIANTS = 2_000_000
#: Fingerprints that a task gets as one block; a block of more is cut by ``CUT_BITS`` further bits before the shuffle.
BLOCK_ROWS, CUT_BITS = 1 << 18, 6
#: Full blocks that are sent to all tasks at most.
BROADCAST_BLOCKS = 100_000


def fingerprint(text: str | None, width: int) -> int:
    """64-bit SimHash of the lower-cased (A-Z) words' shingles of ``width`` words, each counted as often as it occurs.

    Fewer words than ``width``: the whole sequence is the only shingle.  No words or null: 0.
    """
    return of_digests(shingles(text, width))


def of_digests(digests: np.ndarray) -> int:
    """The fingerprint of a text whose shingles have these hashes."""
    if not len(digests):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(digests), 65536):
        bits = np.unpackbits(digests[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(digests), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, fp)`` for every row of ``docs``: fp is the unsigned fingerprint's bits as a long."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp.view(np.int64)})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(work, "doc_id string, fp long").withColumn("doc_id", F.col("doc_id").cast("long"))


def flips(bits: int, most: int) -> np.ndarray:
    """All masks over the low ``bits`` bits with at most ``most`` set, the empty one first."""
    out = [0]
    for k in range(1, most + 1):
        out += [sum(1 << i for i in c) for c in combinations(range(bits), k)]
    return np.array(out, np.uint64)


def _meet(fps: np.ndarray, spare: np.ndarray, low_bits: int, half: int, masks: dict[tuple[int, int], np.ndarray], odd: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions in ``fps`` that follow each other on a common variant.

    ``spare[i]`` is how many of the low bits fingerprint i may still flip in this block, the other bits being the block's.
    With ``odd``, each fingerprint on a variant is paired with the one that is nearest to the variant.
    """
    sizes = np.array([len(masks.setdefault((low_bits, k), flips(low_bits, k))) for k in range(half + 1)])
    if sizes[spare].sum() > BLOCK_VARIANTS and low_bits > 2 and len(fps) > 2:
        cut = min(4, low_bits - 2)
        top = (fps >> np.uint64(low_bits - cut)) & np.uint64((1 << cut) - 1)
        left, right = [], []
        for q in range(1 << cut):
            rest = spare - np.bitwise_count(top ^ np.uint64(q)).astype(np.int64)
            at = np.flatnonzero(rest >= 0)
            if len(at) > 1:
                a, b = _meet(fps[at], rest[at], low_bits - cut, half, masks, odd)
                left.append(at[a])
                right.append(at[b])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2
    low = fps & np.uint64((1 << low_bits) - 1)
    variants, owners, flipped = [], [], []
    for k in range(half + 1):
        at = np.flatnonzero(spare == k)
        if len(at):
            m = masks[low_bits, k]
            variants.append((low[at, None] ^ m).ravel())
            owners.append(np.repeat(at, len(m)))
            flipped.append(np.tile(np.bitwise_count(m) + half - k, len(at)) if odd else at)
    v, owner = np.concatenate(variants), np.concatenate(owners)
    order = np.lexsort((np.concatenate(flipped), v)) if odd else np.argsort(v)
    v, owner = v[order], owner[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    before = same
    if odd:
        new = np.append(True, v[1:] != v[:-1])
        before = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))[same]
    a, b = owner[before], owner[same + 1]
    pairs = np.unique(np.minimum(a, b) * np.int64(len(fps)) + np.maximum(a, b))
    return pairs // len(fps), pairs % len(fps)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position in each position's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(distinct: DataFrame, rows: int, radius: int) -> DataFrame:
    """A spanning set of edges ``(a, b)`` over the fingerprints ``distinct(fp)`` that are at most ``radius`` bits apart.

    Two fingerprints that an odd radius of ``2h - 1`` allows meet on a variant that is h bits or fewer from one and fewer than h
    from the other; so there all of a variant's fingerprints are paired with the nearest one.
    """
    half = (radius + 1) // 2
    ball = len(flips(64, half))
    bits = min(24, max(6, int(rows * ball / BLOCK_VARIANTS).bit_length()))
    masks: dict[tuple[int, int], np.ndarray] = {}

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        block, lead = np.uint64(pdf["block"].iloc[0]), int(pdf["bits"].iloc[0])
        spare = half - np.bitwise_count((fps >> np.uint64(64 - lead)) ^ block).astype(np.int64)
        a, b = _meet(fps, spare, 64 - lead, half, masks, radius % 2 == 1)
        near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        root = _roots(len(fps), a[near], b[near])
        at = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[at].view(np.int64), "b": fps[root[at]].view(np.int64)})

    blocks = in_blocks(distinct.withColumns({"block": F.lit(0).cast("long"), "bits": F.lit(0)}), bits, half)
    return blocks.groupBy("block", "bits").applyInPandas(link, "a long, b long")


def in_blocks(placed: DataFrame, more: int, half: int) -> DataFrame:
    """``fp, block, bits``: fingerprints ``placed`` in blocks of ``bits`` leading bits go to all blocks of ``more`` bits further that their ball reaches.

    Blocks that get more than ``BLOCK_ROWS`` fingerprints, as a large group of near copies makes them, are cut again; so no
    task gets an unbounded block.
    """
    bits = F.col("bits") + more
    ahead = F.shiftrightunsigned(F.expr("shiftleft(fp, bits)"), 64 - more)
    own = F.expr("if(bits = 0, 0L, shiftrightunsigned(fp, 64 - bits))")
    spare = F.lit(half) - F.bit_count(own.bitwiseXOR(F.col("block")))
    reach = F.filter(F.array(*[F.lit(int(m)) for m in flips(more, half)]), lambda m: F.bit_count(m) <= spare)
    child = F.transform(reach, lambda m: F.shiftleft("block", more).bitwiseOR(ahead.bitwiseXOR(m.cast("long"))))
    blocks = placed.select("fp", F.explode(child).alias("block"), bits.alias("bits"))
    full = written(blocks.groupBy("block").agg(F.count("*").alias("n"), F.first("bits").alias("bits")).where(F.col("n") > BLOCK_ROWS), "full_blocks")
    n, deepest = full.agg(F.count("*"), F.max("bits")).first()
    if not n or deepest + CUT_BITS > 58:
        return blocks
    full = F.broadcast(full.select("block")) if n <= BROADCAST_BLOCKS else full.select("block")
    over = written(blocks.join(full, "block", "left_semi").select("fp", "block", "bits"), "over")
    return blocks.join(full, "block", "left_anti").select("fp", "block", "bits").unionByName(in_blocks(over, CUT_BITS, half))


def _rooted(each: DataFrame, radius: int) -> DataFrame:
    """``fp, first_id, root`` of every fingerprint of ``each``: its smallest doc_id, and its component's fingerprint."""
    classes = written(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    comp = connected_components(links(classes.select("fp"), classes.count(), radius)).withColumnRenamed("node", "fp")
    return classes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs(doc_id, text, ...)``; other columns are ignored.

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest doc_id
    reachable over links, the row's own included.  Null and wordless texts have fingerprint zero and are linked like
    any other; repeated rows are all returned; a null doc_id is returned and never is the smallest (null where its
    component has no other).
    """
    small_batches(docs.sparkSession)
    each = written(fingerprints(docs, width), "fingerprints")
    rooted = _rooted(each, radius)
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(lowest, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return each.join(named, "fp").select("doc_id", text.alias("fingerprint"), "component_id")


def _described(docs: DataFrame, width: int) -> DataFrame:
    """:func:`minhash.described_rows` with the fingerprint ``fp``, in one pass over the texts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digests = [shingles(t, width) for t in b["text"]]
            n, ha, hb, sig = zip(*[minhash.described(x) for x in digests]) if len(b) else ((),) * 4
            fp = np.array([of_digests(x) for x in digests], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "n": n, "ha": ha, "hb": hb, "sig": list(sig), "fp": fp})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.md5("text"))
    out = rows.mapInPandas(work, "doc_id string, th string, n long, ha long, hb long, sig array<int>, fp long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def keep_first(docs: DataFrame, width: int = 5, radius: int = 4, percent: int = 80) -> DataFrame:
    """One row of ``docs`` per group of near duplicates: that of the smallest doc_id (null last), then text hash.

    Texts whose sets of shingles share ``percent`` of their union at least are linked, and a group is what links reach; so no
    row goes that is not so alike to another of its group.  The fingerprints' links, of at most ``radius`` bits, are tried
    first, then the pairs of :mod:`tidemark.llm.minhash`.  All texts without words are one group.
    """
    small_batches(docs.sparkSession)
    each = written(_described(docs, width), "fingerprints")
    classes = minhash.classes_of(each)
    prints = written(each.where("n > 0").select("ha", "hb", "fp").distinct().join(classes.select("ha", "hb", "id"), ["ha", "hb"]).select("id", "fp"), "prints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    near = links(distinct.select("fp"), distinct.count(), radius)
    heads = near.join(distinct.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(distinct.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    seeds = heads.union(prints.join(distinct, "fp").select("id", "first")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    roots = minhash.components(docs, classes, width, percent, seeds)
    named = classes.select("ha", "hb", "id").join(roots, "id", "left").select("ha", "hb", F.coalesce("root", "id").alias("root"))
    rows = each.select("doc_id", "th", "n", "ha", "hb").join(named, ["ha", "hb"], "left").withColumn("root", F.when(F.col("n") > 0, F.col("root")).otherwise(-1))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    first = first.select(F.col("first.none").alias("none"), F.coalesce("first.doc_id", F.lit(0)).alias("did"), F.col("first.th").alias("th"))
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    rows = docs.withColumns({"tidemark_none": F.col("doc_id").isNull(), "tidemark_did": did, "tidemark_th": F.md5(F.col("text").cast("string"))})
    match = (F.col("tidemark_none") == F.col("none")) & (F.col("tidemark_did") == F.col("did")) & F.col("tidemark_th").eqNullSafe(F.col("th"))
    return rows.join(first, match, "left_semi").dropDuplicates(["tidemark_none", "tidemark_did", "tidemark_th"]).select(docs.columns)
