"""Periodic runs of words, by the branching-tandem test on an enhanced suffix array (suffixes, inverse, LCP values).

Stretches of words that repeat with a period show in the suffix array: a run of period q that ends before word e has exactly
one *branching* square, at e - 2q, whose two halves are suffixes of one LCP interval of depth q that part right after it.
For every LCP interval the suffixes of all its children but the largest look their neighbour a depth further, and a depth
back, up in the inverse suffix array; so n words cost O(n log n) lookups and no tree is built.  Each branching square is
then rotated to the left as far as it goes, which gives its run.

Spark deals the documents; within a task, documents are taken together up to ``TOGETHER`` words, with words told apart by
document, so that all steps are array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches

#: Words of several documents that share a suffix array; a longer document has one of its own.
TOGETHER = 1 << 17


def suffix_levels(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of ``symbols`` and, for k = 0, 1, ..., ranks by the first ``2 ** k`` symbols (equal where these are).

    A symbol that occurs once must end every part that is not to be compared across its end.  Only suffixes that are not
    told apart yet are sorted again, so text with few repeats takes few steps.
    """
    n = len(symbols)
    sa = np.argsort(symbols, kind="stable")
    ordered = symbols[sa]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = start
    levels = [rank.astype(np.int32)]
    places = np.flatnonzero(~(new & np.append(new[1:], True)))
    width = 1
    while len(places):
        at = sa[places]
        key = rank[at] * n + rank[at + width]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        sa[places] = at
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[at] = places[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        levels.append(rank.astype(np.int32))
        places = places[~(new & np.append(new[1:], True))]
        width *= 2
    return sa, levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share (a and b differ)."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        length += (levels[k][a + length] == levels[k][b + length]).astype(np.int64) << k
    return length


def common_suffix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that end right before ``a`` and before ``b`` (a smaller) and are equal."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        to = a - length - (1 << k)
        at = np.flatnonzero(to >= 0)
        same = levels[k][to[at]] == levels[k][(b - length - (1 << k))[at]]
        length[at[same]] += 1 << k
    return length


def intervals(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the LCP interval to which each boundary of ``at`` belongs (``lcp[j]`` is that of places j - 1 and j)."""
    depth, low, high = lcp[at], at.copy(), at.copy()
    least = [lcp]
    while (least[-1] > 0).any() and 2 << len(least) <= 2 * len(lcp):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    for k in range(len(least) - 1, -1, -1):
        to = low - (1 << k)
        low = np.where((to >= 0) & (least[k][np.maximum(to, 0)] >= depth), to, low)
        to = high + 1
        inside = to + (1 << k) <= len(lcp)
        high = np.where(inside & (least[k][np.where(inside, to, 0)] >= depth), high + (1 << k), high)
    return low - 1, high


def branching_squares(symbols: np.ndarray, sa: np.ndarray, levels: list[np.ndarray], longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the squares that a further symbol would end, of periods up to ``longest`` (by position)."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    first = levels[0][sa]
    at = np.flatnonzero(first[1:] == first[:-1]) + 1
    if not len(at):
        return none, none
    lcp = np.zeros(n, np.int32)
    lcp[at] = common_prefix(levels, sa[at - 1], sa[at])
    at = at[lcp[at] <= longest[sa[at]]]
    if not len(at):
        return none, none
    low, high = intervals(lcp, at)
    depth = lcp[at].astype(np.int64)
    order = np.argsort(low * (int(depth.max()) + 1) + depth, kind="stable")  # an interval's boundaries together, from left to right
    at, low, high, depth = at[order], low[order], high[order], depth[order]
    begins = np.ones(len(at), bool)
    begins[1:] = (low[1:] != low[:-1]) | (depth[1:] != depth[:-1])
    owner, heads = np.cumsum(begins) - 1, np.flatnonzero(begins)
    # An interval's children: one up to its first boundary, one from each boundary to the next.
    left = np.concatenate([low[heads], at])
    right = np.concatenate([at[heads], np.where(np.append(begins[1:], True), high + 1, np.append(at[1:], 0))])
    of = np.concatenate([np.arange(len(heads)), owner])
    size = right - left
    by_size = np.lexsort((left, -size, of))
    largest = by_size[np.flatnonzero(np.append(True, of[by_size][1:] != of[by_size][:-1]))]
    small = np.ones(len(left), bool)
    small[largest] = False
    left, size, of = left[small], size[small], of[small]
    place = np.repeat(left - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
    of = np.repeat(of, size)
    low, high, depth, i = low[heads][of], high[heads][of], depth[heads][of], sa[place]
    ahead, back = isa[i + depth], isa[np.maximum(i - depth, 0)]
    ahead = (ahead >= low) & (ahead <= high)
    back = (back >= low) & (back <= high) & (i >= depth)
    start, period = np.concatenate([i[ahead], (i - depth)[back]]), np.concatenate([depth[ahead], depth[back]])
    ends = symbols[start + period] != symbols[start + 2 * period]
    return start[ends], period[ends]


def word_runs(texts: list[list[bytes]], shortest: int = 6, times: int = 4) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs ``(start, length, period)`` by start, then period.

    A run is a stretch with smallest period q that no neighbour extends, of at least ``shortest`` words and ``times * q``.
    """
    sizes = np.array([len(t) + 1 for t in texts])
    bounds = np.append(0, np.cumsum(sizes))
    symbols = np.empty(bounds[-1], np.int64)
    longest = np.repeat((sizes - 1) // times, sizes)
    base = 0
    for words, lo, hi in zip(texts, bounds[:-1], bounds[1:]):
        known: dict[bytes, int] = {}
        symbols[lo : hi - 1] = [known.setdefault(w, len(known)) for w in words]
        symbols[lo : hi - 1] += base
        symbols[hi - 1] = base + len(known)
        base += len(known) + 1
    sa, levels = suffix_levels(symbols)
    start, period = branching_squares(symbols, sa, levels, longest)
    if times > 2:  # a longer run's square can be rotated
        turned = (start > 0) & (symbols[np.maximum(start - 1, 0)] == symbols[np.maximum(start - 1, 0) + period])
        start, period = start[turned], period[turned]
    rotations = common_suffix(levels, start, start + period)
    end = start + 2 * period
    start = start - rotations
    good = end - start >= np.maximum(shortest, times * period)
    start, end, period = start[good], end[good], period[good]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    # The same stretch again with a multiple of its period, or by the other half of its square, is no other run.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    cut = np.searchsorted(start, bounds)
    found = np.stack([start, end - start, period], axis=1)
    return [[(s - lo, n, q) for s, n, q in found[a:b].tolist()] for lo, a, b in zip(bounds.tolist(), cut[:-1], cut[1:])]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run contains after its first period."""
    if not runs:
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        inside[start + period] += 1
        inside[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(inside[:-1]) == 0)]


def find_runs(docs: DataFrame, shortest: int = 6, times: int = 4, edit: Callable[[str | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """``doc_id, n_words, runs array<struct<start, length, period>>, collapsed`` for every row of ``docs(doc_id, text, ...)``.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``runs`` (by start, then period) are those of :func:`word_runs`, ``collapsed`` the words
    outside all runs and of each run's first period, with one space between.  ``edit(doc_id as text, words)`` gives the words
    to take instead of a document's own.

    Every row gives a row, repeated ones and those of a null doc_id too; a null or blank text has no words, no runs and an
    empty ``collapsed``.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                taken, total, begin = [], 0, at
                while at < len(ids) and (not taken or total < TOGETHER):
                    words = (texts[at].as_py() or "").encode().split()
                    taken.append(edit(ids[at], words) if edit else words)
                    total += len(taken[-1])
                    at += 1
                found = word_runs(taken, shortest, times)
                kept = pa.array([b" ".join(collapse(w, r)).decode() for w, r in zip(taken, found)], pa.string())
                listed = pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in found], pa.list_(one))
                yield pa.RecordBatch.from_arrays([pa.array(ids[begin:at], pa.string()), pa.array([len(w) for w in taken], pa.int64()), listed, kept], names)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(work, "doc_id string, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
