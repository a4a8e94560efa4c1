"""Periodic runs against brute force over all periods and places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from test_operators import ODD, empty, frame

from tidemark.llm import queries, runs


def brute_runs(words, shortest=6, times=4):
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > start and end + q - start >= max(shortest, times * q):
                found.setdefault((start, end + q), q)
            start = end + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(rng, n, alphabet):
    words = [f"w{rng.randrange(alphabet)}".encode() for _ in range(n)]
    if n > 5:
        unit = [f"w{rng.randrange(3)}".encode() for _ in range(rng.randint(1, 7))]
        at = rng.randrange(n)
        words[at:at] = (unit * 12)[: rng.randint(1, 80)]
    return words


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_words(seed):
    """Several documents in one suffix array, small alphabets (nested and touching runs), other bounds."""
    rng = random.Random(seed)
    for _ in range(200):
        texts = [periodic(rng, rng.choice([0, 1, 5, 20, 60]), rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(1, 4))]
        assert runs.word_runs(texts) == [brute_runs(t) for t in texts]
        assert runs.word_runs(texts, 3, 2) == [brute_runs(t, 3, 2) for t in texts]


def test_one_word_over_and_over():
    assert runs.word_runs([[b"a"] * 200_000, [b"a", b"b"] * 50_000, []]) == [[(0, 200_000, 1)], [(0, 100_000, 2)], []]


def test_intervals():
    """Bounds of an LCP interval against a scan."""
    rng = np.random.default_rng(0)
    for _ in range(50):
        lcp = rng.integers(0, 4, 40).astype(np.int32)
        lcp[0] = 0
        at = np.flatnonzero(lcp)
        low, high = runs.intervals(lcp, at)
        for j, lo, hi in zip(at, low, high):
            want_lo, want_hi = j, j
            while lcp[want_lo - 1] >= lcp[j]:
                want_lo -= 1
            while want_hi + 1 < len(lcp) and lcp[want_hi + 1] >= lcp[j]:
                want_hi += 1
            assert (lo, hi) == (want_lo - 1, want_hi)


def test_find_runs(spark):
    rng = random.Random(9)
    rows = ODD + [(k, b" \n".join(periodic(rng, 40, 4)).decode()) for k in range(80)]
    out = runs.find_runs(frame(spark, rows))
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = []
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found = brute_runs(words) if len(words) < 10_000 else [(0, len(words), 1)]
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in found)]
        want.append((i, len(words), found, " ".join(kept)))
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert runs.find_runs(empty(spark)).count() == 0


def test_query(spark, small):
    """The registered query on whole documents, with its planted periods."""
    con = duckdb.connect()
    want = set()
    for i, text in con.execute(f"select doc_id, text from '{small}/documents.parquet'").fetchall():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        found = brute_runs(words)
        best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + m for s, m, q in found)]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.add((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(kept))))
    out = queries.QUERIES["op12_periodic_runs"](spark, small)
    assert {tuple(r) for r in out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()} == want
    assert sum(r[1] > 0 for r in want) > 5
