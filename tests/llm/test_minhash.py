"""MinHash links against brute force over all pairs of texts, with many lists, few blocks, templates and chains."""

from __future__ import annotations

from collections import Counter
from math import comb

import duckdb
import numpy as np
import pytest
import xxhash
from test_operators import ODD, edited, empty, frame, prose

from tidemark.llm import minhash, queries, simhash
from tidemark.llm.shingles import alike, shingle_texts


def sets_of(rows, width=5):
    return [set(zip(*[(w := (t or "").encode().lower().split())[i:] for i in range(width)])) or {tuple(w)} - {()} for _, t in rows]


def brute_labels(rows, percent, width=5):
    """The first row of each row's component, from the sizes of all pairs' common parts; and the sets' sizes."""
    sets = sets_of(rows, width)
    number = {x: k for k, x in enumerate(set().union(*sets))}
    held = np.zeros((len(rows), len(number)), np.float32)
    for k, s in enumerate(sets):
        held[k, [number[x] for x in s]] = 1
    both, sizes = (held @ held.T).round().astype(np.int64), np.array([len(s) for s in sets])
    near = (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) | np.eye(len(rows), dtype=bool)
    label = np.arange(len(rows))
    while not (label == (new := np.where(near, label, len(rows)).min(axis=1))).all():
        label = new
    return label.tolist(), sizes.tolist()


def wanted(rows, percent=85):
    label, sizes = brute_labels(rows, percent)
    low = {c: min((rows[i][0] for i in range(len(rows)) if label[i] == c and rows[i][0] is not None), default=None) for c in set(label)}
    return Counter((i, n, low[c], i == low[c]) for (i, _), n, c in zip(rows, sizes, label))


def templated(k, own):
    """A page of 160 words, of which the last ``own`` are its own."""
    return f"{prose(1, 160 - own)} {prose(10_000 + k, own)}"


@pytest.mark.parametrize("block", [2_048, 4])
def test_near_duplicates(spark, monkeypatch, block):
    """Single edits to one in three shingles, pages of a template (not alike, and alike), and a chain of small steps."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = ODD + [(k, edited(k, 0)) for k in range(30)] + [(100 + k, edited(k, k % 10)) for k in range(30)]
    rows += [(200 + k, templated(k, 30)) for k in range(40)] + [(300 + k, templated(500 + k // 2, 30) + f" end{k}") for k in range(40)] + [(400 + k, templated(k, 9)) for k in range(30)]
    words = prose(77, 300).split()
    rows += [(500 + k, " ".join(words[6 * k : 6 * k + 120])) for k in range(30)]
    out = minhash.near_duplicates(frame(spark, rows))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert Counter(tuple(r) for r in out.collect()) == wanted(rows)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_templates_lose_no_link(spark):
    """1,200 pages that share most of one template, in pairs that are 88 to 93 % alike: each pair is found, and no others."""
    rows = [(k, f"{prose(1, 150)} {prose(20_000 + k // 2, 24)}" + (f" own{k}" * (1 + k // 2 % 6) if k % 2 else "")) for k in range(1_200)]
    got = Counter(tuple(r) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == wanted(rows)
    assert sum(not r[3] for r in got) > 500
    label, _ = brute_labels(rows, 80)
    kept = {r["doc_id"] for r in simhash.keep_first(frame(spark, rows), 5, 4, 80).collect()}
    assert kept == {min(i for (i, _), c in zip(rows, label) if c == k) for k in set(label)}


def test_signatures_agree_as_sets_do():
    """Coordinates agree as often as the similarity says, with no more spread than independent ones."""
    rng = np.random.default_rng(5)
    for share in (0.85, 0.5):
        seen = []
        for _ in range(300):
            pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
            only = round(400 * (1 - share) / 2)
            seen.append((minhash.signature(pool[only:]) == minhash.signature(pool[: 400 - only])).sum())
        spread = (minhash.COORDINATES * share * (1 - share)) ** 0.5
        assert abs(np.mean(seen) - minhash.COORDINATES * (1 - 2 * only / 400)) < 5 * spread / 300**0.5
        assert np.std(seen) < 1.15 * spread


def test_floor():
    for percent in (80, 85, 95):
        floor, p, n = minhash.match_floor(percent), percent / 100, minhash.COORDINATES
        below = lambda k: sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k))
        assert below(floor) <= minhash.MISS < below(floor + 1)


def test_alike():
    a, b = " ".join(f"w{k}" for k in range(24)), " ".join(f"w{k}" for k in range(27))
    assert len(set(shingle_texts(a, 5))) == 20 and alike(a, b, 5, 86) and alike(a, b, 5, 85) and not alike(a, b, 5, 87)
    assert not alike("", "", 5, 0) and alike("A b", "a B", 5, 100)


def test_query(spark, small):
    """The registered query against brute force over all documents."""
    rows = duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall()
    got = Counter(tuple(r) for r in queries.QUERIES["op11_minhash_near_dedup"](spark, small).collect())
    assert got == wanted(rows)
    assert any(not r[3] for r in got)


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5, 6])
def test_simhash_of_any_radius(spark, radius):
    """Components of fingerprints that walk away from some centres bit by bit, against all pairs."""
    rng = np.random.default_rng(radius)
    fps = []
    for centre in rng.integers(0, 2**63, 12, dtype=np.uint64):
        at = centre
        for _ in range(25):
            fps.append(at)
            at = (at if rng.random() < 0.6 else centre) ^ np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 64, radius + rng.integers(0, 3), dtype=np.uint64))
    fps = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    comp = {r["node"]: r["root"] for r in minhash.connected_components(simhash.links(df, len(fps), radius)).collect()}
    near, label = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius, np.arange(len(fps))
    while not (label == (new := np.array([label[n].min() for n in near]))).all():
        label = new
    got = [comp.get(int(x), int(x)) for x in fps.view(np.int64)]
    assert len(set(zip(got, label.tolist()))) == len(set(got)) == len(set(label.tolist()))


def test_keys_are_of_sets():
    """Order and repeats of shingles make no difference to a set's key."""
    x = np.array([xxhash.xxh64_intdigest(str(k)) for k in range(50)], np.uint64)
    a, b = minhash.described(x), minhash.described(np.concatenate([x[::-1], x[:5]]))
    assert a[:3] == b[:3] and (a[3] == b[3]).all() and minhash.described(x[:49])[:3] != a[:3]
