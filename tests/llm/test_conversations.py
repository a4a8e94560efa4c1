"""Conversation repair against a table of all costs and scripts, and its pieces against whole conversations."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import pytest

from tidemark.llm import conversations, queries


def brute_script(rows):
    """Least (cost, letters) over all scripts, by levels of the number of rows read."""
    steps = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})

    def closure(level):
        for _ in range(3):  # rows put in: never more than three at one place
            for q, (cost, letters) in list(level.items()):
                to = 3 if q == 2 else 2
                level[to] = min(level.get(to, (10**9, "")), (cost + 2, letters + "I"))
        return level

    level = closure({0: (0, "")})
    for initial, fault in rows:
        after = {}
        for q, (cost, letters) in level.items():
            ways = [(cost + 3, letters + "D", q)]
            if fault in ("", "truncated"):
                late = fault == "truncated"
                ways.append((cost + 2 + late, letters + "R", 3 if q == 2 else 2))
                if initial in steps[q]:
                    ways.append((cost + late, letters + "K", steps[q][initial]))
            for c, x, to in ways:
                after[to] = min(after.get(to, (10**9, "")), (c, x))
        level = closure(after)
    return min(level[q] for q in (0, 3) if q in level)


def brute(conv_rows):
    """All columns of one conversation from its sorted (turn, role, text) rows."""
    seen, faults = set(), []
    for _, role, text in conv_rows:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in conv_rows]
    cost, letters = brute_script(list(zip(initials, faults)))
    state, out, rows = 0, [], iter(conv_rows)
    for x in letters:
        role, text = ("", "") if x == "I" else next(rows)[1:]
        if x == "D":
            continue
        if x != "K":
            role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out.append(f"{role}:{text}")
    turns = [t for t, *_ in conv_rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


def made(rng, n):
    return [(rng.choice("suaaux "), rng.choice(["", "", "", "truncated", "blank", "duplicate"])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_cheapest_script(seed):
    rng = random.Random(seed)
    for _ in range(400):
        rows = made(rng, rng.randrange(14))
        cost, letters = conversations.cheapest(rows)
        assert (cost, letters) == brute_script(rows)


def test_bounds_never_exceed_costs():
    rng = random.Random(3)
    for _ in range(300):
        rows = made(rng, rng.randrange(8))
        ahead = conversations.Ahead(rows, True)
        for place in range(len(rows) + 1):
            for state in range(4):
                assert ahead.bound(place, state) <= conversations.cheapest(rows[place:], state)[0]


@pytest.mark.parametrize("roles", ["u", "a", "ua", "s", "uuaa", "usax"])
def test_long_pieces_are_solved_soon(roles):
    rng = random.Random(roles)
    for fault in (["", ""], ["", "truncated"], ["", "blank", "duplicate"]):
        rows = [(rng.choice(roles), rng.choice(fault)) for _ in range(conversations.PIECE_ROWS)]
        began = time.time()
        assert conversations.cheapest(rows) == brute_script(rows)
        for start in range(4):
            for end in range(4):
                conversations.cheapest(rows, start, end)
        assert time.time() - began < 5


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, seq string, part int")


def outcome(audits, repaired):
    sums = {r["conv_id"]: r["sha256"] for r in conversations.digests(repaired).collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv_id"]: (*(r[n] for n in names), sums[r["conv_id"]]) for r in audits.collect()}


@pytest.mark.parametrize("rows_a_piece", [128, 3, 1])
def test_repair(spark, monkeypatch, rows_a_piece):
    """Nulls, ties and repeated rows; conversations in one piece and in many, one of them over all tasks."""
    monkeypatch.setattr(conversations, "PIECE_ROWS", rows_a_piece)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", rows_a_piece == 1)
    rng = random.Random(1)
    texts = ["Fine.", "Yes!", "open", "", " \n", "why?  ", None, "é.  ", "a\nb."]
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(300)]
    rows += [(99, k, "user" if k % 3 else "assistant", f"text {k // 2}.") for k in range(120)] + [(98, 1, "user", "Hi.")] * 7
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    want = {c: brute(sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for c, v in by.items()}
    got = outcome(*conversations.repair(table_of(spark, rows).repartition(5)))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    audits, repaired = conversations.repair(table_of(spark, rows).limit(0))
    assert audits.count() == repaired.count() == conversations.digests(repaired).count() == 0


def test_query(spark, small):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    by = defaultdict(list)
    for c, t, r, x in duckdb.sql(f"select conv_id, turn, role, text from '{small}/conversations.parquet' order by conv_id, turn nulls first").fetchall():
        rows = by[c]
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if way:
            row = (t, "user" if way == 4 else r, "" if way == 1 else re.sub("[.!?]", "", x) if way == 2 else x)
            rows.extend([row] * (1 + (way == 3)))
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in queries.QUERIES["op13_conversation_repair"](spark, small).collect()}
    assert got == {c: brute(v) for c, v in by.items()}
    assert sum(v[5] > 0 for v in got.values()) > 10
