"""Repair of conversation structure by depth-first branch and bound.

A repaired conversation has roles by the pattern ``(s?(ua)+)?`` of their initials.  Each row is kept, given another role or
deleted, and rows may be put in; :func:`cheapest` searches for the script of least cost (of equal ones the least in ASCII
order) with an explicit stack: a bound on the cost of the rows ahead and the best script so far cut branches off, and a
table of the best prefix that reached each node drops worse ones.

Rows are sorted over the whole input (by conversation, then turn) and dealt in ranges, so that a conversation of any length
is spread over tasks.  A task cuts its conversations into pieces of bounded size; a piece that is a whole conversation is
solved at once, others for each state of the pattern before and after.  The pieces' costs are then put together by
conversation, which needs the scripts but no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Rows, and characters of text, of a piece at most (one row may be longer).
PIECE_ROWS, PIECE_CHARS = 128, 1 << 21
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
#: States of the pattern: 0 nothing yet, 1 after s, 2 after u, 3 after a.  The state after each initial that may follow,
#: the state after a row of the free choice (user or assistant), and what closes the pattern.
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FREE = (2, 2, 3, 2)
CLOSE = ((0, ""), (4, "II"), (2, "I"), (0, ""))
NAMES = {2: "user", 3: "assistant"}
#: The state after a whole conversation that is closed already.
CLOSED = 4


def fault_of(text: str) -> str:
    """``blank``, ``truncated`` or nothing; repeats are known elsewhere."""
    body = text.rstrip(SPACE)
    return "blank" if not body else "" if body[-1] in ".!?" else "truncated"


class Ahead:
    """Lower bounds on the cost of the rows from each place on, whatever comes before.

    Every row costs what no edit spares it: 3 if it must go, 1 if truncated.  Two rows that follow each other and cannot
    both be kept with nothing in between cost 2 more, as does a row whose role fits nowhere (of the system's rows that is
    all but one, and that one only while nothing is before it); such pairs are counted so that they do not overlap.
    """

    def __init__(self, rows: list[tuple[str, str]], close: bool):
        n = len(rows)
        self.close, self.must, self.live, alive = close, [0] * (n + 1), [0] * (n + 1), []
        for k in range(n - 1, -1, -1):
            gone = rows[k][1] in ("blank", "duplicate")
            self.must[k] = self.must[k + 1] + (3 if gone else 1 if rows[k][1] else 0)
            if not gone:
                alive.append(rows[k][0])
            self.live[k] = len(alive)
        self.initials = alive  # from the last one back: live[k] of them are ahead of place k
        self.clashes, self.systems = [0] * (len(alive) + 1), [False] * (len(alive) + 1)
        for m, initial in enumerate(alive, 1):
            self.systems[m] = self.systems[m - 1] or initial == "s"
            self.clashes[m] = self.clashes[m - 1] + (initial not in ("u", "a"))
            if m > 1 and initial == alive[m - 2]:
                self.clashes[m] = max(self.clashes[m], 1 + self.clashes[m - 2])

    def bound(self, place: int, state: int) -> int:
        m = self.live[place]
        if not m:
            return self.must[place] + (CLOSE[state][0] if self.close else 0)
        clashes = self.clashes[m] if self.initials[m - 1] in FOLLOW[state] else max(self.clashes[m], 1 + self.clashes[m - 1])
        return self.must[place] + 2 * (clashes - 1 if state == 0 and self.systems[m] else clashes)


def cheapest(rows: list[tuple[str, str]], start: int = 0, end: int = CLOSED) -> tuple[int, str] | None:
    """Cost and letters (Keep, Rerole, Delete, Insert) of the best script for ``rows(initial, fault)``; of equal costs the ASCII-least.

    The script leads from state ``start`` to state ``end``; ``CLOSED`` lets rows be put in after the last one and ends the
    pattern.  Without it the script ends with the last row's edit (None if no script reaches ``end``).
    """
    close, n = end == CLOSED, len(rows)
    ahead = Ahead(rows, close)
    best_cost, best = None, ""
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")]
    while stack:
        place, state, cost, letters = stack.pop()
        if best_cost is not None:
            least = cost + ahead.bound(place, state)
            if least > best_cost or least == best_cost and letters > best[: len(letters)]:
                continue
        if end < 2 and state > end:
            continue  # the pattern never goes back there
        known = reached.get((place, state))
        if known is not None and known <= (cost, letters):
            continue
        reached[place, state] = (cost, letters)
        if place == n and (state in (0, 3) if close else state == end):
            if best_cost is None or (cost, letters) < (best_cost, best):
                best_cost, best = cost, letters
            continue
        steps = []
        if place < n:
            initial, fault = rows[place]
            steps.append((3, "D", place + 1, state))
            if fault in ("", "truncated"):
                late = 1 if fault else 0
                if initial in FOLLOW[state]:
                    steps.append((late, "K", place + 1, FOLLOW[state][initial]))
                steps.append((2 + late, "R", place + 1, FREE[state]))
        if place < n or close:
            steps.append((2, "I", place, FREE[state]))
        for _, letter, to, then, total in sorted(((cost + c + ahead.bound(to, then), x, to, then, cost + c) for c, x, to, then in steps), reverse=True):
            stack.append((to, then, total, letters + letter))
    return None if best_cost is None else (best_cost, best)


def apply_script(rows: list[tuple[str, str]], state: int, letters: str) -> list[tuple[str, str]]:
    """The repaired ``rows(role, text)`` after ``letters`` from ``state`` on."""
    out, ahead = [], iter(rows)
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(ahead)
        if letter == "D":
            continue
        state = FOLLOW[state][role[:1]] if letter == "K" else FREE[state]
        out.append((role if letter == "K" else NAMES[state], text))
    return out


_OPTION = pa.struct([("start", pa.int8()), ("end", pa.int8()), ("cost", pa.int64()), ("letters", pa.string())])
_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("opens", pa.string()), ("ends", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("options", pa.list_(_OPTION)), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
])
_PIECE_SQL = (
    "conv_id long, part int, seq long, blank long, duplicate long, truncated long, illegal long, opens string, ends string, first_turn long, last_turn long, turns long, "
    "options array<struct<start:tinyint,end:tinyint,cost:long,letters:string>>, roles array<string>, texts array<string>"
)


def _piece(rows: list[tuple], conv_id: int | None, part: int, seq: int, known_start: bool, whole: bool) -> dict:
    """A piece's counts and scripts from its ``rows(turn, role, text, repeated)``."""
    faults = []
    for _, _, text, repeated in rows:
        fault = fault_of(text)
        faults.append("duplicate" if repeated and fault != "blank" else fault)
    initials = [r[1][:1] for r in rows]
    turns = [t for t, *_ in rows if t is not None]
    plain = list(zip(initials, faults))
    ways = [(0, CLOSED)] if whole else [(a, b) for a in ((0,) if known_start else range(4)) for b in range(4)]
    options = [{"start": a, "end": b, "cost": found[0], "letters": found[1]} for a, b in ways if (found := cheapest(plain, a, b))]
    return {
        "conv_id": conv_id, "part": part, "seq": seq, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "opens": initials[0], "ends": initials[-1], "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None, "turns": len(set(turns)), "options": options, "roles": [r[1] for r in rows], "texts": [r[2] for r in rows],
    }


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces of a task's range of sorted rows.

    A task's first conversation may have begun in the range before, and its last one may go on in the next; only the
    conversations between are known to be whole.
    """
    part, seq, done = TaskContext.get().partitionId(), 0, []
    held: list[tuple] = []
    conv, chars, opened, first_conv, last = None, 0, False, True, None

    def flush(ended: bool) -> None:
        nonlocal held, chars, seq, opened
        if held:
            start = not first_conv and not opened
            done.append(_piece(held, conv, part, seq, start, start and ended))
            held, chars, seq, opened = [], 0, seq + 1, True

    for batch in batches:
        for conv_id, turn, role, text, first in zip(*(c.to_pylist() for c in batch.columns)):
            if last is not None and conv_id != conv:
                flush(True)
                opened, first_conv, last = False, False, ()
            elif len(held) >= PIECE_ROWS or chars >= PIECE_CHARS:
                flush(False)
            conv = conv_id
            repeated = not first or last == (turn, role, text)
            last = (turn, role, text)
            held.append((turn, role, text, repeated))
            chars += len(text)
        if done:
            yield pa.RecordBatch.from_pylist(done, _PIECE)
            done.clear()
    flush(False)
    if done:
        yield pa.RecordBatch.from_pylist(done, _PIECE)


_AUDIT = pa.schema([
    ("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()),
    ("scripts", pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int64()), ("state", pa.int8()), ("letters", pa.string())]))),
])
_AUDIT_SQL = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, scripts array<struct<part:int,seq:long,state:tinyint,letters:string>>"
)


def _joined(pieces: pa.Table) -> pa.Table:
    """One conversation's counts and best script from its pieces.

    Costs are added up from the end, then the scripts are chosen from the start: of those on a cheapest way the ASCII-least.
    Scripts of equal cost for the same rows differ before either ends, so the choice by piece is the choice by the whole.
    """
    rows = sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    left = [CLOSE[q][0] for q in range(4)] + [0]
    after = [left]
    for row in reversed(rows):
        left = [None] * 4
        for o in row["options"]:
            onward = after[-1][o["end"]]
            if onward is not None and (left[o["start"]] is None or o["cost"] + onward < left[o["start"]]):
                left[o["start"]] = o["cost"] + onward
        after.append([*left, None])
    cost, state, scripts = after[-1][0], 0, []
    for row, onward in zip(rows, reversed(after[:-1])):
        final = row is rows[-1]
        ways = [(o["cost"] + onward[o["end"]], o["letters"] + (CLOSE[o["end"]][1] if final and o["end"] != CLOSED else ""), o["end"]) for o in row["options"] if o["start"] == state and onward[o["end"]] is not None]
        _, letters, then = min(ways)
        scripts.append({"part": row["part"], "seq": row["seq"], "state": state, "letters": letters})
        state = then
    turned = [r for r in rows if r["turns"]]
    distinct = sum(r["turns"] for r in turned) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(turned, turned[1:]))
    out = {
        "conv_id": rows[0]["conv_id"], "gaps": turned[-1]["last_turn"] - turned[0]["first_turn"] + 1 - distinct if turned else 0,
        "illegal": sum(r["illegal"] for r in rows) + sum(a["ends"] + b["opens"] not in LEGAL for a, b in zip(rows, rows[1:])),
        "cost": cost, "audit": "".join(s["letters"] for s in scripts), "scripts": scripts,
    } | {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")}
    return pa.Table.from_pylist([out], _AUDIT)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        conv, part, seq, roles, texts, state, letters = (c.to_pylist() for c in batch.columns)
        rows = [[{"role": r, "text": t} for r, t in apply_script(list(zip(*x)), q, s)] for *x, q, s in zip(roles, texts, state, letters)]
        yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(part, pa.int32()), pa.array(seq, pa.int64()), pa.array(rows, one)], ["conv_id", "part", "seq", "rows"])


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits, and the repaired rows, of ``conversations(conv_id, turn, role, text, ...)``; other columns are ignored.

    The audits have ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` for every conversation: turns
    missing between its first and last, rows by their first fault, neighbours whose roles may not follow each other, and the
    cheapest script (see :func:`cheapest`).  The repaired rows are ``conv_id, part, seq, rows array<struct<role, text>>``, to be
    read in order of part and seq; a piece of which nothing is left has an empty array.

    Rows go by turn (nulls first), of one turn by role and text.  A null role or text is one space, so such a text is
    blank; rows of a null conv_id are one conversation.  An empty input gives no rows.
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    rows = rows.withColumn("said", F.md5(F.to_json(F.struct("role", "text"))))
    # Where role and text were said before: only what is said at several places counts, and only its first turn is looked up.
    firsts = rows.groupBy("conv_id", "said").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
    marked = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    first = F.col("first").isNull() | (order == F.col("first")) | (F.col("turn").isNull() & ~F.col("first.known"))
    by = ("conv_id", "turn", "role", "text")
    ordered = marked.select(*by, F.coalesce(first, F.lit(False)).alias("is_first")).repartitionByRange(*by).sortWithinPartitions(*by)
    pieces = written(ordered.mapInArrow(_pieces, _PIECE_SQL), "pieces")
    whole, only = F.col("options")[0]["end"] == CLOSED, F.col("options")[0]
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    script = F.array(F.struct("part", "seq", only["start"].alias("state"), only["letters"].alias("letters"))).alias("scripts")
    at_once = pieces.where(whole).select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", only["cost"].alias("cost"), only["letters"].alias("audit"), script)
    joined = pieces.where(~whole).drop("roles", "texts").groupBy("conv_id").applyInArrow(_joined, _AUDIT_SQL)
    audits = written(at_once.unionByName(joined), "audits")
    scripts = audits.select(F.inline("scripts"))
    repaired = pieces.join(scripts, ["part", "seq"]).select("conv_id", "part", "seq", "roles", "texts", "state", "letters")
    return audits.drop("scripts"), repaired.mapInArrow(_repaired, "conv_id long, part int, seq long, rows array<struct<role:string,text:string>>")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of each conversation's repaired ``role:text`` lines, joined by line feeds.

    A task streams its conversations in order and holds one batch of pieces at a time, so a long conversation fits.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, lines, any_yet = None, None, 0, False
        for batch in batches:
            ids, sums = [], []
            for conv_id, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                if not any_yet or conv_id != conv:
                    if any_yet:
                        ids.append(conv)
                        sums.append(state.hexdigest())
                    conv, state, lines, any_yet = conv_id, hashlib.sha256(), 0, True
                if n:
                    state.update((("\n" if lines else "") + text).encode())
                    lines += n
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums, pa.string())], ["conv_id", "sha256"])
        if any_yet:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["conv_id", "sha256"])

    text = F.array_join(F.transform("rows", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    lines = repaired.select("conv_id", "part", "seq", text.alias("lines"), F.size("rows").alias("n"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.select("conv_id", "lines", "n").mapInArrow(work, "conv_id long, sha256 string")
