"""Quality rules with line labels: a linear-chain CRF marks each line as content or boilerplate.

The CRF's weights are trained here, on line sequences of two bounded samples.  Pages that label themselves give true line
labels: their blocks inside and outside the article.  Labelled documents give weak ones: a good document's lines are
content, but for lines that other documents repeat; a bad document's are boilerplate, but for those that read like good
documents' lines.  So labels change within a sequence.  Viterbi decoding labels every line of every whole text; the share
of words on content lines decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches
from tidemark.llm.main_text import BLOCK, read_page

SYMBOLS = "#*$%&|<>"
SYMBOL = re.compile("[#*$%&|<>]")
WINDOW = 8
FEATURES = ("bias", "words", "short", "symbols", "capitals", "digits", "shouts", "bars", "ends", "word_length", "seen", "repeats", "marks")
#: Lines that training takes as one sequence; longer documents are several.
SEQUENCE = 64

_CLASS = {name: np.zeros(128, np.uint8) for name in ("upper", "digit", "symbol", "mark", "space")}
for _c in range(128):
    _CLASS["upper"][_c], _CLASS["digit"][_c] = chr(_c).isupper(), chr(_c).isdigit()
    _CLASS["symbol"][_c], _CLASS["space"][_c] = chr(_c) in SYMBOLS, _c == 32 or 9 <= _c <= 13
    _CLASS["mark"][_c] = 33 <= _c < 127 and not chr(_c).isalnum()
#: One number per ASCII code point holds all classes, so a text is looked up once.
_BITS = sum(_CLASS[name].astype(np.uint8) << k for k, name in enumerate(_CLASS)).astype(np.uint8)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a window of eight words found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    mix = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    mix ^= mix >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        key = key * np.uint64(0x100000001B3) + mix[j : j + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    left, right = order[:-1][same], order[1:][same]
    equal = np.all([ids[left + j] == ids[right + j] for j in range(WINDOW)], axis=0)
    if not equal.all():  # two different windows share a key: compare the windows themselves
        _, at, count = np.unique(np.lib.stride_tricks.sliding_window_view(ids, WINDOW), axis=0, return_inverse=True, return_counts=True)
        twice = count[at.ravel()] > 1
    else:
        twice[left] = twice[right] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


@dataclass
class Text:
    """What one pass over a text gives: the contract's counts, and a feature row and word count per non-blank line."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    lines: np.ndarray
    line_words: np.ndarray


def read_text(text: str | None) -> Text:
    text = text or ""
    words, line_of, line_no, lines, dups, seen, fresh = [], [], 0, [], 0, set(), []
    ids: dict[str, int] = {}
    for line in text.split("\n"):
        own = [w for w in re.split("[\x20\x09-\x0d]+", line) if w] if not line.isascii() else line.encode().split()
        if own:
            again = line in seen
            seen.add(line)
            dups += again
            lines.append(line)
            fresh.append((len(own), again, len(set(own))))
            words += own if line.isascii() else [w.encode() for w in own]
    if not lines:
        return Text(0, 0, len(SYMBOL.findall(text)), 0, 0, np.zeros((0, len(FEATURES))), np.zeros(0, np.int64))
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    points = np.frombuffer("\n".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    bits = np.where(points < 128, _BITS[np.minimum(points, 127)], 0)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    starts = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    total = {name: np.add.reduceat(bits >> k & 1, starts, dtype=np.int64) for k, name in enumerate(_CLASS)}
    total["space"] -= np.append(np.ones(len(lines) - 1, np.int64), 0)  # the line feeds between
    count = {c: np.add.reduceat(points == ord(c), starts, dtype=np.int64) for c in "!|"}
    n, again, distinct = (np.array(x) for x in zip(*fresh))
    chars = np.maximum(size - total["space"], 1)
    ends = np.array([line.rstrip()[-1:] in ".!?:;\"'" for line in lines])
    rows = np.column_stack([
        np.ones(len(lines)), np.log1p(n) / 5, n < 4, total["symbol"] / chars, total["upper"] / chars, total["digit"] / chars,
        count["!"] / chars, count["|"] / n, ends, np.minimum(chars / n / 10, 3), again, 1 - distinct / n, total["mark"] / chars,
    ])
    return Text(int(n.sum()), int(sum(map(len, (w.decode() for w in words)))) if not text.isascii() else int(sum(map(len, words))), len(SYMBOL.findall(text)), dups, repeated_words(numbers), rows, n)


@dataclass
class Crf:
    """Log-potentials of a two-label chain (0 boilerplate, 1 content)."""

    emit: np.ndarray  # features x 2
    move: np.ndarray  # from x to

    def viterbi(self, rows: np.ndarray) -> np.ndarray:
        """The likeliest labels of a sequence of feature rows."""
        score = (rows @ self.emit).tolist()
        (a, b), (c, d) = self.move.tolist()
        x, y = score[0]
        back = []
        for e0, e1 in score[1:]:
            from0, from1 = y + c > x + a, y + d > x + b
            x, y = e0 + (y + c if from0 else x + a), e1 + (y + d if from1 else x + b)
            back.append((from0, from1))
        label = int(y > x)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1])


Sequence = tuple[np.ndarray, np.ndarray]


def train(sequences: list[Sequence], rounds: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Crf:
    """Maximum conditional likelihood by Adam over padded sequences of feature rows and labels."""
    most = max(len(x) for x, _ in sequences)
    rows = np.zeros((most, len(sequences), len(FEATURES)))
    live, label = np.zeros((most, len(sequences))), np.zeros((most, len(sequences)), int)
    for k, (x, y) in enumerate(sequences):
        rows[: len(x), k], live[: len(x), k], label[: len(x), k] = x, 1, y
    emit, move = np.zeros((len(FEATURES), 2)), np.zeros((2, 2))
    m1, m2 = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    lines, pairs = live.sum(), live[1:].sum()
    true_move = np.array([[(live[1:] * (label[:-1] == x) * (label[1:] == y)).sum() for y in (0, 1)] for x in (0, 1)])
    true = np.stack([live * (label == 0), live * (label == 1)], axis=2)
    for step in range(1, rounds + 1):
        e = rows @ emit
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[0] = e[0]
        for t in range(1, most):
            forward[t] = np.where(live[t, :, None] > 0, e[t] + np.logaddexp(forward[t - 1, :, :1] + move[0], forward[t - 1, :, 1:] + move[1]), forward[t - 1])
        for t in range(most - 2, -1, -1):
            ahead = e[t + 1] + backward[t + 1]
            backward[t] = np.where(live[t + 1, :, None] > 0, np.logaddexp(ahead[:, :1] + move[:, 0], ahead[:, 1:] + move[:, 1]), 0)
        whole = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
        odds = np.exp(forward + backward - whole[:, None]) * live[:, :, None]
        joint = np.exp(forward[:-1, :, :, None] + move + (e + backward)[1:, :, None, :] - whole[:, None, None]) * live[1:, :, None, None]
        grads = [np.einsum("tsf,tsy->fy", rows, true - odds) / lines - decay * emit, (true_move - joint.sum(axis=(0, 1))) / max(pairs, 1) - decay * move]
        for k, (w, g) in enumerate(zip((emit, move), grads)):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            w += rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return Crf(emit, move)


def accuracy(crf: Crf, sequences: list[Sequence]) -> float:
    """Share of lines whose Viterbi label is right."""
    right = sum(int((crf.viterbi(x) == y).sum()) for x, y in sequences)
    return right / max(sum(len(y) for _, y in sequences), 1)


def page_lines(source: str | None) -> tuple[str, np.ndarray] | None:
    """The blocks of a page as the lines of a text, and whether each is article text; None without one article element."""
    page = read_page(source)
    if page.articles != 1:
        return None
    lines, labels, part, inside = [], [], [], 0
    for kind, text, within, barred in [*zip(page.kinds, page.texts, page.inside, page.barred), ("tag p", None, False, False)]:
        if text is not None:
            part.append(text)
            inside += len(text.split()) * (1 if within and not barred else -1)
        elif kind[4:].partition(".")[0] in BLOCK:
            if line := " ".join("".join(part).split()):
                lines.append(line)
                labels.append(inside > 0)
            part, inside = [], 0
    return "\n".join(lines), np.array(labels, int)


def _rows_of(kind: str, key: int, text: str, labels: np.ndarray | None, lines: int) -> pd.DataFrame:
    found = read_text(text)
    n = min(len(found.lines), lines)
    label = labels[:n] if labels is not None else np.full(n, -1)
    return pd.DataFrame({"kind": kind, "key": key, "line_no": np.arange(n), "label": label, "x": list(found.lines[:n])})


LINES = "kind string, key long, line_no int, label int, x array<double>"


def content_chance(x: np.ndarray, label: np.ndarray, known: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Chance that each line is content, by a logistic model of the ``known`` lines alone; both labels weigh alike."""
    own, y = x[known], label[known]
    weight = np.where(y > 0, len(y) / (2 * max(y.sum(), 1)), len(y) / (2 * max(len(y) - y.sum(), 1)))
    w = np.zeros(x.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
        w += np.linalg.solve((own * (weight * p * (1 - p))[:, None]).T @ own + ridge * np.eye(len(w)), own.T @ (weight * (y - p)) - ridge * w)
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def sequences_of(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, documents: int = 2_000, page_count: int = 500, lines: int = 256) -> list[Sequence]:
    """Training sequences of at most ``documents`` labelled documents and ``page_count`` pages, those whose ids hash lowest.

    Each gives at most its first ``lines`` non-blank lines, in parts of 64.  Features are computed in tasks.  A model of
    the documents' lines alone gives lines of bad documents that read like good ones' back, and takes lines of articles
    that read like bad ones' away.  Equal doc_ids with different labels are left out, as are null labels.
    """
    small_batches(docs.sparkSession)
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    ids = ids.where("low = high").select("doc_id", F.col("low").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))

    def of_documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, text, label in zip(b["doc_id"], b["text"], b["label"]):
                yield _rows_of("good" if label > 0 else "bad", doc_id, text, None, lines)

    def of_pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for page_id, source in zip(b["page_id"], b["html"]):
                if found := page_lines(source):
                    yield _rows_of("page", page_id, *found, lines)

    rows = chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInPandas(of_documents, LINES)
    if pages is not None:
        few = pages.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(page_count)
        some = pages.join(F.broadcast(few), "page_id").groupBy("page_id").agg(F.min(F.col("html").cast("string")).alias("html"))
        rows = rows.unionByName(some.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInPandas(of_pages, LINES))
    table = rows.toPandas().sort_values(["kind", "key", "line_no"], kind="stable").reset_index(drop=True)
    if not {"good", "bad"} <= set(table["kind"]):
        return []
    x, label = np.array(table["x"].tolist()), table["label"].to_numpy().copy()
    good, bad, page = ((table["kind"] == kind).to_numpy() for kind in ("good", "bad", "page"))
    label[good], label[bad] = 1, 0
    content = content_chance(x, label, good | bad)
    label[bad & (content >= 0.5)] = 1
    label[page & (content < 0.5)] = 0
    starts = np.flatnonzero((table["key"].diff() != 0) | (table["kind"] != table["kind"].shift()) | (table["line_no"] % SEQUENCE == 0))
    return [(x[a:b], label[a:b]) for a, b in zip(starts, [*starts[1:], len(x)])]


def fit(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, **bounds: int) -> Crf | None:
    """A CRF from :func:`sequences_of` (``bounds`` are its samples' sizes); None without documents of both labels."""
    sequences = sequences_of(docs, labels, pages, **bounds)
    return train(sequences) if sequences else None


def quality_rules(docs: DataFrame, crf: Crf | None, min_content: float = 0.5) -> DataFrame:
    """The contract's counts and the verdict for every row of ``docs(doc_id, text, ...)``; other columns are ignored.

    Null and blank texts have no words and fail the base rules.  Without a trained ``crf`` the base rules decide alone
    and ``content_share`` is null.  Repeated rows give equal rows; an empty table gives none.
    """
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]

    def one(doc_id: int | None, text: str | None) -> tuple:
        t = read_text(text)
        failed = t.n_words < 20 or 100 * t.n_repeat_words > 30 * t.n_words
        share = None
        if crf is not None and t.n_words:
            share = float((crf.viterbi(t.lines) * t.line_words).sum() / t.n_words)
        return doc_id, t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, not failed and (share is None or share >= min_content), share

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(*x) for x in zip(b["doc_id"], b["text"])], columns=names).astype({"doc_id": "Int64", "content_share": "Float64"})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = ["long"] * 6 + ["boolean"] * 2 + ["double"]
    return rows.mapInPandas(work, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))
