"""Benchmark passages in documents, by latent semantic retrieval and checks of order and answer.

Terms are the benchmark's words.  Every text is read once, as the numbers of its words' terms.  From these, one pass gives
the passages' document frequencies and a second their weighted Gram matrix times a random test matrix (the Nystroem form
of the randomised singular value decomposition of the TF-IDF passages).  In the latent space that results, windows of
every text are compared with the benchmark's items by cosine.  Close windows are then checked: the longest common
subsequence of words must cover most of the item, or enough of it with its answer.

A window gets a vector only where it holds so many of an item's rarest words that it could pass the check at all, which an
inverted index of these words tells; that spares vectors and loses no leak.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, written

#: Words per passage in the decomposition.
PASSAGE = 32
#: IDF that a term has at least: no share of the passages takes a leak's words away.
LEAST_IDF = 0.05
#: ASCII marks, and other marks and white space: they part words.
MARKS = bytes.maketrans(b"\"'`.,;:!?()[]{}<>*#$%&|/\\-_=+~^@\x1c\x1d\x1e\x1f", b" " * 36)
OTHER_MARKS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000«»“”‘’…¿¡]")
#: Documents that a task works on at once.
DOCUMENTS = 256
#: Cells of a task's Gram matrix; with more terms, columns are combined by random signs.
CELLS = 1 << 20


def plain(text: str | None) -> bytes:
    """The text lower-cased in UTF-8, with spaces in place of marks: what stands between white space is a word."""
    text = (text or "").lower()
    if not text.isascii():
        text = OTHER_MARKS.sub(" ", text)
    return text.encode("utf-8", "replace").translate(MARKS).strip()


def words_of(text: str | None) -> list[str]:
    return plain(text).decode().split()


def answer_of(text: str | None) -> list[str]:
    """An item's answer: the words of its last sentence of three words or more, but at most its last third."""
    words = words_of(text)
    for sentence in reversed(re.split(r"(?<=[.!?])\s+", (text or "").strip())):
        if len(last := words_of(sentence)) >= 3:
            return last[-max(3, len(words) // 3) :]
    return words[-3:]


@dataclass
class Benchmark:
    """One block of the benchmark: its terms, and its items' words and answers."""

    items: list[tuple[int, list[str], list[str]]]
    terms: dict[str, int]

    @classmethod
    def of(cls, rows: list) -> Benchmark:
        items = [(r["item_id"], words_of(r["text"]), answer_of(r["text"])) for r in rows]
        items = [x for x in items if x[1]]
        return cls(items, {w: k for k, w in enumerate(sorted({w for _, words, _ in items for w in words}))})


def term_numbers(terms: dict[str, int], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' terms one after another (words that are no terms get the number of terms), and the number of words of each."""
    words = pc.ascii_split_whitespace(pa.array([plain(t) or None for t in texts], pa.binary()).cast(pa.string()))
    size = pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    found = pc.index_in(words.flatten(), value_set=pa.array(list(terms), pa.string()))
    return found.fill_null(len(terms)).to_numpy(zero_copy_only=False), size


def _pieces(size: np.ndarray, length: int) -> np.ndarray:
    """For each word of texts of ``size`` words, one after another, the number of its piece of ``length`` words; pieces do not cross texts."""
    count = -(-size // length)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.repeat(np.cumsum(count) - count, size) + within // length


def numbered(docs: DataFrame, bench: Benchmark) -> DataFrame:
    """``doc_id, th, ids`` of every text with its words' terms (th is the text's hash), and ``term, n``: each task's document frequencies.

    ``ids`` are unsigned integers of 16 bits (32 where there are more terms).  Term number ``len(terms)`` stands for all
    other words; its n counts the passages.
    """
    terms, other = bench.terms, len(bench.terms)
    kind = _kind(other)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(other + 1, np.int64)
        for b in batches:
            for at in range(0, len(b), DOCUMENTS):
                part = b.iloc[at : at + DOCUMENTS]
                ids, size = term_numbers(terms, part["text"].tolist())
                if len(ids):
                    piece = _pieces(size, PASSAGE)
                    order = np.argsort(ids.astype(kind), kind="stable")  # short numbers are sorted by digits
                    term, piece_of = ids[order], piece[order]
                    new = np.append(True, (term[1:] != term[:-1]) | (piece_of[1:] != piece_of[:-1]))
                    df[:other] += np.bincount(term[new], minlength=other + 1)[:other]
                    df[other] += piece[-1] + 1
                ends, ids = np.cumsum(size).tolist(), ids.astype(kind)
                yield pd.DataFrame({"doc_id": part["doc_id"], "th": part["th"], "ids": [ids[e - n : e].tobytes() for n, e in zip(size.tolist(), ends)]})
        yield pd.DataFrame({"term": np.arange(other + 1), "n": df})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in work(batches):
            out = out.reindex(columns=["doc_id", "th", "ids", "term", "n"])
            yield out.astype({"doc_id": "Int64", "th": "Int64", "term": "Int64", "n": "Int64"})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    return written(rows.mapInPandas(whole, "doc_id long, th long, ids binary, term int, n long"), "numbered")


def _kind(terms: int) -> str:
    return "<u2" if terms < 65_535 else "<u4"


def _joined(ids: list[bytes], terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of texts one after another, and the number of words of each."""
    kind = np.dtype(_kind(terms))
    size = np.fromiter((len(x) // kind.itemsize for x in ids), np.int64, len(ids))
    return np.frombuffer(b"".join(ids), kind).astype(np.int64), size


def _test_matrix(terms: int, rank: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((terms, rank))


def sketch(texts: DataFrame, idf: np.ndarray, rank: int) -> np.ndarray:
    """The TF-IDF passages' Gram matrix times the test matrix, a row per term.

    A task counts the pairs of terms in its passages, weights them and sends one row per term; Spark adds the tasks' rows.
    """
    n = len(idf)
    width = n if n * n <= CELLS else max(rank, CELLS // n)
    columns = [f"z{k}" for k in range(rank)]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(5)
        column, sign = (np.arange(n), np.ones(n)) if width == n else (rng.integers(0, width, n), rng.choice([-1.0, 1.0], n))
        gram, alone = np.zeros(n * width), np.zeros(n)
        for b in batches:
            for at in range(0, len(b), DOCUMENTS):
                ids, size = _joined(b["ids"].iloc[at : at + DOCUMENTS].tolist(), n)
                known = np.flatnonzero(ids < n)
                t, piece = ids[known], _pieces(size, PASSAGE)[known]
                alone += np.bincount(t, minlength=n)
                for d in range(1, min(PASSAGE, len(t))):
                    near = np.flatnonzero(piece[d:] == piece[:-d])
                    x, y = t[near], t[near + d]
                    np.add.at(gram, x * width + column[y], sign[y])
                    np.add.at(gram, y * width + column[x], sign[x])
        test = _test_matrix(n, rank) * idf[:, None]
        small = np.zeros((width, rank))
        np.add.at(small, column, test * sign[:, None])
        z = gram.reshape(n, width) @ small
        out = pd.DataFrame((z + alone[:, None] * test) * idf[:, None], columns=columns)
        out.insert(0, "term", np.arange(n))
        yield out

    rows = texts.select("ids").mapInPandas(work, "term int, " + ", ".join(f"{c} double" for c in columns))
    total = rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in columns]).toPandas().sort_values("term")
    return total[columns].to_numpy() if len(total) else np.zeros((n, rank))


def latent_space(idf: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Each term's latent vector times its IDF; the last row, for all other words, is zero.

    Axes keep a fourth root of their spread, so that those of frequent words do not rule the cosine.
    """
    core = _test_matrix(*z.shape).T @ z
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > max(values.max(), 0) * 1e-9 if len(values) else np.zeros(0, bool)
    out = np.zeros((len(idf) + 1, z.shape[1]))
    if good.any():
        space, spread, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
        out[:-1, : space.shape[1]] = idf[:, None] * space / np.maximum(spread, spread.max() * 1e-6) ** 0.75
    return out


def common_length(words: list[int], masks: dict[int, int]) -> int:
    """Length of the longest common subsequence of ``words`` and the words whose positions ``masks`` holds."""
    row = 0
    for w in words:
        if at := masks.get(w):
            x = row | at
            row = x & ~(x - (row << 1 | 1))
    return row.bit_count()


def masks_of(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def rare_words(words: list[int], df: np.ndarray, partial: float) -> tuple[list[int], int]:
    """An item's rarest eleven twentieths of words, and how many of them a window with ``partial`` of all its words has at least."""
    need = math.ceil(partial * len(words))
    rare = sorted(words, key=lambda w: (df[w], w))[: max(-(-11 * len(words) // 20), len(words) - need + 1)]
    return rare, need - (len(words) - len(rare))


@dataclass
class Index:
    """The items' words, their rarest ones by term, and their latent vectors."""

    length: np.ndarray
    masks: list[tuple[dict[int, int], dict[int, int], int]]
    first: np.ndarray  # where each term's items begin in ``items``
    items: np.ndarray
    least: np.ndarray
    words: np.ndarray  # a row per item, filled up with -1
    need: np.ndarray
    vectors: np.ndarray
    space: np.ndarray

    @classmethod
    def of(cls, bench: Benchmark, df: np.ndarray, space: np.ndarray, partial: float) -> Index:
        numbers = [([bench.terms[w] for w in words], [bench.terms[w] for w in last]) for _, words, last in bench.items]
        rare = [rare_words(words, df, partial) for words, _ in numbers]
        pairs = np.array(sorted({(t, k) for k, (words, _) in enumerate(rare) for t in words}), np.int64)
        vectors = np.array([space[words].sum(axis=0) for words, _ in numbers])
        length = np.array([len(words) for words, _ in numbers])
        table = np.full((len(length), length.max()), -1, np.int64)
        for k, (words, _) in enumerate(numbers):
            table[k, : len(words)] = words
        return cls(
            length, [(masks_of(words), masks_of(last), len(last)) for words, last in numbers],
            np.searchsorted(pairs[:, 0], np.arange(len(bench.terms) + 2)), pairs[:, 1], np.array([n for _, n in rare]), table, np.ceil(partial * length),
            vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12), space,
        )

    def strides(self) -> np.ndarray:
        """Windows of an item start at multiples of half its length and are two and a half times as long."""
        return np.maximum(self.length // 2, 1)

    def windows(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Item, text, begin and end of every window that has the least number of the item's rarest words."""
        n_items = self.first[ids + 1] - self.first[ids]
        at = np.flatnonzero(n_items)
        count = n_items[at]
        own = np.repeat(at, count)
        item = self.items[np.repeat(self.first[ids[at]] - (np.cumsum(count) - count), count) + np.arange(len(own))]
        order = np.argsort(item, kind="stable")
        item, own = item[order], own[order]
        text = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        last = np.minimum(np.arange(len(own)) + self.least[item] - 1, max(len(own) - 1, 0))
        enough = (np.arange(len(own)) + self.least[item] <= len(own)) & (item[last] == item)
        hit = np.flatnonzero(enough)
        a, b = own[hit], own[last[hit]]
        near = (text[a] == text[b]) & (b - a < 2 * self.length[item[hit]] + self.strides()[item[hit]])
        hit, a, b = hit[near], a[near], b[near]
        item, doc, stride = item[hit], text[a], self.strides()[item[hit]]
        a, b = a - start[doc], b - start[doc]
        reach = 2 * self.length[item] + stride
        low, high = np.maximum(-(-(b + 1 - reach) // stride), 0), a // stride
        found = [np.column_stack([item, doc, (low + j) * stride])[low + j <= high] for j in range(int((high - low).max(initial=-1)) + 1)]
        item, doc, begin = np.unique(np.concatenate(found), axis=0).T if found else np.zeros((3, 0), np.int64)
        end = np.minimum(begin + 2 * self.length[item] + self.strides()[item], size[doc]) + start[doc]
        out = item, doc, begin + start[doc], end
        keep = [self._enough(ids, *(x[k : k + 256] for x in (item, out[2], end))) for k in range(0, len(item), 256)]
        return tuple(x[np.concatenate(keep)] for x in out) if keep else out

    def _enough(self, ids: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Which windows hold so many of their item's words that the common subsequence can be long enough, whatever the order."""
        at = begin[:, None] + np.arange((end - begin).max())
        there = np.where(at < end[:, None], ids[np.minimum(at, len(ids) - 1)], len(self.space))
        count = np.zeros(len(item), np.int64)
        for k in range(0, self.words.shape[1], 16):
            count += (self.words[item, k : k + 16][:, :, None] == there[:, None, :]).any(axis=2).sum(axis=1)
        return count >= self.need[item]

    def cosine(self, ids: np.ndarray, item: int, begin: int, end: int) -> float:
        """Of the item and the part of a window from the first to the last of the item's words."""
        masks = self.masks[item][0]
        there = [k for k, w in enumerate(ids[begin:end].tolist()) if w in masks]
        vector = self.space[ids[begin + there[0] : begin + there[-1] + 1]].sum(axis=0)
        return float(vector @ self.vectors[item] / max(np.linalg.norm(vector), 1e-12))


def search(texts: DataFrame, bench: Benchmark, df: np.ndarray, space: np.ndarray, min_cosine: float, cover: float, partial: float, answer: float) -> DataFrame:
    """``doc_id, item_id, cosine, lcs_words, coverage, answer_coverage, th`` of the leaks that pass the checks."""
    index, ids_of = Index.of(bench, df, space, partial), [x[0] for x in bench.items]
    names, n_terms = ["doc_id", "item_id", "cosine", "lcs_words", "coverage", "answer_coverage", "th"], len(bench.terms)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for at in range(0, len(b), DOCUMENTS):
                part = b.iloc[at : at + DOCUMENTS]
                ids, size = _joined(part["ids"].tolist(), n_terms)
                best: dict[tuple[int, int], tuple] = {}
                for item, doc, begin, end in zip(*(x.tolist() for x in index.windows(ids, size))):
                    cosine = index.cosine(ids, item, begin, end)
                    if cosine >= min_cosine:
                        words, (masks, last, n_last) = ids[begin:end].tolist(), index.masks[item]
                        common = common_length(words, masks)
                        if common >= partial * index.length[item]:
                            got = (common, common_length(words, last) / n_last, cosine)
                            best[doc, item] = max(best.get((doc, item), got), got)
                for (doc, item), (common, last_part, cosine) in best.items():
                    share = common / int(index.length[item])
                    if share >= cover or last_part >= answer:
                        found.append((part["doc_id"].iloc[doc], ids_of[item], cosine, common, share, last_part, part["th"].iloc[doc]))
            if found:
                yield pd.DataFrame(found, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

    return texts.select("doc_id", "th", "ids").mapInPandas(work, "doc_id long, item_id long, cosine double, lcs_words long, coverage double, answer_coverage double, th long")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, rank: int = 96, min_cosine: float = 0.25, cover: float = 0.8, partial: float = 0.6, answer: float = 0.75, block_items: int = 2_000, hashes: bool = False
) -> DataFrame:
    """A row for every document and benchmark item found in it: ``doc_id, item_id, cosine, lcs_words, coverage, answer_coverage``.

    ``coverage`` is the common subsequence's share of the item's words, within a window of two and a half times the item's
    length.  A leak covers ``cover`` of the item, or ``partial`` of it with ``answer`` of its answer, in a window whose
    part with the item's words has a cosine of ``min_cosine`` or more.  The benchmark is taken in blocks of about
    ``block_items`` items, so what is sent to the tasks has a bound; every block is compared with every text.  Wordless
    items and texts never match; repeated rows each give their leaks; an empty table on either side gives no rows; null
    ids are kept.  ``hashes`` adds ``th``, the xxhash64 of the text, which names a document with a null or repeated doc_id.
    """
    small_batches(docs.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-rows.count() // block_items))
    out = None
    for k in range(parts):
        bench = Benchmark.of(rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect())
        if bench.items:
            both = numbered(docs, bench)
            counts, texts = both.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect(), both.where("term is null").drop("term", "n")
            df = np.zeros(len(bench.terms) + 1, np.int64)
            for r in counts:
                df[r["term"]] = r["n"]
            idf = np.maximum(np.log((1 + df[-1]) / (1 + df[:-1])), LEAST_IDF)
            found = search(texts, bench, df, latent_space(idf, sketch(texts, idf, rank)), min_cosine, cover, partial, answer)
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_words long, coverage double, answer_coverage double, th long")
    return out if hashes else out.drop("th")
