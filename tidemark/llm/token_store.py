"""Token ids in files that serve single documents: one zstandard dictionary for all, one frame per document.

Layout of a shard, all integers little-endian:

    magic "TIDS0001" | SHA-256 of the dictionary (32 bytes) | frames
    index: per document  doc_id i64 | null flag u8 | frame offset u64 | frame bytes u32 | ids u64
    index offset u64 | documents u64 | magic "TIDSEND1"

A frame holds the document's ids as unsigned 32-bit integers, compressed by itself with the shared dictionary.  Shards
follow each other in doc_id order.  A reader refuses a shard whose dictionary hash differs from the dictionary it has.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from tidemark.llm.common import Recent, kept_by_worker, scratch, small_batches, written
from tidemark.llm.files import open_at, put

MAGIC, END = b"TIDS0001", b"TIDSEND1"
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u8")])
#: Bytes of ids in a sample for the dictionary, and of texts in a range of documents (several shards, where their frames are more).
SAMPLE_BYTES, RANGE_BYTES = 16_384, 128 << 20
#: Words whose ids a worker surely remembers; it may hold twice as many.
CACHE_WORDS = 250_000


class WordEncoder:
    """Ids of whole texts by a tokenizer whose normaliser and splitter never look across white space.

    Such a text's ids are its words' ids in order, so the library encodes each distinct word once.  Splits at the space,
    tab, line feed and carriage return; other white space stays inside a word for the library.  A word of Latin letters
    with closing marks is its lower-cased letters and its marks, which the vocabulary's model takes as they are, where
    a probe shows that this tokenizer does so.
    """

    PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*$%&#|]*)")
    PROBE = "The Über-Größe, it's ÉTÉ!! naïve... señor; x*** (A) 12 don't&&& Ab1c|"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.letters, self.marks = Recent(CACHE_WORDS, self._word), Recent(CACHE_WORDS, self._letters), {}
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = "".join(chr(c) for c in [*range(65, 91), *range(97, 123), *range(192, 256)])
        self.alphabet = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in latin})
        self.model, self.plain = self.tokenizer.model, True
        self.plain = self([self.PROBE]) == [self._encode(self.PROBE)]
        self.words.clear()

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters.translate(self.alphabet))]).tobytes()

    def _word(self, word: str) -> bytes:
        match = self.PLAIN.fullmatch(word) if self.plain else None
        if match is None:
            return self._encode(word)
        letters, marks = match.groups()
        if marks not in self.marks:
            self.marks[marks] = self._encode(marks)
        return self.letters[letters.lower()] + self.marks[marks]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        for kept in (self.words, self.letters):
            kept.turn()
        if len(self.marks) > CACHE_WORDS:
            self.marks.clear()
        get = self.words.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) for t in texts]


def train_dictionary(docs: DataFrame, tokenizer: str, size: int = 65_536, documents: int = 1_000, samples: int = 4_096) -> bytes:
    """A dictionary from the ids of at most ``documents`` documents, those whose doc_ids hash lowest.

    Tasks cut these documents' ids into samples of 16 KB; at most ``samples`` of them, those that hash lowest, train the
    dictionary, which bounds what the driver holds.  Where they are too few to train on, their own ids are the dictionary;
    it is empty where no document has ids.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = kept_by_worker(f"words {tokenizer}", lambda: WordEncoder(tokenizer))
        for b in batches:
            ids = encode(b["text"].tolist())
            yield pd.DataFrame({"ids": [x[k : k + SAMPLE_BYTES] for x in ids for k in range(0, len(x), SAMPLE_BYTES)]})

    chosen = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    rows = docs.join(F.broadcast(chosen), "doc_id").select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInPandas(work, "ids binary")
    ids = [bytes(r["ids"]) for r in rows.orderBy(F.xxhash64("ids"), "ids").limit(samples).collect()]
    try:
        return zstandard.train_dictionary(size, ids).as_bytes()
    except zstandard.ZstdError:
        return b"".join(ids)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, dictionary: bytes, end_id: int, shard_bytes: int = 64 << 20) -> DataFrame:
    """Write ``docs(doc_id, text)`` as shards in ascending doc_id order; returns ``part, roll, path, docs, ids`` rows.

    Ranges of documents are as many as the texts' bytes ask for; a range's shards end at ``shard_bytes`` of frames.
    """
    digest = hashlib.sha256(dictionary).digest()
    put(f"{folder}/dictionary.zdict", lambda out: out.write(dictionary))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
        encode, pack = kept_by_worker(f"words {tokenizer}", lambda: WordEncoder(tokenizer)), _compressor(dictionary)
        last = struct.pack("<I", end_id)

        def frames() -> Iterator[tuple]:
            for b in batches:
                for k in range(0, len(b), 256):
                    some = b.iloc[k : k + 256]
                    for ids, doc_id in zip(encode(some["text"].tolist()), some["doc_id"]):
                        yield doc_id, len(ids) // 4 + 1, pack.compress(ids + last)

        rows = frames()
        ahead, roll = next(rows, None), 0
        while ahead is not None:
            path, index = f"{folder}/ids-{part:06d}-{roll:05d}.tids", []

            def write(out) -> None:
                nonlocal ahead
                out.write(MAGIC + digest)
                at = len(MAGIC) + len(digest)
                while ahead is not None and at < shard_bytes:
                    doc_id, n, frame = ahead
                    index.append((0 if pd.isna(doc_id) else int(doc_id), pd.isna(doc_id), at, len(frame), n))
                    out.write(frame)
                    at += len(frame)
                    ahead = next(rows, None)
                out.write(np.array(index, ENTRY).tobytes())
                out.write(struct.pack("<QQ", at, len(index)) + END)

            put(path, write)
            yield pd.DataFrame({"part": [part], "roll": [roll], "path": [path], "docs": [len(index)], "ids": [sum(x[4] for x in index)]})
            roll += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ordered = rows.repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    return written(ordered.mapInPandas(work, "part int, roll int, path string, docs long, ids long"), "shards")


class Shard:
    """One shard, open for reads of single documents."""

    def __init__(self, path: str, dictionary: bytes):
        self.file = open_at(path)
        size = self.file.size()
        tail = self.file.read_at(24, size - 24)
        at, n = struct.unpack("<QQ", tail[:16])
        head = self.file.read_at(40, 0)
        if tail[16:] != END or head[:8] != MAGIC:
            raise ValueError(f"{path} is no shard of token ids")
        if head[8:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.index = np.frombuffer(self.file.read_at(n * ENTRY.itemsize, at), ENTRY)
        self.unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> bytes:
        """The k-th document's ids; reads only its frame."""
        e = self.index[k]
        return self.unpack.decompress(self.file.read_at(int(e["size"]), int(e["offset"])))


def read_shards(shards: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files themselves.

    The driver holds one row per shard, for the number of ids before each.
    """
    spark = shards.sparkSession
    rows = sorted((r["part"], r["roll"], r["path"], r["ids"]) for r in shards.collect())
    before = [0, *accumulate(r[3] for r in rows)]
    plan = spark.createDataFrame([(r[2], b) for r, b in zip(rows, before)], "path string, start long")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = None
        for b in batches:
            for path, start in zip(b["path"], b["start"]):
                if dictionary is None:
                    with open_at(f"{folder}/dictionary.zdict") as f:
                        dictionary = f.read()
                shard = Shard(path, dictionary)
                x = shard.index
                for k in range(0, len(x), 4096):
                    part = x[k : k + 4096]
                    crc = [zlib.crc32(shard.ids(i)) for i in range(k, k + len(part))]
                    n = part["ids"].astype("int64")
                    ids = pd.Series(part["doc_id"].astype("int64"), dtype="Int64").mask(part["null"].astype(bool))
                    yield pd.DataFrame({"doc_id": ids, "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": np.array(crc, "int64")})
                    start += int(n.sum())
                shard.file.close()

    return plan.repartition(max(1, len(rows))).mapInPandas(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Encode every whole text, append ``end_id``, write the shards to the shared folder and read them back.

    Every row of ``docs(doc_id, text, ...)`` gives a row; null and empty texts have the end id alone.  Rows with equal
    doc_ids follow each other by their texts' hashes; null doc_ids come first.  No rows: no shards, no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    folder = scratch(docs.sparkSession, "token-ids")
    return read_shards(write_shards(docs, folder, tokenizer, train_dictionary(docs, tokenizer), end_id), folder)
