"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed and rebuilt there: normaliser, metaspace marker, scores (unigram models) or merges in
score order (BPE models), and byte fallback.  Pieces hold the marker only at their front, so a text's ids are the ids of
its units (a run of spaces with the word after it) in order; every distinct unit is encoded once, in multithreaded
batches, and decoded again.  The original library only checks: units on which it gives other ids, and units that do not
come back from their ids, are counted.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from tidemark.llm.common import Recent, kept_by_worker, small_batches

MARK = "▁"
#: Kinds of piece in the protobuf.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Units whose ids a worker surely remembers; it may hold twice as many.
CACHE_UNITS = 500_000


def parse(path: str):
    """The model as its protobuf message."""
    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    return proto


def merges_of(pieces: list) -> list[tuple[str, str]]:
    """All ways to join two pieces into a third, the third's best score first."""
    ids = {p.piece: k for k, p in enumerate(pieces) if p.type in (NORMAL, USER)}
    out = []
    for piece, k in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                out.append((-pieces[k].score, k, left, right))
    return [(pieces[a].piece, pieces[b].piece) for _, _, a, b in sorted(out)]


def rebuild(proto) -> Tokenizer:
    """A tokenizer for units whose marker is already in place (no dummy prefix is added)."""
    pieces, trainer, norm = list(proto.pieces), proto.trainer_spec, proto.normalizer_spec
    if trainer.model_type == UNIGRAM:
        model = models.Unigram([(p.piece, p.score) for p in pieces], trainer.unk_id, trainer.byte_fallback)
    elif trainer.model_type == BPE:
        model = models.BPE({p.piece: k for k, p in enumerate(pieces)}, merges_of(pieces), unk_token=pieces[trainer.unk_id].piece, fuse_unk=True, byte_fallback=trainer.byte_fallback)
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(bytes(norm.precompiled_charsmap))] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps.append(normalizers.Replace(Regex(" {2,}"), " "))
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return tokenizer


class Codec:
    """Encodes and decodes batches of whole texts; ids are little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        self.proto = parse(path)
        self.tokenizer, self.original = rebuild(self.proto), sentencepiece.SentencePieceProcessor(model_file=path)
        spec = self.proto.normalizer_spec
        self.prefix = spec.add_dummy_prefix
        marked = all(MARK not in p.piece.lstrip(MARK) for p in self.proto.pieces if p.type in (NORMAL, USER))
        #: Units are independent where no piece spans them, no normalising does, and the first is like any other.
        self.by_unit = marked and self.prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
        self.known = Recent(CACHE_UNITS)
        self.differing = 0
        #: Units whose ids do not give them back.
        self.lost: set[str] = set()
        self.silent = [k for k, p in enumerate(self.proto.pieces) if p.type in (CONTROL, UNKNOWN)]

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of texts or of units without their first space, by the rebuilt tokenizer; the original library's are compared."""
        out = []
        for k in range(0, len(texts), 4096):
            part = texts[k : k + 4096]
            ours = [x.ids for x in self.tokenizer.encode_batch_fast([" " + t for t in part] if self.prefix else part, add_special_tokens=False)]
            theirs = self.original.encode(part, num_threads=1)
            # The original library has no text for a last single space, and none for an empty text's prefix.
            self.differing += sum(mine != check for text, mine, check in zip(part, ours, theirs) if text)
            self.lost.update(text for text, again in zip(part, self.texts_of(ours)) if again != text.replace(MARK, " "))
            out += [array("I", mine).tobytes() for mine in ours]
        return out

    def texts_of(self, ids: list[list[int]]) -> list[str]:
        """The texts of lists of ids by the rebuilt decoder, without the dummy prefix; control pieces and the unknown one have no text."""
        silent = set(self.silent)
        texts = self.tokenizer.decode_batch([[i for i in x if i not in silent] if not silent.isdisjoint(x) else x for x in ids], skip_special_tokens=False)
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]

    def _units(self, text: str) -> list[str]:
        if MARK in text:  # the model knows no difference
            text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [u[1:] for u in re.findall(" +[^ ]*", " " + text)]
        return text.split(" ") if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_unit:
            return [ids if t else b"" for t, ids in zip(texts, self._ids(texts))]
        return [b"".join(map(self.known.__getitem__, units)) for units in self._remember(texts)]

    def _remember(self, texts: list[str]) -> list[list[str]]:
        """The units of each text, all of them encoded."""
        self.known.turn()
        split = [self._units(t) for t in texts]
        new = self.known.missing(set().union(*split))
        self.known.update(zip(new, self._ids(new)))
        return split

    def check(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of each text, and whether they give the text back (the marker reads as a space)."""
        if not self.by_unit:
            ids = self.encode(texts)
            again = self.texts_of([np.frombuffer(x, "<u4").tolist() for x in ids])
            return [(x, a == t.replace(MARK, " ")) for x, a, t in zip(ids, again, texts)]
        split = self._remember(texts)
        return [(b"".join(map(self.known.__getitem__, units)), not self.lost or self.lost.isdisjoint(units)) for units in split]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row of ``docs(doc_id, text, ...)``; null and empty texts have no ids."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = kept_by_worker(f"pieces {model}", lambda: Codec(model))
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k : k + 512]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": [np.frombuffer(x, "<i4") for x in codec.encode(part["text"].tolist())]})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` of every row of ``encoded(doc_id, ids, ...)``; null ids give an empty text."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = kept_by_worker(f"pieces {model}", lambda: Codec(model))
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": codec.texts_of([[] if x is None else np.asarray(x).tolist() for x in b["ids"]])})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInPandas(work, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n_tokens, ids_crc32, n_byte_ids, decoded, differing`` of every row of ``docs(doc_id, text, ...)``.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers, ``n_byte_ids`` how many of
    them are fallback bytes, ``decoded`` whether the rebuilt decoder gives the text back (the marker character reads as a
    space; every distinct unit is decoded once), and ``differing`` the units first met in the row's batch on which the rebuilt tokenizer and the original library
    differ, given with the batch's first row.  Null and empty texts have no ids.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = kept_by_worker(f"pieces {model}", lambda: Codec(model))
        reported = codec.differing
        is_byte = np.array([p.type == BYTE for p in codec.proto.pieces])
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.iloc[k : k + 512]
                texts = part["text"].tolist()
                ids, again = zip(*codec.check(texts))
                new, reported = codec.differing - reported, codec.differing
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "n_tokens": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids],
                    "n_byte_ids": [int(is_byte[np.frombuffer(x, "<u4")].sum()) for x in ids], "decoded": list(again), "differing": [new] + [0] * (len(ids) - 1),
                })

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(work, "doc_id long, n_tokens long, ids_crc32 long, n_byte_ids long, decoded boolean, differing long")
