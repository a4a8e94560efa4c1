"""WARC archives: written from pages with revisit records, read back in blocks with boundary-chain verification.

A reader that starts inside a file cannot tell a record's first bytes from the same bytes inside a payload.  So each
task only proposes: every place in its block that parses as a record header is a candidate, with the offset at which
its successor must begin.  Candidates are chained inside the block at once; then pointer jumping from offset 0 (each
round doubles the jumps' length) keeps exactly what the file's start reaches, and a second pass reads those records.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, written
from tidemark.llm.files import open_at, put

MAGIC, BREAK = b"WARC/1.0\r\n", b"\r\n\r\n"
#: Bytes that are read beyond a block for a header that crosses its end, and then again until the header is whole.
HEADER_BYTES = 1 << 16
#: Repeated payloads (50 bytes each) that are sent to all tasks at most.
BROADCAST_DIGESTS = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(col: Column) -> Column:
    """Upper-case base32 of a column's SHA-1: each five hex digits are four base-32 digits."""
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    part = [F.lpad(F.conv(F.substring(F.sha1(col), 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*part)), digits, BASE32)


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: refers_to is the smallest page_id of an equal payload, null for it.

    Payloads under ``min_bytes`` are never revisits.  The smallest page_ids are found by an aggregation that combines
    before its shuffle.  Those of repeated payloads are sent to all tasks where they are at most ``BROADCAST_DIGESTS``, so
    that pages stay where they are read; else the join may split a payload that a large share of the pages has.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("digest", base32_sha1(F.col("html")))
    light = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("html"))
    first = light.where(F.octet_length("html") >= min_bytes).groupBy(base32_sha1(F.col("html")).alias("digest")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "repeated")
    first = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.octet_length("html") >= min_bytes)
    return rows.join(first, "digest", "left").select("page_id", "url", "html", "digest", F.when(other, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record with its closing line breaks.  Control characters and spaces in the address are percent-encoded."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + (html if refers_to is None else b"")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + BREAK + block + BREAK


def write_archives(pages: DataFrame, folder: str, file_bytes: int = 64 << 20, min_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)``; returns ``path, size, records`` of the files."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, state = TaskContext.get().partitionId(), {"file": 0, "batch": next(batches, None), "at": 0}
        while state["batch"] is not None:
            path, n = f"{folder}/pages-{part:06d}-{state['file']:05d}.warc", [0, 0]

            def write(out, n=n) -> None:
                while state["batch"] is not None and n[0] < file_bytes:
                    b = state["batch"]
                    for x in b.iloc[state["at"] :].itertuples(index=False):
                        ids = [None if pd.isna(v) else int(v) for v in (x.page_id, x.refers_to)]
                        raw = record(ids[0], x.url, x.html, x.digest, ids[1])
                        out.write(raw)
                        n[0] += len(raw)
                        n[1] += 1
                        state["at"] += 1
                        if n[0] >= file_bytes:
                            break
                    if state["at"] >= len(b):
                        state["batch"], state["at"] = next(batches, None), 0

            put(path, write)
            state["file"] += 1
            yield pd.DataFrame({"path": [path], "size": [n[0]], "records": [n[1]]})

    return written(with_revisits(pages, min_bytes).mapInPandas(work, "path string, size long, records long"), "archives")


def parse_header(raw: bytes, at: int) -> tuple[int, dict[str, str]] | None:
    """Where the block begins and the named fields, of a record header at ``at`` in ``raw``; None if it is none."""
    end = raw.find(BREAK, at)
    if end < 0:
        return None
    fields = {}
    for line in raw[at + len(MAGIC) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return (end + len(BREAK), fields) if fields.get("content-length", "").isdecimal() and "warc-type" in fields else None


def whole_header(f, raw: bytes, begin: int, at: int, size: int) -> bytes:
    """``raw``, which starts at ``begin`` in the file, with more of the file until the header at ``at`` ends."""
    more = HEADER_BYTES
    while raw.find(BREAK, at) < 0 and begin + len(raw) < size:
        raw += f.read_at(min(more, size - begin - len(raw)), begin + len(raw))
        more *= 2
    return raw


def candidates(files: DataFrame, block_bytes: int) -> DataFrame:
    """``path, off, next`` of every header-like place; next is where its chain leaves the block (-1: it breaks off)."""
    spans = files.select("path", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(block_bytes))).alias("begin"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, size, begin in zip(b["path"], b["size"], b["begin"]):
                stop = min(begin + block_bytes, size)
                with open_at(path) as f:
                    raw = f.read_at(min(stop + HEADER_BYTES, size) - begin, begin)
                    exits, at = {}, raw.find(MAGIC)
                    while 0 <= at < stop - begin:
                        raw = whole_header(f, raw, begin, at, size)
                        if head := parse_header(raw, at):
                            exits[begin + at] = begin + head[0] + int(head[1]["content-length"]) + len(BREAK)
                        at = raw.find(MAGIC, at + 1)
                for off in sorted(exits, reverse=True):  # later ones are resolved already
                    to = exits[off]
                    exits[off] = exits.get(to, -1) if to < stop else to if to <= size else -1
                if exits:
                    yield pd.DataFrame({"path": [path] * len(exits), "off": list(exits.keys()), "next": list(exits.values())})

    return written(spans.repartition("path", "begin").mapInPandas(work, "path string, off long, next long"), "candidates")


def reachable(files: DataFrame, jumps: DataFrame, rounds: int) -> DataFrame:
    """``path, off`` of the block entries that each file's start reaches, by ``rounds`` rounds of pointer jumping."""
    end = files.select("path", F.col("size").alias("off"), F.col("size").alias("next"))
    jump = jumps.where("next >= 0").unionByName(end)
    reach = files.select("path", F.lit(0).cast("long").alias("off"))
    for k in range(rounds):
        step = reach.join(jump, ["path", "off"]).select("path", F.col("next").alias("off"))
        reach = written(reach.union(step).distinct(), "reached")
        if k + 1 < rounds:
            onward = jump.select("path", F.col("off").alias("next"), F.col("next").alias("far"))
            jump = written(jump.join(onward, ["path", "next"]).select("path", "off", F.col("far").alias("next")), "jumps")
    lost = files.join(reach, (files["path"] == reach["path"]) & (files["size"] == reach["off"]), "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"the chain of records breaks off in {[r['path'] for r in lost]}")
    return reach


def read_archives(files: DataFrame, block_bytes: int = 4 << 20) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record of ``files(path, size)``.

    A response's digest is taken from its payload and must equal its header's.  A file whose chain does not end at its
    last byte raises an error.  No files or empty ones: no rows.
    """
    files = files.where("size > 0").select("path", "size")
    longest = files.agg(F.max("size")).first()[0] or 0
    blocks = -(-longest // block_bytes)
    entries = reachable(files, candidates(files, block_bytes), max(1, blocks.bit_length() + 1)).join(files, "path").where("off < size")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, off, size in zip(b["path"], b["off"], b["size"]):
                stop, rows = min((off // block_bytes + 1) * block_bytes, size), []
                with open_at(path) as f:
                    raw, begin = f.read_at(min(stop + HEADER_BYTES, size) - off, off), off
                    while off < stop:
                        raw = whole_header(f, raw, begin, off - begin, size)
                        at, fields = parse_header(raw, off - begin)
                        end = begin + at + int(fields["content-length"])
                        block = raw[at : end - begin] if end - begin <= len(raw) else f.read_at(end - begin - at, begin + at)
                        rows.append(read_record(fields, block))
                        off = end + len(BREAK)
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    out = entries.withColumn("block", F.floor(F.col("off") / block_bytes)).repartition("path", "block").select("path", "off", "size")
    return out.mapInPandas(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_record(fields: dict[str, str], block: bytes) -> tuple:
    """A record's row; a response is checked against its digest, a revisit has its length from the kept HTTP header."""
    head, _, payload = block.partition(BREAK)
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    number = lambda x: int(m[1]) if (m := re.search(r"urn:page:(-?\d+)", x)) else None
    length = len(payload)
    if kind == "revisit":
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
    elif base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    return number(fields["warc-record-id"]), length, digest, kind, number(fields.get("warc-refers-to", ""))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write every row of ``pages(page_id, url, html, ...)`` as a record, read the archives back, a row per record.

    Null html is an empty payload; a null page_id stays null and is never the one referred to unless its payload has no
    other; rows that repeat the smallest page_id of a payload are all responses.  No rows: no archives, no rows.
    """
    return read_archives(write_archives(pages, scratch(pages.sparkSession, "warc"), min_bytes=min_bytes))


def sql(min_bytes: int = 0) -> str:
    """The same rows in DuckDB SQL."""
    digit = "substr('{}', 1 + CAST((v[1 + i // 4] >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)".format(BASE32)
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
        list_transform(range(8), lambda k: CAST('0x' || substr(hex, CAST(1 + 5 * k AS INTEGER), 5) AS BIGINT)) AS v FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: {digit}), '') AS payload_digest,
  CASE WHEN strlen(html) >= {min_bytes} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= {min_bytes} AND page_id <> first THEN first END AS refers_to
FROM g"""
