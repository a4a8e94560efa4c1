"""Corpus preparation in stages; each works on all that the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and returns them, but for the last, which
returns token ids.  Labels and benchmark passages are read from ``sf_dir``.

Null or repeated doc_ids, null, empty and very long texts, and empty tables pass through every stage: a null text has no
lines, no shingles (all texts without words are one group), no benchmark item and no token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, line_dedup, piece_codec, simhash, site_quality
from tidemark.llm.common import written
from tidemark.llm.queries import PIECES, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    return site_quality.classify(docs, table(spark, sf_dir, "labels")).where("tidemark_quality.kept").select(docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated and near-repeated lines out; a document of which nothing is left goes."""
    done = line_dedup.dedup_lines(docs, min_words=1, near_words=5)
    left = (F.col("tidemark_lines.dropped") == 0) | F.regexp_like("text", F.lit("[^ \\t-\\r]"))
    return done.where(F.coalesce(left, F.lit(True))).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that with the smallest doc_id."""
    return simhash.keep_first(docs, width=5, radius=4, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"), hashes=True)
    leaks = written(found.select(F.col("doc_id").alias("tidemark_did"), F.col("th").alias("tidemark_th")).distinct(), "leaks")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("tidemark_did")) & F.xxhash64(F.col("text").cast("string")).eqNullSafe(F.col("tidemark_th"))
    return docs.join(leaks, same, "left_anti").select(docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text: ``doc_id, ids``."""
    return piece_codec.encode(docs, PIECES)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: Trained models and hashed fingerprints have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
