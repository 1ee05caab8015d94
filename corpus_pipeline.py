"""The corpus pipeline: each stage works on all documents that the stages before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read back as the next
one's ``docs``.  All stages but the last return the columns of documents.

The deduplication and decontamination stages decide by row, also where ids are
null or repeat with other texts: a row is named by its id and text (a hash of
both, 128 bits), and rows that repeat both leave the exact dedup once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.byte_bpe import encode_decode
from ledgerlens.llm.common import documents, once, pick, row_key, semi_join_rows
from ledgerlens.llm.decontaminate import contamination
from ledgerlens.llm.exact_dedup import digests, exact_dedup
from ledgerlens.llm.language_id import with_known_language
from ledgerlens.llm.queries import tokenizer
from ledgerlens.llm.simhash import first_rows
from ledgerlens.session import materialize


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and null ones, go; those without a ``lang`` get the predicted one."""
    return with_known_language(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays, and of its rows that differ in case the one with the smallest key."""
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest"))
    rows = digests(docs, keyed=True)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    return once(semi_join_rows(docs, rows.groupBy("digest").agg(F.min("row_key").alias("row_key"))), "doc_id", "text")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near copies the document with the smallest id stays."""
    return semi_join_rows(docs, first_rows(docs, words=4, distance=4))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    rows = pick(docs, "doc_id", "text").select(row_key(F.col("doc_id"), F.col("text")).alias("doc_id"), "text")
    found = contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return semi_join_rows(docs, found.where("not contaminated").select(F.col("doc_id").alias("row_key")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian, 32 bits) and their byte offsets, with hashes of the ids and of what they decode to."""
    return encode_decode(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), keep_ids=True)


STAGES = [
    ("language ID", known_language),
    ("exact dedup", without_copies),
    ("SimHash near-dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", encoded),
]

# Trained models and tokenisation have no SQL form; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
