"""The corpus pipeline: documents in, token ids out. Each stage works on all that its predecessor kept, whole texts of any length.

An empty table passes every stage as an empty one, and extra columns travel along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotledger.llm import bpe, language, mixing, simhash, suffixes


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language. Texts that are null or without letters go; labels that are null are not learnt from; repeated rows stay or go together."""
    return language.keep_identified(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of SimHash fingerprints join, of three-word shingles and within three bits, as in operator 4. Documents
    without words have one fingerprint; of the repeated rows of a document one stays; rows without a doc_id stay."""
    return simhash.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes that stand elsewhere, too. A null text stays null, and a text may become empty; no row goes."""
    return suffixes.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them; those without words, which add nothing to a mix, go. A null source is one of its own."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: doc_id, n_tokens, tokens (32-bit little-endian ids). A null or empty text has none."""
    return bpe.encode(docs, packed=True).select("doc_id", "n_tokens", F.col("ids").alias("tokens"))


STAGES = [
    ("language ID", identified),
    ("SimHash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]
#: SQL can express neither the kernel machine nor the merges; tests/llm compares every stage with a plain version in Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
