"""A training-corpus pipeline of the numbered operators over ``documents``.

Stages, in order: low-quality documents go; one document of each group of
SimHash near-duplicates stays; documents that overlap the benchmark go; secrets
are redacted in place; what is left is encoded.  Each stage reads all rows that
its predecessor kept, and all but the last return the columns of ``documents``.

Defined cases: null texts count as empty and are judged like empty ones; rows
that share a doc_id, or have none, are judged by their texts (a null id is the
largest); without a usable label no document is rejected; an empty table stays
empty; a null length is counted where the text is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, decontaminate, quality, secret_scan, simhash
from lattica.llm.textkit import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, of those with its smallest id."""
    return simhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by their kind; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them."""
    return bpe.encode_decode(docs, bpe.default_tokenizer())


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", bpe_coding),
]

#: SQL cannot express the stages; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
