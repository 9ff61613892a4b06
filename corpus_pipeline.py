"""A training corpus from raw documents: quality, duplicate lines, near copies, secrets, packed sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cohort_gaps.llm import line_dedup, packing, quality_classifier, secret_scan, simhash
from cohort_gaps.session import cut_lineage

TOKENIZER = "byte_bpe_50k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, takes for good."""
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near copies of an earlier one; ``n_chars`` follows the text."""
    return _recounted(line_dedup.dedupe_lines(docs))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by near SimHash fingerprints or by four fifths of the five-word shingles in common."""
    return simhash.keep_first(docs, fingerprints_too=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced; ``n_chars`` follows the text."""
    return _recounted(secret_scan.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.selectExpr(*[f"CAST(char_length(text) AS {kind}) AS n_chars" if name == "n_chars" else f"`{name}`"
                             for name, kind in docs.dtypes])


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_repeated_lines), ("SimHash near-dedup", keep_one_copy),
          ("secret scan", redact_secrets), ("packing", pack_sequences)]

# Trained models, fingerprints and tokens are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
