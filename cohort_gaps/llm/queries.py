"""The thirteen operators as queries over the shared tables."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (filter_audit, hnsw, line_dedup, maxent, packing, perplexity, quality_classifier, secret_scan,
               sentencepiece_scan, simhash, token_counts, url_filter, whitening)

BYTE_BPE, WORD_BPE, PIECES = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    path = public_tokenizers.path
    return {
        "op1_perplexity": lambda s, d: perplexity.report(_table(s, d, "documents")),
        "op2_secret_scan": lambda s, d: secret_scan.report(_table(s, d, "documents")),
        "op3_sentencepiece": lambda s, d: sentencepiece_scan.report(_table(s, d, "documents"), path(PIECES)),
        "op4_packing": lambda s, d: packing.report(_table(s, d, "documents"), path(BYTE_BPE)),
        "op5_simhash": lambda s, d: simhash.report(_table(s, d, "documents")),
        "op6_hnsw": lambda s, d: hnsw.report(_table(s, d, "embeddings")),
        "op7_token_counts": lambda s, d: token_counts.report(_table(s, d, "documents"), path(WORD_BPE)),
        "op8_line_dedup": lambda s, d: line_dedup.report(_table(s, d, "documents")),
        "op9_maxent": lambda s, d: maxent.report(_table(s, d, "documents")),
        "op10_quality_classifier": lambda s, d: quality_classifier.report(_table(s, d, "documents"), _table(s, d, "labels")),
        "op11_filter_audit": lambda s, d: filter_audit.audit(_table(s, d, "documents"), _table(s, d, "labels")),
        "op12_url_filter": lambda s, d: url_filter.report(_table(s, d, "pages"), _table(s, d, "documents"),
                                                          _table(s, d, "labels")),
        "op13_whitening": lambda s, d: whitening.report(_table(s, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    """The audit of filters in SQL; the other results are beyond SQL at the size of the tables, and tests compare them with
    brute force."""
    return {"op11_filter_audit": filter_audit.ORACLE}
