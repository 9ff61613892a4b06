"""Token counts through a digest cache: only texts that the cache does not know are encoded, each once.

The cache is a Parquet folder of ``(version, digest, n_tokens)``; ``version`` is the digest of the tokenizer file, ``digest``
that of the normalised text.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .tokens import count_tokens

LIMIT = 2048
CACHE = "version string, digest binary, n_tokens long"
PATH_MISSING = "PATH_NOT_FOUND"


def line_ends(text: Column) -> Column:
    """The normal form for a tokenizer that drops white space: Windows line ends become plain ones."""
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def version_of(tokenizer_path: str) -> str:
    with open(tokenizer_path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """``(digest, n_tokens)`` of one tokenizer version; a folder that is not there yet is an empty cache."""
    try:
        stored = spark.read.schema(CACHE).parquet(cache_path)
    except AnalysisException as error:
        if error.getCondition() != PATH_MISSING:
            raise
        stored = spark.createDataFrame([], CACHE)
    # Two runs may have added the same text; both counted alike.
    return stored.filter(F.col("version") == version).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None,
          normalise: Callable[[Column], Column] = line_ends) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` per row of ``docs``; new texts are added to the cache at ``cache_path``.

    Without a ``cache_path`` the cache is a new folder in the checkpoint folder. A null text counts as empty, with zero
    tokens; a null ``doc_id`` is carried along; repeated rows give repeated results and are encoded once; an empty table
    adds nothing. ``normalise`` must not change the count.
    """
    spark = docs.sparkSession
    version = version_of(tokenizer_path)
    if cache_path is None:
        ensure_checkpoint_dir(spark)
        cache_path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                        F.unhex(F.sha2(normalise(text), 256)).alias("digest"))
    known = cut_lineage(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"))

    # One row of each unknown text is encoded; a row without an id stands behind all others.
    holder = F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("holder")
    misses = (known.groupBy("digest").agg(F.min(holder).alias("holder"))
              .join(read_cache(spark, cache_path, version), "digest", "left_anti"))
    wanted = keyed.select(holder, "digest", "text").join(misses, ["holder", "digest"])

    def encode(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts = count_tokens(tokenizer_path, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    counted = wanted.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    return known.join(read_cache(spark, cache_path, version), "digest").select("doc_id", "n_bytes", "n_tokens")


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The result of ``op7_token_counts``."""
    return count(docs, tokenizer_path).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
