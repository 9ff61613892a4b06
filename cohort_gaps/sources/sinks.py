"""Tables, views and extracts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions import half_even
from .results import slim_long, slim_wide
from .text_tables import ORDER

# Extract name, the view it shows, its sort keys, and whether they ascend.
EXTRACTS = {
    "units": ("dash_units", ["period", "area_name", "unit_name"], True),
    "areas": ("dash_areas", ["period", "rank_gap_vs_benchmark"], True),
    "beating_the_odds": ("beating_the_odds", ["periods_beating_odds", "avg_residual_z"], False),
    "benchmark": ("benchmark_trends", ["period"], True),
}

def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace a Parquet table and read it back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        # Every task writes its own file per partition, so a period that holds a third of the rows stays spread out.
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def round_doubles(df: DataFrame, decimals: int = 2) -> DataFrame:
    """Every floating-point column to a few decimals, half to even."""
    return df.select(*[half_even(c, decimals).alias(c) if isinstance(df.schema[c].dataType, (DoubleType, FloatType))
                       else F.col(c) for c in df.columns])


def _sorted(keys: list[str], ascending: bool) -> list[Column]:
    return [F.col(k).asc_nulls_last() if ascending else F.col(k).desc_nulls_last() for k in keys]


def extract(views: dict[str, DataFrame], name: str, decimals: int = 2) -> DataFrame:
    """One flat extract, sorted and rounded. The sort is a range partitioning, so the files are in order."""
    view, keys, ascending = EXTRACTS[name]
    return round_doubles(views[view].orderBy(*_sorted(keys, ascending)), decimals)


def write_extracts(views: dict[str, DataFrame], folder: str, decimals: int = 2) -> None:
    """All extracts as CSV with a header."""
    for name in EXTRACTS:
        extract(views, name, decimals).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def json_extract(df: DataFrame, fields: list[str] | None = None, decimals: int = 2) -> DataFrame:
    """The given fields that exist, or every column; numbers rounded."""
    return round_doubles(df.select(*[f for f in fields or df.columns if f in df.columns]), decimals)


def write_json_extracts(views: dict[str, DataFrame], folder: str, fields: dict[str, list[str]] | None = None) -> None:
    """The views of the extracts as JSON lines; ``fields`` narrows an extract by name. Missing values are written as null."""
    for name, (view, _, _) in EXTRACTS.items():
        (json_extract(views[view], (fields or {}).get(name)).write.mode("overwrite").option("ignoreNullFields", False)
         .json(f"{folder}/{name}"))


def write_slim_wide(raw: DataFrame, path: str) -> None:
    """The used columns of a wide file, to a new place: Spark cannot replace what it is reading."""
    slim_wide(raw).write.mode("overwrite").option("header", True).csv(path)


def write_slim_long(raw: DataFrame, path: str) -> None:
    """The used rows and columns of a long file, to a new place."""
    slim_long(raw).drop(ORDER).write.mode("overwrite").option("header", True).csv(path)
