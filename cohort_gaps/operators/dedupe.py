"""Keep one row per key. ``row_number() = 1`` is limited inside every map task before the shuffle, so a hot key
sends at most one row per task."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key under ``order``; give an order without ties."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_row", F.row_number().over(spec)).filter(F.col("_row") == 1).drop("_row")


def keep_largest(df: DataFrame, keys: list[str], size: str, tie_break: list[Column]) -> DataFrame:
    """The row with the largest ``size`` per key, rows without a size last."""
    return keep_first(df, keys, [F.col(size).desc_nulls_last(), *tie_break])


def latest_per_unit(results: DataFrame, unit: str = "unit_id", period: str = "period") -> DataFrame:
    """Every unit as it was in its last period."""
    return keep_first(results, [unit], [F.col(period).desc_nulls_last()])


def first_non_null(df: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Per key the first non-NULL value of each column in file order: one partial aggregate, no sort of the group."""
    return df.groupBy(*keys).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def mode_by_group(df: DataFrame, keys: list[str], column: str, name: str | None = None) -> DataFrame:
    """Most frequent non-NULL value per group, the smallest on ties, NULL where a group has none.

    Counts per (group, value) first, so that a large group is spread over its values.
    """
    counts = df.groupBy(*keys, F.col(column).alias("_value")).agg(F.count(column).alias("_n"))
    order = F.when(F.col("_value").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("v")))
    return counts.groupBy(*keys).agg(F.min_by("_value", order).alias(name or column))
