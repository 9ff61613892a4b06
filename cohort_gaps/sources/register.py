"""The unit register, its links, zone scores and the postcode directory."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean_number, normalise_code, numeric_id, trim_all
from ..operators import cleaning
from ..operators.dedupe import keep_first
from . import layouts as lay
from .text_tables import ORDER, read_text_table, tidy_columns


def tidy_register(raw: DataFrame) -> DataFrame:
    """22 fields, dates, map point and category; the first row of a unit counts."""
    rows = tidy_columns(raw, lay.REGISTER_HEADERS, ["unit_id"])
    rows = rows.withColumn("unit_id", numeric_id("unit_id")).filter(F.col("unit_id").isNotNull())
    rows = cleaning.clean_codes(rows, ["postcode"])
    rows = cleaning.parse_dates(rows, ["open_date", "close_date"], lay.REGISTER_DATE)
    rows = cleaning.clean_numeric(rows, ["easting", "northing"])
    rows = cleaning.null_unless_both_positive(rows, "easting", "northing")
    rows = cleaning.null_sentinels(rows, lay.REGISTER_SENTINEL_COLUMNS, lay.REGISTER_SENTINELS)
    rows = keep_first(cleaning.categorise_units(rows), ["unit_id"], [F.col(ORDER)]).drop(ORDER)
    return cleaning.locate_points(rows)


def tidy_links(raw: DataFrame) -> DataFrame:
    """Unit, linked unit and link type; rows without both ids go."""
    rows = tidy_columns(raw, lay.LINK_HEADERS, list(lay.LINK_HEADERS))
    return rows.select(numeric_id("unit_id").alias("unit_id"), numeric_id("link_id").alias("link_id"),
                       trim_all("link_type").alias("link_type")).na.drop(subset=["unit_id", "link_id"])


def tidy_zones(raw: DataFrame) -> DataFrame:
    """Zone scores of any release; the first row of a zone counts."""
    rows = tidy_columns(raw, lay.ZONE_PATTERNS, ["zone_code"], by_pattern=True)
    rows = cleaning.clean_numeric(rows, ["zone_score", "zone_rank", "zone_decile", "child_score", "child_decile",
                                         "population"])
    rows = cleaning.rank_to_score(rows)
    rows = rows.withColumns({"zone_code": trim_all("zone_code"), "zone_decile": F.col("zone_decile").try_cast("int"),
                             "child_decile": F.col("child_decile").try_cast("int")})
    return keep_first(rows.filter(F.col("zone_code").isNotNull()), ["zone_code"], [F.col(ORDER)]).drop(ORDER)


def tidy_directory(raw: DataFrame) -> DataFrame:
    """Postcode to zone; the first row of a postcode counts."""
    rows = tidy_columns(raw, lay.DIRECTORY_HEADERS, list(lay.DIRECTORY_HEADERS))
    rows = rows.select(normalise_code("postcode").alias("postcode"), trim_all("zone_code").alias("zone_code"), ORDER)
    rows = rows.filter(F.col("postcode").isNotNull() & (F.col("zone_code") != ""))
    return keep_first(rows, ["postcode"], [F.col(ORDER)]).drop(ORDER)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    return tidy_register(read_text_table(spark, path))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return tidy_links(read_text_table(spark, path))


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file, or a Parquet table with the published headers."""
    return tidy_zones(spark.read.parquet(path) if path.endswith(".parquet") else read_text_table(spark, path))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return tidy_directory(read_text_table(spark, path))
