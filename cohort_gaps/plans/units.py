"""Unit dimension: register, borrowed places, zones from the postcode directory, and lineage."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import iso_dates
from ..operators.dedupe import latest_per_unit
from ..operators.joins import best_name_match, join_with_source, lookup_fill, units_missing
from .lineage import build_lineage

# What a unit that the register lacks borrows from its best match, and the labels of the sources.
BORROWED = ["area_code", "area_name", "region", "zone_code", "district_code", "easting", "northing", "latitude",
            "longitude", "setting"]
FROM_ID, FROM_POSTCODE = "gias_urn", "gias_postcode"

COLUMNS = ["unit_id", "lineage_id", "lineage_method", "unit_name", "postcode", "area_code", "area_name", "region",
           "unit_type", "type_name", "type_group", "phase", "gender", "religious_character", "admissions", "setting",
           "trust_name", "status", "open_date", "close_date", "zone_code", "district_code", "easting", "northing",
           "latitude", "longitude", "location_source"]


def coalesce_attrs(units: DataFrame) -> DataFrame:
    """Name and postcode from the results where the register has none; the type is then ``Other``."""
    return units.withColumns({"unit_name": F.coalesce("unit_name", "result_name"),
                              "postcode": F.coalesce("postcode", "result_postcode"),
                              "unit_type": F.coalesce("unit_type", F.lit("Other"))})


def place_units(results: DataFrame, register: DataFrame) -> DataFrame:
    """Every unit with results, with its register row or, failing that, the place of its best match."""
    latest = latest_per_unit(results).select("unit_id", "result_name", "result_postcode")
    found = join_with_source(latest, register, "unit_id", FROM_ID)
    match = best_name_match(units_missing(latest, register), register, BORROWED)
    borrowed = match.select("unit_id", F.lit(FROM_POSTCODE).alias("_source"),
                            *[F.col(c).alias(f"_{c}") for c in BORROWED])
    placed = found.join(borrowed, "unit_id", "left")
    return placed.withColumns({c: F.coalesce(c, f"_{c}") for c in BORROWED}).withColumn(
        "location_source", F.coalesce("location_source", "_source")).select(*found.columns)


def build_units(results: DataFrame, register: DataFrame, links: DataFrame | None = None,
                directory: DataFrame | None = None) -> DataFrame:
    """The unit table, one row per unit with results. Results and register are read several times, so give written
    tables."""
    units = coalesce_attrs(place_units(results, register))
    if directory is not None:
        units = lookup_fill(units, directory, "postcode", "zone_code")
    units = units.join(build_lineage(results, register, links), "unit_id", "left")
    return iso_dates(units, ["open_date", "close_date"]).select(*COLUMNS)
