"""Area dimension with population-weighted deprivation."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent, rank_key
from ..operators.dedupe import mode_by_group


def district_areas(register: DataFrame) -> DataFrame:
    """Which area each district belongs to: the area most of its units name, the smallest on ties."""
    known = register.filter(F.col("district_code").isNotNull() & F.col("area_code").isNotNull())
    return mode_by_group(known, ["district_code"], "area_code")


def area_deprivation(zones: DataFrame, districts: DataFrame) -> DataFrame:
    """Per area the weighted mean score and the share of people in the two most deprived deciles.

    A zone without a population weighs 1. A zone without a score adds nothing to the sum but keeps its weight. Zones
    are summed per district before the district is looked up, so the lookup joins one row per district.
    """
    weight = F.coalesce("population", F.lit(1.0))
    sums = zones.groupBy("district_code").agg(
        F.sum(weight).alias("_w"), F.coalesce(F.sum(weight * F.col("zone_score")), F.lit(0.0)).alias("_ws"),
        F.sum(F.when(F.col("zone_decile") <= 2, weight).otherwise(0.0)).alias("_wd"))
    return (sums.join(districts, "district_code").groupBy("area_code")
            .agg(F.sum("_w").alias("_w"), F.sum("_ws").alias("_ws"), F.sum("_wd").alias("_wd"))
            .select("area_code", F.try_divide("_ws", "_w").alias("zone_score_avg"),
                    percent("_wd", "_w").alias("pct_pop_most_deprived")))


def area_profile(units: DataFrame) -> DataFrame:
    """Per area the usual name and region, the mean map point and the number of units."""
    known = units.filter(F.col("area_code").isNotNull())
    totals = known.groupBy("area_code").agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"),
                                            F.countDistinct("unit_id").alias("n_units"))
    return (totals.join(mode_by_group(known, ["area_code"], "area_name"), "area_code")
            .join(mode_by_group(known, ["area_code"], "region"), "area_code")
            .select("area_code", "area_name", "region", "latitude", "longitude", "n_units"))


def build_areas(units: DataFrame, register: DataFrame, zones: DataFrame) -> DataFrame:
    """The area table; the rank of an area without a score is NULL. One row per area, so one window may hold it."""
    areas = area_profile(units).join(area_deprivation(zones, district_areas(register)), "area_code", "left")
    score = rank_key("zone_score_avg")
    rank = F.rank().over(Window.orderBy(score.desc_nulls_last()))
    return areas.withColumn("zone_score_rank", F.when(F.col("zone_score_avg").isNotNull(), rank))
