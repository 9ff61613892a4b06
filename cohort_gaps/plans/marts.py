"""Flat tables for dashboards, and the questions people ask of them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .odds import CONSISTENT

UNIT_COLUMNS = ["period_label", "period", "unit_id", "lineage_id", "unit_name", "postcode", "area_name", "region",
                "unit_type", "trust_name", "setting", "latitude", "longitude", "zone_decile", "child_decile", "n_total",
                "n_focus", "pct_focus", "reportable", "score_all", "score_focus", "score_rest", "progress_focus",
                "basics_focus", "basics_rest", "gap_within_unit", "gap_vs_benchmark", "basics_gap_vs_benchmark",
                "benchmark_score_rest", "prev_period", "change_gap_vs_benchmark", "gap_3_period_avg", "is_latest",
                "score_focus_expected", "residual", "residual_z", "serves_deprived", "beating_odds"]

AREA_COLUMNS = ["period_label", "period", "area_code", "area_name", "region", "latitude", "longitude",
                "zone_score_avg", "pct_pop_most_deprived", "zone_score_rank", "n_units", "n_total", "n_focus",
                "pct_focus", "pct_focus_covered", "score_focus", "score_rest", "benchmark_score_rest",
                "gap_within_area", "gap_vs_benchmark", "behind_benchmark_focus", "basics_focus",
                "basics_gap_vs_benchmark", "progress_focus", "scale_of_need", "rank_gap_vs_benchmark",
                "rank_gap_within_area", "rank_scale_of_need", "rank_in_region", "n_areas_in_period", "prev_period",
                "change_gap_vs_benchmark", "rank_change", "gap_3_period_avg", "change_since_first", "first_period",
                "trend", "is_latest"]


def dash_units(unit_trends: DataFrame, odds: DataFrame) -> DataFrame:
    """One row per mainstream unit and period, with the odds columns where the row was in the model."""
    model = odds.select("unit_id", "period", "score_focus_expected", "residual", "residual_z", "serves_deprived",
                        "beating_odds")
    return (unit_trends.withColumn("is_latest", F.when(F.col("recency") == 1, 1).otherwise(0))
            .join(model, ["unit_id", "period"], "left")
            .withColumn("beating_odds", F.coalesce("beating_odds", F.lit(0)))
            .select(*UNIT_COLUMNS))


def dash_areas(area_trends: DataFrame, areas: DataFrame) -> DataFrame:
    """One row per area and period, with the area's deprivation and map point."""
    place = areas.select("area_code", "latitude", "longitude", "zone_score_avg", "pct_pop_most_deprived",
                         "zone_score_rank")
    return area_trends.join(place, "area_code", "left").select(*AREA_COLUMNS)


def count_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many rows there are of each kind, such as evidence, or lineage method by source of the place."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def top_gaps(area_trends: DataFrame, k: int = 10) -> DataFrame:
    """The areas whose focus group is furthest behind, latest period."""
    return (area_trends.filter(F.col("is_latest") == 1)
            .orderBy("rank_gap_vs_benchmark", "area_code").limit(k)
            .select("area_name", "region", "rank_gap_vs_benchmark", "gap_vs_benchmark", "gap_within_area", "n_focus",
                    "trend"))


def greatest_need(area_ranking: DataFrame, k: int = 10) -> DataFrame:
    """The areas with the largest total shortfall in the latest period of the table."""
    latest = area_ranking.agg(F.max("period")).scalar()
    return (area_ranking.filter(F.col("period") == latest).orderBy("rank_scale_of_need", "area_code").limit(k)
            .select("area_name", "region", "n_focus", "gap_vs_benchmark", "scale_of_need", "rank_scale_of_need"))


def consistent_in_region(listed: DataFrame, region: str) -> DataFrame:
    """Units that beat the odds in two or more periods, in one region."""
    return (listed.filter((F.col("region") == region) & F.col("evidence").startswith(CONSISTENT.split(" ")[0]))
            .orderBy(F.desc("periods_beating_odds"), F.desc("avg_residual_z"))
            .select("unit_name", "area_name", "unit_type", "zone_decile", "pct_focus", "score_focus",
                    "score_focus_expected", "periods_beating_odds", "periods_in_model"))


def units_of_area(dash: DataFrame, area_name: str) -> DataFrame:
    """Every unit of one area in its latest period, widest gap first."""
    return (dash.filter((F.col("area_name") == area_name) & (F.col("is_latest") == 1))
            .orderBy(F.col("gap_vs_benchmark").desc_nulls_last())
            .select("unit_name", "n_focus", "pct_focus", "score_focus", "gap_vs_benchmark", "change_gap_vs_benchmark",
                    "beating_odds"))
