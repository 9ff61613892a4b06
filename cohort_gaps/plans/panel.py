"""Unit-period base, benchmark per period, gaps, and the area ranking."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import percent, rank_key, weighted_mean
from ..operators.ranking import small_rank
from .params import param

MEASURES = ("score", "progress", "basics")
GROUPS = ("all", "focus", "rest")
MEASURE_COLUMNS = [f"{m}_{g}" for m in MEASURES for g in GROUPS]
COUNT_COLUMNS = ["n_total", "n_focus", "n_rest", "pct_focus"]

NOT_MAINSTREAM = ("Special", "Independent")

_UNIT_FIELDS = ["lineage_id", "unit_name", "postcode", "area_code", "area_name", "region", "unit_type", "type_name",
                "trust_name", "gender", "religious_character", "admissions", "setting", "latitude", "longitude",
                "zone_code"]
_ZONE_FIELDS = ["zone_score", "zone_decile", "child_score", "child_decile"]


def unit_base(results: DataFrame, units: DataFrame, zones: DataFrame, params: DataFrame) -> DataFrame:
    """One row per unit and period with the unit's attributes, its zone's scores and the two usage flags."""
    mainstream = (F.col("is_special") == 0) & ~F.col("unit_type").isin(*NOT_MAINSTREAM)
    reportable = F.col("n_focus") >= param(params, "min_focus_cohort")
    return (results.join(units.select("unit_id", *_UNIT_FIELDS), "unit_id")
            .join(zones.select("zone_code", *_ZONE_FIELDS), "zone_code", "left")
            .select("period_label", "period", "unit_id", *_UNIT_FIELDS, *_ZONE_FIELDS, *COUNT_COLUMNS, *MEASURE_COLUMNS,
                    F.when(mainstream, 1).otherwise(0).alias("is_mainstream"),
                    F.when(reportable, 1).otherwise(0).alias("reportable")))


def mainstream_only(base: DataFrame) -> DataFrame:
    return base.filter(F.col("is_mainstream") == 1)


def benchmark(base: DataFrame) -> DataFrame:
    """Per period over mainstream units: counts, weighted means of the published figures, and the two gaps."""
    totals = mainstream_only(base).groupBy("period_label", "period").agg(
        F.count(F.lit(1)).alias("n_units"),
        F.sum("n_total").alias("n_total"),
        F.sum("n_focus").alias("n_focus"),
        *[weighted_mean(f"n_{g}", f"{m}_{g}").alias(f"{m}_{g}")
          for m in ("score", "basics") for g in ("focus", "rest")])
    return totals.select(
        "*",
        percent("n_focus", "n_total").alias("pct_focus"),
        (F.col("score_rest") - F.col("score_focus")).alias("score_gap"),
        (F.col("basics_rest") - F.col("basics_focus")).alias("basics_gap"))


def per_period(table: DataFrame) -> DataFrame:
    """A table with one row per period, for broadcasting. The job fails on a period that is no four-digit year, so the
    table has at most 10,000 rows."""
    year = F.when(F.col("period").between(0, 9999), F.col("period")).otherwise(
        F.raise_error(F.lit("a period must be a four-digit year")).cast("int"))
    return F.broadcast(table.withColumn("period", year))


def _benchmark_lookup(bench: DataFrame) -> DataFrame:
    return per_period(bench.select("period", F.col("score_focus").alias("benchmark_score_focus"),
                                    F.col("score_rest").alias("benchmark_score_rest"),
                                    F.col("basics_rest").alias("_benchmark_basics_rest")))


def unit_gaps(base: DataFrame, bench: DataFrame) -> DataFrame:
    """Three gaps per row: inside the unit, against the benchmark, and against the benchmark on the second measure."""
    return (base.join(_benchmark_lookup(bench), "period").select(
        *base.columns,
        (F.col("score_rest") - F.col("score_focus")).alias("gap_within_unit"),
        (F.col("benchmark_score_rest") - F.col("score_focus")).alias("gap_vs_benchmark"),
        (F.col("_benchmark_basics_rest") - F.col("basics_focus")).alias("basics_gap_vs_benchmark"),
        "benchmark_score_focus", "benchmark_score_rest"))


def area_period(base: DataFrame, bench: DataFrame) -> DataFrame:
    """Per area and period: weighted means, coverage, three gaps and the scale of need. Aggregates before the join."""
    areas = mainstream_only(base).filter(F.col("area_code").isNotNull())
    totals = areas.groupBy("period_label", "period", "area_code").agg(
        F.max("area_name").alias("area_name"),
        F.max("region").alias("region"),
        F.count(F.lit(1)).alias("n_units"),
        F.sum("n_total").alias("n_total"),
        F.sum("n_focus").alias("n_focus"),
        F.sum(F.when(F.col("score_focus").isNotNull(), F.col("n_focus"))).alias("n_focus_published"),
        weighted_mean("n_focus", "score_focus").alias("score_focus"),
        weighted_mean("n_rest", "score_rest").alias("score_rest"),
        weighted_mean("n_focus", "basics_focus").alias("basics_focus"),
        weighted_mean("n_focus", "progress_focus").alias("progress_focus"))
    gap = F.col("benchmark_score_rest") - F.col("score_focus")
    return totals.join(_benchmark_lookup(bench), "period").select(
        *totals.columns,
        percent("n_focus", "n_total").alias("pct_focus"),
        percent("n_focus_published", "n_focus").alias("pct_focus_covered"),
        (F.col("score_rest") - F.col("score_focus")).alias("gap_within_area"),
        gap.alias("gap_vs_benchmark"),
        (F.col("benchmark_score_focus") - F.col("score_focus")).alias("behind_benchmark_focus"),
        (F.col("_benchmark_basics_rest") - F.col("basics_focus")).alias("basics_gap_vs_benchmark"),
        (F.col("n_focus_published") * gap / F.lit(10.0)).alias("scale_of_need"),
        "benchmark_score_focus", "benchmark_score_rest")


def area_ranking(areas: DataFrame) -> DataFrame:
    """Four ranks per area and period. The windows hold one row per area, however many units stand behind it."""
    def rank(value: str, *groups: str) -> Column:
        return small_rank(["period", *groups], rank_key(value))

    return areas.select(
        "*",
        rank("gap_vs_benchmark").alias("rank_gap_vs_benchmark"),
        rank("gap_within_area").alias("rank_gap_within_area"),
        rank("scale_of_need").alias("rank_scale_of_need"),
        rank("gap_vs_benchmark", "region").alias("rank_in_region"),
        F.count(F.lit(1)).over(Window.partitionBy("period")).alias("n_areas_in_period"))


def coverage_by_period(base: DataFrame) -> DataFrame:
    """Per period: rows, mainstream rows, rows with a focus score, rows without a zone score or a map point."""
    return base.groupBy("period_label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("is_mainstream").alias("n_mainstream"),
        F.count_if(F.col("score_focus").isNotNull()).alias("n_with_measure"),
        F.count_if(F.col("zone_score").isNull()).alias("n_without_zone"),
        F.count_if(F.col("latitude").isNull()).alias("n_without_location"))
