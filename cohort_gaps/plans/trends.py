"""Change against the previous period with data. Every window holds the periods of one area or lineage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _change(value: str, spec) -> Column:
    return F.col(value) - F.lag(value).over(spec)


def benchmark_trends(bench: DataFrame) -> DataFrame:
    """Previous label and change of the gap. The benchmark is one row per period, so one window may hold it all."""
    spec = Window.orderBy("period")
    return bench.select("*", F.lag("period_label").over(spec).alias("prev_period"),
                        _change("score_gap", spec).alias("change_score_gap"))


def area_trends(areas: DataFrame) -> DataFrame:
    """Changes, rank movement, 3-period average, baseline, index, label and latest flag per area."""
    spec = Window.partitionBy("area_code").orderBy("period")
    change = F.col("change_gap_vs_benchmark")
    label = (F.when(change.isNull(), None).when(change <= -1, "Narrowing").when(change >= 1, "Widening")
             .otherwise("Stable"))
    moved = areas.select(
        "*",
        F.lag("period_label").over(spec).alias("prev_period"),
        F.lag("gap_vs_benchmark").over(spec).alias("prev_gap_vs_benchmark"),
        _change("gap_vs_benchmark", spec).alias("change_gap_vs_benchmark"),
        _change("behind_benchmark_focus", spec).alias("change_behind_benchmark_focus"),
        (F.lag("rank_gap_vs_benchmark").over(spec) - F.col("rank_gap_vs_benchmark")).alias("rank_change"),
        F.avg("gap_vs_benchmark").over(spec.rowsBetween(-2, 0)).alias("gap_3_period_avg"),
        (F.col("gap_vs_benchmark") - F.first("gap_vs_benchmark").over(spec)).alias("change_since_first"),
        F.first("period_label").over(spec).alias("first_period"),
        F.row_number().over(spec).alias("period_index"),
        F.row_number().over(Window.partitionBy("area_code").orderBy(F.desc("period"))).alias("recency"))
    return moved.select("*", label.alias("trend"), F.when(F.col("recency") == 1, 1).otherwise(0).alias("is_latest"))


def unit_trends(gaps: DataFrame) -> DataFrame:
    """Changes and 3-period average per mainstream unit, followed through its lineage."""
    spec = Window.partitionBy("lineage_id").orderBy("period")
    return gaps.filter(F.col("is_mainstream") == 1).select(
        "*",
        F.lag("period_label").over(spec).alias("prev_period"),
        _change("gap_vs_benchmark", spec).alias("change_gap_vs_benchmark"),
        _change("score_focus", spec).alias("change_score_focus"),
        F.avg("gap_vs_benchmark").over(spec.rowsBetween(-2, 0)).alias("gap_3_period_avg"),
        F.row_number().over(Window.partitionBy("lineage_id").orderBy(F.desc("period"))).alias("recency"))


def widening_twice(trends: DataFrame) -> DataFrame:
    """Areas whose gap widened in two comparisons running."""
    spec = Window.partitionBy("area_code").orderBy("period")
    return (trends.select("area_name", "period_label", "change_gap_vs_benchmark",
                          F.lag("change_gap_vs_benchmark").over(spec).alias("prev_change"))
            .filter((F.col("change_gap_vs_benchmark") > 0) & (F.col("prev_change") > 0))
            .orderBy(F.desc("period_label"), F.desc("change_gap_vs_benchmark")))


def trend_series(bench: DataFrame, areas: DataFrame, area_code) -> DataFrame:
    """Two series over the periods: the benchmark gap and one area's gap against the benchmark."""
    one = areas.filter(F.col("area_code") == area_code)
    return (bench.select(F.lit("benchmark").alias("series"), "period_label", "period", F.col("score_gap").alias("gap"))
            .unionByName(one.select(F.col("area_name").alias("series"), "period_label", "period",
                                    F.col("gap_vs_benchmark").alias("gap")))
            .orderBy("series", "period"))
