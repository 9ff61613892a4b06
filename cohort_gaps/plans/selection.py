"""Measures over a reader's selection: filters first, then weights, then ranks."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rank_key, weighted_mean
from ..operators.ranking import small_rank
from .odds import CONSISTENT

SELECTABLE = ("gap_vs_benchmark", "gap_within_area", "scale_of_need")


def select_rows(df: DataFrame, period_label: str | None = None, region: str | None = None,
                unit_type: str | None = None) -> DataFrame:
    """Rows of the chosen period, region and type; None stands for all."""
    chosen = {"period_label": period_label, "region": region, "unit_type": unit_type}
    return reduce(lambda d, c: d.filter(F.col(c[0]) == c[1]), [(k, v) for k, v in chosen.items() if v is not None], df)


def selection_measures(rows: DataFrame, by: list[str]) -> DataFrame:
    """Focus and rest means, gaps and need per group of the selected rows of the unit table.

    The rest is weighted by total minus focus here, not by its published count.
    """
    published = F.col("score_focus").isNotNull()
    sums = rows.groupBy(*by).agg(
        F.sum(F.when(published, F.col("n_focus"))).alias("n_focus_published"),
        weighted_mean("n_focus", "score_focus").alias("score_focus"),
        weighted_mean(F.col("n_total") - F.col("n_focus"), F.col("score_rest")).alias("score_rest"),
        F.avg("benchmark_score_rest").alias("benchmark_score_rest"))
    gap = F.col("benchmark_score_rest") - F.col("score_focus")
    return sums.select("*", gap.alias("gap_vs_benchmark"),
                       (F.col("score_rest") - F.col("score_focus")).alias("gap_within_area"),
                       (gap / F.lit(10.0)).alias("gap_in_grades"),
                       (F.col("n_focus_published") * gap / F.lit(10.0)).alias("scale_of_need"))


def kpi_tiles(units: DataFrame, listed: DataFrame, region: str | None = None, unit_type: str | None = None,
              period_label: str | None = None) -> DataFrame:
    """The tiles per period of the selection, with the number of units that consistently beat the odds in it."""
    tiles = selection_measures(select_rows(units, period_label, region, unit_type), ["period_label"])
    consistent = select_rows(listed, region=region, unit_type=unit_type).filter(
        F.col("evidence").startswith(CONSISTENT.split(" ")[0]))
    return tiles.withColumn("n_consistent", consistent.agg(F.countDistinct("lineage_id")).scalar())


def choose_measure(name: Column | str) -> Column:
    """One of the three measures by name, as a literal or as a column of names; an unknown name gives NULL."""
    name = F.lit(name) if isinstance(name, str) else name
    first, *others = SELECTABLE
    return reduce(lambda c, m: c.when(name == m, F.col(m)), others, F.when(name == first, F.col(first)))


def area_ranking_selected(units: DataFrame, measure: str = "gap_vs_benchmark", period_label: str | None = None,
                          region: str | None = None, unit_type: str | None = None) -> DataFrame:
    """Areas of the selection with the chosen measure and its dense rank per period."""
    if measure not in SELECTABLE:
        raise ValueError(f"measure must be one of {SELECTABLE}")
    rows = select_rows(units, period_label, region, unit_type)
    areas = selection_measures(rows, ["period_label", "area_name"]).withColumn("selected", choose_measure(measure))
    return areas.withColumn("dense_rank", small_rank(["period_label"], rank_key("selected"), dense=True))


def largest_areas(areas: DataFrame, measure: str, k: int = 15, smallest: bool = False) -> DataFrame:
    """Top (or bottom) areas by a measure, those without it left out, ties by name."""
    value = F.col(measure)
    return (areas.filter(value.isNotNull())
            .orderBy(value.asc() if smallest else value.desc(), "area_name").limit(k))


def dim_values(tables: list[DataFrame], column: str) -> DataFrame:
    """A shared filter list: the distinct values of a column over several tables."""
    parts = [t.select(column).filter(F.col(column).isNotNull()).distinct() for t in tables]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()
