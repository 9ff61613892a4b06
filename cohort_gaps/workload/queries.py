"""Every operator as a query over the shared tables."""
from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import weighted_mean
from ..operators import cleaning, dedupe, intervals, joins, ranking
from ..operators.components import connected_components
from ..plans import areas, marts, odds, panel, selection, trends
from ..plans.lineage import build_lineage, lineage_clashes, one_to_one_links
from ..plans.params import params_pivot
from ..plans.units import FROM_ID, build_units, coalesce_attrs
from ..session import cut_lineage
from ..sources import sinks
from ..sources.layouts import REGISTER_SENTINELS
from ..sources.register import tidy_directory, tidy_links, tidy_register, tidy_zones
from ..sources.results import derive_counts, merge_results, slim_long, slim_wide, tidy_long, tidy_wide
from . import standin_files as sf
from . import standins as st
from .present import present
from .standins import Tables


class Panel:
    """The composed plans over one scale. ``reuse`` writes the unit-period base once, for the plans that read it several
    times; the others read the source once anyway."""

    def __init__(self, t: Tables, reuse: bool):
        self.t, self.reuse = t, reuse

    @cached_property
    def params(self) -> DataFrame:
        return st.params(self.t)

    @cached_property
    def results(self) -> DataFrame:
        return st.results(self.t)

    @cached_property
    def base(self) -> DataFrame:
        table = panel.unit_base(self.results, st.units(self.t), st.zones(self.t), self.params)
        return cut_lineage(table) if self.reuse else table

    @cached_property
    def bench(self) -> DataFrame:
        return panel.benchmark(self.base)

    @cached_property
    def gaps(self) -> DataFrame:
        return panel.unit_gaps(self.base, self.bench)

    @cached_property
    def area_period(self) -> DataFrame:
        return panel.area_period(self.base, self.bench)

    @cached_property
    def area_ranking(self) -> DataFrame:
        return panel.area_ranking(self.area_period)

    @cached_property
    def area_trends(self) -> DataFrame:
        return trends.area_trends(self.area_ranking)

    @cached_property
    def eligible(self) -> DataFrame:
        return odds.odds_eligible(self.gaps)

    @cached_property
    def model(self) -> DataFrame:
        return odds.odds_model(odds.odds_eligible(self.base))

    @cached_property
    def residuals(self) -> DataFrame:
        return odds.odds_residuals(self.eligible, self.model)

    @cached_property
    def odds(self) -> DataFrame:
        return odds.odds_flagged(self.residuals, self.params)

    @cached_property
    def listed(self) -> DataFrame:
        return odds.beating_the_odds(self.odds)

    @cached_property
    def dash_units(self) -> DataFrame:
        return marts.dash_units(trends.unit_trends(self.gaps), self.odds)

    @cached_property
    def areas(self) -> DataFrame:
        return areas.build_areas(st.units(self.t), st.area_register(self.t), st.area_zones(self.t))

    @cached_property
    def dash_areas(self) -> DataFrame:
        return marts.dash_areas(self.area_trends, self.areas)


def _weighted_means(p: Panel) -> DataFrame:
    pairs = [("n_focus", "score_focus"), ("n_rest", "score_rest"), ("n_focus", "basics_focus"),
             ("n_rest", "basics_rest"), ("n_focus", "progress_focus")]
    return p.base.groupBy("region").agg(*[weighted_mean(w, x).alias(x) for w, x in pairs])


def _trend_series(p: Panel) -> DataFrame:
    ranked = p.area_ranking
    return trends.trend_series(p.bench, ranked, ranked.agg(F.min("area_code")).scalar())


PANEL_QUERIES: dict[str, Callable[[Panel], DataFrame]] = {
    "params_pivot": lambda p: params_pivot(p.params),
    "unit_base": lambda p: p.base,
    "weighted_means": _weighted_means,
    "benchmark": lambda p: p.bench,
    "unit_gaps": lambda p: p.gaps,
    "area_period": lambda p: p.area_period,
    "area_ranking": lambda p: p.area_ranking,
    "coverage_by_period": lambda p: panel.coverage_by_period(p.base),
    "odds_eligible": lambda p: p.eligible,
    "ols_by_period": lambda p: p.model,
    "odds_residuals": lambda p: p.residuals,
    "odds_flagged": lambda p: p.odds,
    "odds_ranked": lambda p: odds.odds_ranked(p.odds),
    "beating_the_odds": lambda p: p.listed,
    "evidence_counts": lambda p: marts.count_by(p.listed, ["evidence"]),
    "q6_model_summary": lambda p: odds.model_summary(p.odds),
    "q4_consistent_in_region": lambda p: marts.consistent_in_region(p.listed, "ASIA"),
    "benchmark_trends": lambda p: trends.benchmark_trends(p.bench),
    "area_trends": lambda p: p.area_trends,
    "unit_trends": lambda p: trends.unit_trends(p.gaps),
    "q3_widening_twice": lambda p: trends.widening_twice(p.area_trends),
    "trend_series": _trend_series,
    "dash_units": lambda p: p.dash_units,
    "dash_areas": lambda p: p.dash_areas,
    "extract_units": lambda p: sinks.extract({"dash_units": p.dash_units}, "units"),
    "extract_areas": lambda p: sinks.extract({"dash_areas": p.dash_areas}, "areas"),
    "q1_top_gaps": lambda p: marts.top_gaps(p.area_trends),
    "q2_scale_of_need": lambda p: marts.greatest_need(p.area_ranking),
    "q5_one_area": lambda p: marts.units_of_area(p.dash_units, "NATION_4"),
    "kpi_tiles": lambda p: selection.kpi_tiles(p.dash_units, p.listed, region="ASIA"),
    "area_ranking_selected": lambda p: selection.area_ranking_selected(p.dash_units, "scale_of_need"),
    "largest_areas": lambda p: selection.largest_areas(
        selection.area_ranking_selected(p.dash_units, "scale_of_need", period_label="1999-00"), "selected", 15),
    "class_breaks": lambda p: ranking.class_breaks(p.area_period, "scale_of_need", 5),
    "kpi_tiles_of_type": lambda p: selection.kpi_tiles(p.dash_units, p.listed, unit_type="LA maintained",
                                                       period_label="1998-99"),
    "area_ranking_by_gap": lambda p: selection.area_ranking_selected(p.dash_units, "gap_vs_benchmark", region="EUROPE"),
    "area_ranking_within": lambda p: selection.area_ranking_selected(p.dash_units, "gap_within_area",
                                                                     unit_type="Academy (converter)"),
    "smallest_areas": lambda p: selection.largest_areas(
        selection.area_ranking_selected(p.dash_units, "scale_of_need", period_label="1999-00"), "selected", 5, smallest=True),
    "dim_regions": lambda p: selection.dim_values([p.dash_units, p.dash_areas], "region"),
    "extract_odds": lambda p: sinks.extract({"beating_the_odds": p.listed}, "beating_the_odds"),
    "extract_benchmark": lambda p: sinks.extract({"benchmark_trends": trends.benchmark_trends(p.bench)}, "benchmark"),
    "json_areas": lambda p: sinks.json_extract(p.dash_areas, ["period_label", "area_code", "latitude", "zone_score_avg",
                                                              "gap_vs_benchmark", "trend", "absent"]),
    "dim_values": lambda p: selection.dim_values([p.dash_units, p.dash_areas], "period_label"),
    "area_profile": lambda p: areas.area_profile(st.units(p.t)),
    "area_deprivation": lambda p: p.areas,
    "mode_by_group": lambda p: areas.district_areas(st.area_register(p.t)),
}


def _lineage_units(t: Tables) -> DataFrame:
    rows = sf.order_results(t)
    lineages = build_lineage(rows, cut_lineage(sf.order_register(t)), sf.order_links(t))
    linked = rows.select("unit_id").join(lineages, "unit_id", "left")
    # A lineage has at most one row per period.
    return linked.withColumn("n_periods", F.count(F.lit(1)).over(Window.partitionBy("lineage_id")))


def _components(t: Tables) -> DataFrame:
    return connected_components(one_to_one_links(sf.order_links(t)), "pred", "succ")


def _clashes(t: Tables) -> DataFrame:
    groups = _components(t).withColumnRenamed("node", "unit_id")
    years = sf.order_results(t).join(groups, "unit_id", "left")
    return lineage_clashes(years.withColumn("component", F.coalesce("component", "unit_id")))


def _first_non_null(t: Tables) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    rows = t.orders.select("o_custkey", "o_orderkey", price.alias("price"), priority.alias("priority"))
    return dedupe.first_non_null(rows, ["o_custkey"], ["price", "priority"], "o_orderkey")


def _clean_sentinels(t: Tables) -> DataFrame:
    rows = cleaning.null_sentinels(sf.messy_customers(t), ["region", "area_name"], REGISTER_SENTINELS)
    return cleaning.null_unless_both_positive(rows, "easting", "northing")


def _found(t: Tables) -> DataFrame:
    return joins.join_with_source(sf.part_units(t), sf.part_register(t), "unit_id", FROM_ID)


def _coverage(t: Tables) -> DataFrame:
    known = t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.match_rate(t.orders, known, "o_custkey")


def _build_units(t: Tables) -> DataFrame:
    register = cut_lineage(sf.order_register(t).filter("easting > 20000"))
    return build_units(sf.order_results(t), register, sf.order_links(t), sf.order_directory(t))


def _long_names(t: Tables) -> DataFrame:
    parts = sf.worded_parts(t)
    known = parts.filter("NOT is_missing")
    return joins.best_name_match(parts.filter("is_missing").withColumnsRenamed({"name": "result_name",
                                                                                "postcode": "result_postcode"}),
                                 known.withColumnRenamed("name", "unit_name"), [], min_similarity=0.1)


# What the interval joins read of a register.
DATED = ["unit_id", "unit_name", "postcode", "open_date", "close_date"]

TABLE_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "wide_results": lambda t: tidy_wide(sf.wide_file(t), F.col("period")),
    "long_to_wide": lambda t: tidy_long(sf.long_file(t)),
    "source_precedence": lambda t: merge_results(*sf.two_sources(t)),
    "slim_wide": lambda t: slim_wide(sf.wide_file(t)),
    "slim_long": lambda t: slim_long(sf.long_file(t)),
    "clean_numeric": lambda t: cleaning.clean_numeric(sf.messy_customers(t), ["amount", "share"]),
    "clean_code": lambda t: cleaning.clean_codes(sf.messy_customers(t), ["code"]),
    "period_label": lambda t: cleaning.label_periods(sf.period_texts(t), "period_text"),
    "sentinel_null": _clean_sentinels,
    "parse_dates": lambda t: cleaning.iso_dates(cleaning.parse_dates(sf.date_texts(t), ["open_date"]), ["open_date"]),
    "categorise": lambda t: cleaning.categorise_units(sf.typed_parts(t)),
    "rank_to_score": lambda t: cleaning.rank_to_score(sf.ranked_zones(t)),
    "derive_counts": lambda t: derive_counts(sf.gappy_counts(t)),
    "locate_points": lambda t: cleaning.locate_points(sf.grid_points(t)),
    "coalesce_attrs": lambda t: coalesce_attrs(_found(t)),
    "join_with_source": _found,
    "units_missing": lambda t: joins.units_missing(sf.part_units(t), sf.part_register(t)),
    "best_name_match": lambda t: joins.best_name_match(
        joins.units_missing(sf.part_units(t), sf.part_register(t)),
        sf.part_register(t).join(t.part.select(F.col("p_partkey").alias("unit_id"), "p_name"), "unit_id"),
        ["area_code", "latitude"], name=("result_name", "p_name")),
    "interval_similarity_join": lambda t: connected_components(
        intervals.interval_similarity_edges(cut_lineage(sf.order_register(t).select(*DATED))), "unit", "centre"),
    "long_name_match": lambda t: _long_names(t),
    "similar_partners": lambda t: intervals.interval_partners(cut_lineage(sf.worded_orders(t).select(*DATED))),
    "tidy_register": lambda t: tidy_register(sf.register_file(t)),
    "tidy_links": lambda t: tidy_links(sf.links_file(t)),
    "tidy_zones": lambda t: tidy_zones(sf.zones_file(t)),
    "tidy_directory": lambda t: tidy_directory(sf.directory_file(t)),
    "unit_sources": lambda t: marts.count_by(_build_units(t), ["lineage_method", "location_source"]),
    "lookup_fill": lambda t: joins.lookup_fill(*sf.part_zones(t), "postcode", "zone_code"),
    "coverage_rates": _coverage,
    "units": _build_units,
    "dedupe_largest": lambda t: dedupe.keep_largest(t.orders, ["o_custkey"], "o_totalprice", [F.col("o_orderkey")]),
    "latest_per_unit": lambda t: dedupe.latest_per_unit(st.results(t)),
    "dedupe_first": lambda t: dedupe.keep_first(t.orders, ["o_custkey"], [F.col("o_orderkey")]),
    "first_non_null": _first_non_null,
    "one_to_one_links": lambda t: one_to_one_links(sf.order_links(t)),
    "components": _components,
    "lineage": lambda t: build_lineage(sf.order_results(t), cut_lineage(sf.order_register(t)),
                                       sf.order_links(t)),
    "lineage_clashes": _clashes,
    "lineage_units": _lineage_units,
}


def _over_panel(key: str, build: Callable[[Panel], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    reuse = key not in ("params_pivot", "unit_base", "weighted_means", "benchmark", "benchmark_trends",
                        "coverage_by_period")
    return lambda spark, folder: present(build(Panel(Tables(spark, folder), reuse)), key)


def _over_tables(key: str, build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: present(build(Tables(spark, folder)), key)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {key: _over_panel(key, build) for key, build in PANEL_QUERIES.items()}
    out.update({key: _over_tables(key, build) for key, build in TABLE_QUERIES.items()})
    return out
