"""One column list per query, used by both sides: names, and types for the comparison.

``s`` text, ``i`` whole number, ``d`` number rounded to 6 decimals, ``t`` date written as text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_UNIT = ("unit_id:i lineage_id:i unit_name:s postcode:s area_code:s area_name:s region:s unit_type:s type_name:s "
         "trust_name:s gender:s religious_character:s admissions:s setting:s latitude:d longitude:d zone_code:s "
         "zone_score:d zone_decile:i child_score:d child_decile:i")
_MEASURES = ("n_total:i n_focus:i n_rest:i pct_focus:d score_all:d score_focus:d score_rest:d progress_all:d "
             "progress_focus:d progress_rest:d basics_all:d basics_focus:d basics_rest:d")
_BASE = f"period_label:s period:i {_UNIT} {_MEASURES} is_mainstream:i reportable:i"
_GAPS = (f"{_BASE} gap_within_unit:d gap_vs_benchmark:d basics_gap_vs_benchmark:d benchmark_score_focus:d "
         "benchmark_score_rest:d")
_BENCH = ("period_label:s period:i n_units:i n_total:i n_focus:i score_focus:d score_rest:d basics_focus:d "
          "basics_rest:d pct_focus:d score_gap:d basics_gap:d")
_AREA = ("period_label:s period:i area_code:s area_name:s region:s n_units:i n_total:i n_focus:i "
         "n_focus_published:i score_focus:d score_rest:d basics_focus:d progress_focus:d pct_focus:d "
         "pct_focus_covered:d gap_within_area:d gap_vs_benchmark:d behind_benchmark_focus:d "
         "basics_gap_vs_benchmark:d scale_of_need:d benchmark_score_focus:d benchmark_score_rest:d")
_RANKED = (f"{_AREA} rank_gap_vs_benchmark:i rank_gap_within_area:i rank_scale_of_need:i rank_in_region:i "
           "n_areas_in_period:i")
_RESID = f"{_GAPS} n_in_model:i b0:d b_zone:d b_pct:d residual_sd:d score_focus_expected:d residual:d residual_z:d"
_FLAGGED = f"{_RESID} serves_deprived:i z_threshold:d beating_odds:i"
_DASH_UNITS = ("period_label:s period:i unit_id:i lineage_id:i unit_name:s postcode:s area_name:s region:s unit_type:s "
               "trust_name:s setting:s latitude:d longitude:d zone_decile:i child_decile:i n_total:i n_focus:i "
               "pct_focus:d reportable:i score_all:d score_focus:d score_rest:d progress_focus:d basics_focus:d "
               "basics_rest:d gap_within_unit:d gap_vs_benchmark:d basics_gap_vs_benchmark:d benchmark_score_rest:d "
               "prev_period:s change_gap_vs_benchmark:d gap_3_period_avg:d is_latest:i score_focus_expected:d "
               "residual:d residual_z:d serves_deprived:i beating_odds:i")
_DASH_AREAS = ("period_label:s period:i area_code:s area_name:s region:s latitude:d longitude:d zone_score_avg:d "
               "pct_pop_most_deprived:d zone_score_rank:i n_units:i n_total:i n_focus:i pct_focus:d "
               "pct_focus_covered:d score_focus:d score_rest:d benchmark_score_rest:d gap_within_area:d "
               "gap_vs_benchmark:d behind_benchmark_focus:d basics_focus:d basics_gap_vs_benchmark:d "
               "progress_focus:d scale_of_need:d rank_gap_vs_benchmark:i rank_gap_within_area:i "
               "rank_scale_of_need:i rank_in_region:i n_areas_in_period:i prev_period:s change_gap_vs_benchmark:d "
               "rank_change:i gap_3_period_avg:d change_since_first:d first_period:s trend:s is_latest:i")
_RESULTS = f"period_label:s period:i unit_id:i result_name:s result_postcode:s is_special:i {_MEASURES}"
_SELECTED = ("n_focus_published:i score_focus:d score_rest:d benchmark_score_rest:d gap_vs_benchmark:d "
             "gap_within_area:d gap_in_grades:d scale_of_need:d")

COLUMNS = {
    # base, benchmark, gaps, areas
    "params_pivot": "min_focus_cohort:d odds_z:d deprived_decile:d deprived_area_min_pct:d deprived_pct:d",
    "unit_base": _BASE,
    "weighted_means": "region:s score_focus:d score_rest:d basics_focus:d basics_rest:d progress_focus:d",
    "benchmark": _BENCH,
    "unit_gaps": _GAPS,
    "area_period": _AREA,
    "area_ranking": _RANKED,
    "coverage_by_period": "period_label:s n_rows:i n_mainstream:i n_with_measure:i n_without_zone:i "
                          "n_without_location:i",
    # odds
    "odds_eligible": _GAPS,
    "ols_by_period": "period:i n_in_model:i m1:d m2:d my:d b0:d b_zone:d b_pct:d residual_sd:d",
    "odds_residuals": _RESID,
    "odds_flagged": _FLAGGED,
    "odds_ranked": f"{_FLAGGED} rank_residual:i rank_residual_in_area:i",
    "beating_the_odds": "lineage_id:i unit_id:i unit_name:s area_code:s area_name:s region:s unit_type:s trust_name:s "
                        "postcode:s latitude:d longitude:d latest_period:s zone_decile:i pct_focus:d n_focus:i "
                        "score_focus:d score_focus_expected:d residual:d residual_z:d gap_vs_benchmark:d "
                        "gap_within_unit:d progress_focus:d basics_focus:d beating_odds_latest:i periods_in_model:i "
                        "periods_beating_odds:i avg_residual:d avg_residual_z:d evidence:s",
    "evidence_counts": "evidence:s n:i",
    "q6_model_summary": "period_label:s n_in_model:i b0:d b_zone:d b_pct:d residual_sd:d",
    "q4_consistent_in_region": "unit_name:s area_name:s unit_type:s zone_decile:i pct_focus:d score_focus:d "
                               "score_focus_expected:d periods_beating_odds:i periods_in_model:i",
    # trends
    "benchmark_trends": f"{_BENCH} prev_period:s change_score_gap:d",
    "area_trends": f"{_RANKED} prev_period:s prev_gap_vs_benchmark:d change_gap_vs_benchmark:d "
                   "change_behind_benchmark_focus:d rank_change:i gap_3_period_avg:d change_since_first:d "
                   "first_period:s period_index:i recency:i trend:s is_latest:i",
    "unit_trends": f"{_GAPS} prev_period:s change_gap_vs_benchmark:d change_score_focus:d gap_3_period_avg:d "
                   "recency:i",
    "q3_widening_twice": "area_name:s period_label:s change_gap_vs_benchmark:d prev_change:d",
    "trend_series": "series:s period_label:s period:i gap:d",
    # flat tables and questions
    "dash_units": _DASH_UNITS,
    "dash_areas": _DASH_AREAS,
    "extract_units": _DASH_UNITS,
    "extract_areas": _DASH_AREAS,
    "q1_top_gaps": "area_name:s region:s rank_gap_vs_benchmark:i gap_vs_benchmark:d gap_within_area:d n_focus:i "
                   "trend:s",
    "q2_scale_of_need": "area_name:s region:s n_focus:i gap_vs_benchmark:d scale_of_need:d rank_scale_of_need:i",
    "q5_one_area": "unit_name:s n_focus:i pct_focus:d score_focus:d gap_vs_benchmark:d change_gap_vs_benchmark:d "
                   "beating_odds:i",
    # selections
    "kpi_tiles": f"period_label:s {_SELECTED} n_consistent:i",
    "area_ranking_selected": f"period_label:s area_name:s {_SELECTED} selected:d dense_rank:i",
    "largest_areas": f"period_label:s area_name:s {_SELECTED} selected:d dense_rank:i",
    "kpi_tiles_of_type": f"period_label:s {_SELECTED} n_consistent:i",
    "area_ranking_by_gap": f"period_label:s area_name:s {_SELECTED} selected:d dense_rank:i",
    "area_ranking_within": f"period_label:s area_name:s {_SELECTED} selected:d dense_rank:i",
    "smallest_areas": f"period_label:s area_name:s {_SELECTED} selected:d dense_rank:i",
    "dim_regions": "region:s",
    "extract_odds": "lineage_id:i unit_id:i unit_name:s periods_beating_odds:i avg_residual_z:d evidence:s",
    "extract_benchmark": "period_label:s period:i n_units:i score_focus:d score_rest:d prev_period:s change_score_gap:d",
    "json_areas": "period_label:s area_code:s latitude:d zone_score_avg:d gap_vs_benchmark:d trend:s",
    "class_breaks": "period:i area_code:s scale_of_need:d break_1:d break_2:d break_3:d break_4:d class:i",
    "dim_values": "period_label:s",
    # area dimension
    "area_profile": "area_code:s area_name:s region:s latitude:d longitude:d n_units:i",
    "area_deprivation": "area_code:s area_name:s region:s latitude:d longitude:d n_units:i zone_score_avg:d "
                        "pct_pop_most_deprived:d zone_score_rank:i",
    "mode_by_group": "district_code:s area_code:s",
    # results layouts
    "wide_results": _RESULTS,
    "long_to_wide": _RESULTS,
    "source_precedence": f"{_RESULTS} source:s",
    "slim_wide": "RECTYPE:s LEA:s URN:s SCHNAME:s PCODE:s TPUP:s TFSM6CLA1A:s TNOTFSM6CLA1A:s PTFSM6CLA1A:s ATT8SCR:s "
                 "ATT8SCR_FSM6CLA1A:s ATT8SCR_NFSM6CLA1A:s P8MEA:s P8MEA_FSM6CLA1A:s P8MEA_NFSM6CLA1A:s "
                 "PTL2BASICS_94:s PTFSM6CLA1ABASICS_94:s PTNOTFSM6CLA1ABASICS_94:s",
    "slim_long": "time_period:s school_urn:s school_name:s establishment_type_group:s breakdown_topic:s "
                 "disadvantage_status:s pupil_count:s attainment8_average:s progress8_average:s engmath_94_percent:s",
    # clean-up
    "clean_numeric": "c_custkey:i amount:d share:d",
    "clean_code": "c_custkey:i code:s",
    "period_label": "o_orderkey:i period_label:s period:i",
    "sentinel_null": "c_custkey:i region:s area_name:s easting:d northing:d",
    "parse_dates": "o_orderkey:i open_date:s",
    "categorise": "p_partkey:i unit_type:s",
    "rank_to_score": "zone_code:s zone_rank:d zone_score:d zone_decile:i",
    "derive_counts": "unit_id:i period:i n_total:i n_focus:i n_rest:i pct_focus:d",
    "locate_points": "c_custkey:i latitude:d longitude:d",
    "coalesce_attrs": "unit_id:i unit_name:s postcode:s unit_type:s",
    # joins
    "join_with_source": "unit_id:i unit_name:s location_source:s",
    "units_missing": "unit_id:i result_name:s result_postcode:s",
    "best_name_match": "unit_id:i match_id:i similarity:d area_code:s latitude:d",
    "long_name_match": "unit_id:i match_id:i similarity:d",
    "similar_partners": "unit:i n_after:i n_before:i",
    "tidy_register": "unit_id:i unit_name:s postcode:s area_code:s region:s unit_type:s open_date:t",
    "tidy_links": "unit_id:i link_id:i link_type:s",
    "tidy_zones": "zone_code:s district_name:s zone_score:d zone_rank:d zone_decile:i population:d",
    "tidy_directory": "postcode:s zone_code:s",
    "unit_sources": "lineage_method:s location_source:s n:i",
    "interval_similarity_join": "node:i component:i",
    "lookup_fill": "unit_id:i postcode:s zone_code:s",
    "coverage_rates": "n_rows:i rate:d is_low:i",
    "units": "unit_id:i lineage_id:i lineage_method:s unit_name:s postcode:s area_code:s area_name:s region:s "
             "unit_type:s zone_code:s open_date:s close_date:s location_source:s",
    # dedupe
    "dedupe_largest": "o_custkey:i o_orderkey:i o_totalprice:d",
    "latest_per_unit": "unit_id:i period:i n_total:i",
    "dedupe_first": "o_custkey:i o_orderkey:i o_orderpriority:s",
    "first_non_null": "o_custkey:i price:d priority:s",
    # lineage
    "one_to_one_links": "pred:i succ:i",
    "components": "node:i component:i",
    "lineage": "unit_id:i lineage_id:i lineage_method:s",
    "lineage_clashes": "component:i period:i n_units:i",
    "lineage_units": "unit_id:i lineage_id:i lineage_method:s n_periods:i",
}


def _fields(key: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in COLUMNS[key].split()]


def present(df: DataFrame, key: str) -> DataFrame:
    """The query's columns in the types both sides agree on."""
    def shown(name: str, kind: str):
        column = F.col(name)
        if kind == "i":
            column = column.cast("bigint")
        elif kind == "d":
            column = F.round(column.cast("double"), 6)
        else:
            column = column.cast("string")
        return column.alias(name)

    return df.select(*[shown(*field) for field in _fields(key)])


def present_sql(relation: str, key: str) -> str:
    """The same columns as a SQL select list over ``relation``."""
    def shown(name: str, kind: str) -> str:
        if kind == "i":
            return f"CAST({name} AS BIGINT) AS {name}"
        if kind == "d":
            return f"round(CAST({name} AS DOUBLE), 6) + 0.0 AS {name}"
        return f"CAST({name} AS VARCHAR) AS {name}"

    return f"SELECT {', '.join(shown(*field) for field in _fields(key))} FROM {relation}"
