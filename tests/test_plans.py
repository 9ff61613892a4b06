import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_gaps.operators.regression import ols_two
from cohort_gaps.plans import areas, lineage, marts, odds, panel, selection, trends
from cohort_gaps.plans.params import params_pivot, params_table
from cohort_gaps.plans.units import build_units
from cohort_gaps.workload import standins as st
from cohort_gaps.workload.queries import Panel
from cohort_gaps.workload.standins import Tables


@pytest.fixture(scope="module")
def country(spark, sf_dir):
    return Panel(Tables(spark, sf_dir.replace("0.001", "0.01")), reuse=True)


@pytest.fixture(scope="module")
def gaps(country):
    return country.gaps.cache()


@pytest.fixture(scope="module")
def flagged(country, gaps):
    return odds.odds(gaps, country.params).cache()


# --- regression --------------------------------------------------------------------------------------------------

def fit(spark, rows):
    return {r.g: r for r in ols_two(spark.createDataFrame(rows, "g int, y double, a double, b double"), ["g"], "y", "a",
                                    "b").collect()}


def test_ols_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(20, 9, 400), rng.normal(30, 12, 400)
    y = 50 - 0.3 * a + 0.1 * b + rng.normal(0, 4, 400)
    got = fit(spark, [(1, *map(float, r)) for r in zip(y, a, b)])[1]
    x = np.column_stack([np.ones(400), a, b])
    coef, *_ = np.linalg.lstsq(x, y, rcond=None)
    assert (got.b0, got.b1, got.b2) == pytest.approx(tuple(coef), rel=1e-9)
    assert got.residual_sd == pytest.approx(float(np.sqrt(np.sum((y - x @ coef) ** 2) / 397)), rel=1e-9)


def test_close_fit_keeps_its_digits(spark):
    rng = np.random.default_rng(3)
    x1, x2 = rng.uniform(0, 50, 40), rng.uniform(10, 30, 40)
    y = 3 + 0.5 * x1 - 0.25 * x2 + rng.normal(scale=1e-6, size=40)
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(x1, x2, y)],
                               "g int, x1 double, x2 double, y double")
    row = ols_two(df, ["g"], "y", "x1", "x2").first()
    design = np.stack([np.ones(40), x1, x2], 1)
    fit = np.linalg.lstsq(design, y, rcond=None)[0]
    assert row.residual_sd == pytest.approx(np.sqrt(((y - design @ fit) ** 2).sum() / 37), rel=1e-8)


def test_small_and_collinear_groups(spark):
    rows = [(1, 5.0, 1.0, 2.0), (2, 5.0, 1.0, 2.0), (2, 6.0, 2.0, 7.0), (3, 5.0, 1.0, 2.0), (3, 6.0, 2.0, 7.0),
            (3, 9.0, 3.0, 1.0)]
    rows += [(4, float(i * i), float(i), 2.0 * i + 1) for i in range(5)]
    rows += [(5, float(i), float(i), float(i * i)) for i in range(6)]
    got = fit(spark, rows)
    assert all(got[g].residual_sd is None for g in (1, 2, 3, 4))
    assert got[1].b1 is None and got[2].b1 is None and got[3].b1 is not None
    assert got[4].b1 is None and got[4].b2 is None
    assert got[5].b1 == pytest.approx(1.0) and got[5].residual_sd == pytest.approx(0.0, abs=1e-6)


def test_no_flag_without_a_spread(spark, country):
    """A period with three rows has no standard error, so nothing in it can beat the odds."""
    kind = ("period int, period_label string, unit_id long, is_mainstream int, admissions string, reportable int, "
            "score_focus double, zone_score double, zone_decile int, pct_focus double")
    rows = [(2000 + n, "x", 10 * n + i, 1, None, 1, 40.0 + i * i, 10.0 + i, 1, 50.0 + (i % 2)) for n in (1, 2, 3)
            for i in range(n)]
    out = odds.odds(spark.createDataFrame(rows, kind), params_table(spark)).collect()
    assert len(out) == 6
    assert all(r.residual_sd is None and r.residual_z is None and r.beating_odds == 0 for r in out)


def test_residuals_per_period(flagged):
    rows = flagged.select("period", "score_focus", "zone_score", "pct_focus", "residual", "residual_sd", "residual_z").toPandas()
    assert rows["period"].nunique() == 7
    for _, part in rows.groupby("period"):
        x = np.column_stack([np.ones(len(part)), part["zone_score"], part["pct_focus"]])
        coef, *_ = np.linalg.lstsq(x, part["score_focus"], rcond=None)
        residual = part["score_focus"] - x @ coef
        assert np.allclose(part["residual"], residual, rtol=1e-7, atol=1e-7)
        sd = np.sqrt((residual ** 2).sum() / (len(part) - 3))
        assert np.allclose(part["residual_sd"], sd, rtol=1e-9)
        assert np.allclose(part["residual_z"], part["residual"] / sd)


def test_listed_units(country, flagged):
    rows = odds.beating_the_odds(flagged).collect()
    assert rows and len({r.lineage_id for r in rows}) == len(rows)
    limit = params_pivot(country.params).first()
    for r in rows:
        assert r.n_focus >= limit.min_focus_cohort and 1 <= r.periods_beating_odds <= r.periods_in_model
        assert (r.zone_decile <= limit.deprived_decile and r.pct_focus >= limit.deprived_area_min_pct
                ) or r.pct_focus >= limit.deprived_pct
        assert r.evidence == (odds.CONSISTENT if r.periods_beating_odds >= 2 else
                              odds.LATEST if r.beating_odds_latest else odds.EARLIER)
    selective = {r.unit_id for r in flagged.filter("admissions = 'Selective'").collect()}
    assert not selective


# --- panel -------------------------------------------------------------------------------------------------------

def test_benchmark_counts(country, gaps):
    counts = {r.period: r.n for r in gaps.filter("is_mainstream = 1").groupBy("period").agg(F.count("*").alias("n")).collect()}
    assert {r.period: r.n_units for r in country.bench.collect()} == counts


def test_area_ranking_against_pandas(country, gaps):
    rows = gaps.filter("is_mainstream = 1").toPandas()
    bench = {r.period: r for r in country.bench.collect()}
    ranked = country.area_ranking.toPandas()
    for period, part in ranked.groupby("period"):
        mine = rows[(rows["period"] == period) & rows["score_focus"].notna()]
        focus = mine.groupby("area_code").apply(
            lambda d: np.average(d["score_focus"], weights=d["n_focus"]), include_groups=False)
        gap = (bench[period].score_rest - focus).sort_values(ascending=False)
        known = part[part["gap_vs_benchmark"].notna()].set_index("area_code")
        assert np.allclose(known["gap_vs_benchmark"].loc[gap.index], gap)
        assert list(known.sort_values("rank_gap_vs_benchmark").index) == list(gap.index)
        assert sorted(known["rank_gap_vs_benchmark"]) == list(range(1, len(known) + 1))
        assert (part["n_areas_in_period"] == len(part)).all()


def test_no_nan_anywhere(country, flagged):
    for df in (country.area_ranking, flagged, country.bench):
        doubles = [c for c, t in df.dtypes if t == "double"]
        found = df.agg(*[F.count_if(F.isnan(c)).alias(c) for c in doubles]).first()
        assert not any(found)


def test_period_bound_is_checked(spark):
    base = spark.createDataFrame([(123456, 1.0)], "period int, x double")
    with pytest.raises(Exception, match="four-digit year"):
        base.join(panel.per_period(base.select("period", F.lit(1).alias("y"))), "period").collect()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    areas_only = panel.area_period(Panel(Tables(spark, sf_dir), False).base, Panel(Tables(spark, sf_dir), False).bench)
    plan = areas_only._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "lineitem" in line]
    assert scans and all("l_orderkey" not in line for line in scans)
    assert all("l_linestatus" not in line for line in scans)


# --- trends ------------------------------------------------------------------------------------------------------

def test_area_trends_against_pandas(country):
    rows = country.area_trends.toPandas().sort_values(["area_code", "period"])
    for _, part in rows.groupby("area_code"):
        gap = part["gap_vs_benchmark"]
        assert np.allclose(part["change_gap_vs_benchmark"], gap.diff(), equal_nan=True)
        assert np.allclose(part["gap_3_period_avg"], gap.rolling(3, min_periods=1).mean(), equal_nan=True)
        assert part["prev_period"].tolist()[1:] == part["period_label"].tolist()[:-1]
        assert part["is_latest"].tolist() == [0] * (len(part) - 1) + [1]
        assert part["period_index"].tolist() == list(range(1, len(part) + 1))
    change = rows["change_gap_vs_benchmark"]
    expected = np.select([change.isna(), change <= -1, change >= 1], [None, "Narrowing", "Widening"], "Stable")
    assert rows["trend"].where(rows["trend"].notna(), None).tolist() == expected.tolist()


def test_unit_trends_follow_the_lineage(spark):
    kind = ("unit_id long, lineage_id long, period int, period_label string, is_mainstream int, "
            "gap_vs_benchmark double, score_focus double")
    rows = [(1, 9, 2018, "a", 1, 10.0, 1.0), (9, 9, 2021, "b", 1, 7.0, 4.0), (9, 9, 2022, "c", 0, 0.0, 0.0),
            (9, 9, 2023, "d", 1, None, None)]
    out = trends.unit_trends(spark.createDataFrame(rows, kind)).orderBy("period").collect()
    assert [(r.prev_period, r.change_gap_vs_benchmark, r.recency) for r in out] == [
        (None, None, 3), ("a", -3.0, 2), ("b", None, 1)]


# --- selections --------------------------------------------------------------------------------------------------

def test_selection_filters_compose(country):
    dash = country.dash_units.cache()
    everything = dash.count()
    assert selection.select_rows(dash).count() == everything
    some = selection.select_rows(dash, period_label="1999-00", region="EUROPE", unit_type="LA maintained")
    rows = some.select("period_label", "region", "unit_type").distinct().collect()
    assert [tuple(r) for r in rows] == [("1999-00", "EUROPE", "LA maintained")]
    tiles = selection.kpi_tiles(dash, country.listed, period_label="1999-00").first()
    part = dash.filter("period_label = '1999-00'").toPandas()
    known = part[part["score_focus"].notna()]
    assert tiles.score_focus == pytest.approx(np.average(known["score_focus"], weights=known["n_focus"]))
    rest = part["n_total"] - part["n_focus"]
    assert tiles.score_rest == pytest.approx(np.average(part["score_rest"], weights=rest))
    assert tiles.gap_in_grades == pytest.approx((tiles.benchmark_score_rest - tiles.score_focus) / 10)
    ranked = selection.area_ranking_selected(dash, "gap_within_area", period_label="1999-00")
    top = selection.largest_areas(ranked, "selected", 3).collect()
    assert [r.dense_rank for r in top] == [1, 2, 3]
    low = selection.largest_areas(ranked, "selected", 2, smallest=True).collect()
    assert low[0].selected <= low[1].selected <= top[-1].selected
    with pytest.raises(ValueError):
        selection.area_ranking_selected(dash, "nothing")
    dash.unpersist()


def test_dense_rank_and_measure_by_column(spark):
    df = spark.createDataFrame([("gap_within_area", 1.0, 2.0, 3.0), ("scale_of_need", 1.0, 2.0, 3.0), ("x", 1.0, 2.0, 3.0)],
                               "m string, gap_vs_benchmark double, gap_within_area double, scale_of_need double")
    out = df.select(selection.choose_measure(F.col("m")).alias("v")).collect()
    assert [r.v for r in out] == [2.0, 3.0, None]


def test_questions(country):
    top = marts.top_gaps(country.area_trends, 3).collect()
    assert len(top) == 3 and top[0].rank_gap_vs_benchmark <= top[1].rank_gap_vs_benchmark
    need = marts.greatest_need(country.area_ranking, 4).collect()
    assert [r.rank_scale_of_need for r in need] == sorted(r.rank_scale_of_need for r in need)
    dims = selection.dim_values([country.bench, country.area_period], "period_label").collect()
    assert len(dims) == 7


# --- areas, params -----------------------------------------------------------------------------------------------

def test_area_without_scores_averages_zero(spark):
    zones = spark.createDataFrame([("D1", 100.0, None, 1), ("D1", None, None, 9), ("D2", 300.0, 10.0, 2),
                                   ("D2", None, 50.0, 5), ("D9", 1.0, 1.0, 1)],
                                  "district_code string, population double, zone_score double, zone_decile int")
    districts = spark.createDataFrame([("D1", "A"), ("D2", "B")], "district_code string, area_code string")
    rows = {r.area_code: r for r in areas.area_deprivation(zones, districts).collect()}
    assert set(rows) == {"A", "B"}
    assert rows["A"].zone_score_avg == 0.0 and rows["A"].pct_pop_most_deprived == pytest.approx(100 * 100 / 101)
    assert rows["B"].zone_score_avg == pytest.approx((3000 + 50) / 301)


def test_params(spark):
    row = params_pivot(params_table(spark, odds_z=1.5)).first()
    assert (row.min_focus_cohort, row.odds_z, row.deprived_pct) == (10.0, 1.5, 40.0)
    with pytest.raises(ValueError):
        params_table(spark, nothing=1)


# --- lineage -----------------------------------------------------------------------------------------------------

def links(spark, rows):
    return spark.createDataFrame(rows, "unit_id long, link_id long, link_type string")


def test_one_to_one_links(spark):
    rows = [(1, 2, "Successor"), (2, 1, "Predecessor"), (3, 9, "Successor"), (4, 9, "Successor"),
            (5, 7, "Successor - amalgamated"), (6, 8, "Successor"), (11, 11, "Successor"), (12, 13, "Merged - successor")]
    assert {tuple(r) for r in lineage.one_to_one_links(links(spark, rows)).collect()} == {(1, 2), (6, 8)}


REGISTER = "unit_id long, postcode string, unit_name string, open_date date, close_date date"


def build(spark, results, link_rows, register=()):
    out = lineage.build_lineage(spark.createDataFrame(results, "unit_id long, period int"),
                                spark.createDataFrame(list(register), REGISTER),
                                links(spark, link_rows) if link_rows else None)
    return {r.unit_id: (r.lineage_id, r.lineage_method) for r in out.collect()}


def test_lineage_walks_through_ids_without_results(spark):
    got = build(spark, [(1, 2018), (3, 2022)], [(1, 2, "Successor"), (2, 3, "Successor")])
    assert got == {1: (3, "gias_link"), 3: (3, "gias_link")}


def test_lineage_clash_is_dissolved(spark):
    got = build(spark, [(1, 2022), (2, 2022)], [(1, 2, "Successor")])
    assert got == {1: (1, "self"), 2: (2, "self")}


def test_lineage_by_postcode(spark):
    import datetime as dt
    close, start = dt.date(2022, 8, 31), dt.date(2022, 9, 1)
    register = [(1, "A", "Hill Park School", None, close), (2, "A", "Hill Park Academy", start, None),
                (5, "B", "Oak School", None, close), (6, "B", "Ash Academy", start, None),
                (7, None, "Elm", None, close), (8, None, "Elm", start, None)]
    results = [(u, 2021 if u in (1, 5, 7) else 2023) for u in (1, 2, 5, 6, 7, 8)]
    got = build(spark, results, None, register)
    assert got[1] == got[2] == (2, "postcode_match")
    assert all(got[u] == (u, "self") for u in (5, 6, 7, 8))


def test_linked_units_do_not_join_by_postcode(spark):
    import datetime as dt
    close, start = dt.date(2022, 8, 31), dt.date(2022, 9, 1)
    register = [(2, "A", "Hill", None, close), (9, "A", "Hill", start, None)]
    got = build(spark, [(1, 2018), (2, 2021), (9, 2023)], [(1, 2, "Successor")], register)
    assert got == {1: (2, "gias_link"), 2: (2, "gias_link"), 9: (9, "self")}


def test_missing_unit_borrows_a_place(spark, country):
    results = spark.createDataFrame(
        [(1, 2020, "Hill Park", "A"), (1, 2021, "Hill Park renamed", "A"), (50, 2021, "Hill Park Academy", "A"),
         (51, 2021, "Elsewhere", "Z")], "unit_id long, period int, result_name string, result_postcode string")
    text = ["unit_name", "postcode", "unit_type", "area_code", "area_name", "region", "type_name", "type_group", "phase",
            "gender", "religious_character", "admissions", "setting", "status", "zone_code", "district_code", "trust_name"]
    row = {c: "x" for c in text} | {"unit_id": 1, "unit_name": "Hill Park", "postcode": "A", "zone_code": None,
                                    "admissions": "Selective", "unit_type": "LA maintained"}
    other = row | {"unit_id": 2, "unit_name": "Oak", "area_code": "far", "zone_code": "E9"}
    kind = "unit_id long, " + ", ".join(f"{c} string" for c in text) + (
        ", easting double, northing double, latitude double, longitude double, open_date date, close_date date")
    names = [c.split()[0] for c in kind.split(", ")]
    register = spark.createDataFrame([tuple(r.get(c) for c in names) for r in (row, other)], kind)
    directory = spark.createDataFrame([("A", "E5")], "postcode string, zone_code string")
    rows = {r.unit_id: r for r in build_units(results, register, None, directory).collect()}
    assert set(rows) == {1, 50, 51}
    assert (rows[1].location_source, rows[1].zone_code, rows[1].unit_name) == ("gias_urn", "E5", "Hill Park")
    # The place is borrowed, the type and the admissions are not.
    assert (rows[50].location_source, rows[50].area_code, rows[50].zone_code) == ("gias_postcode", "x", "E5")
    assert (rows[50].unit_type, rows[50].admissions, rows[50].unit_name) == ("Other", None, "Hill Park Academy")
    assert (rows[51].location_source, rows[51].area_code) == (None, None)


def test_stand_in_lineages_are_unique_per_period(spark, sf_dir):
    from cohort_gaps.workload import standin_files as sf
    t = Tables(spark, sf_dir)
    results = sf.order_results(t)
    out = lineage.build_lineage(results, sf.order_register(t), sf.order_links(t)).cache()
    both = results.join(out, "unit_id")
    assert both.groupBy("lineage_id", "period").count().filter("count > 1").count() == 0
    methods = {r.lineage_method: r["count"] for r in out.groupBy("lineage_method").count().collect()}
    assert set(methods) == {"self", "gias_link", "postcode_match"} and out.count() == results.count()
    assert st.results(t).count() > 0
