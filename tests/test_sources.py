import datetime as dt

import pytest

from cohort_gaps import build
from cohort_gaps.sources import results as res
from cohort_gaps.sources import sinks
from cohort_gaps.sources.files import list_files, newest_file, yearly_files
from cohort_gaps.sources.register import read_directory, read_links, read_register, read_zones
from cohort_gaps.sources.text_tables import detect_encoding, inspect_file, read_text_table, tidy_columns

WIDE = "RECTYPE,LEA,ESTAB,URN,SCHNAME,PCODE,TPUP,TFSM6CLA1A,TNOTFSM6CLA1A,PTFSM6CLA1A,ATT8SCR,ATT8SCR_FSM6CLA1A," \
       "ATT8SCR_NFSM6CLA1A,P8MEA,PTL2BASICS_94"
LONG = "time_period,school_urn,school_name,establishment_type_group,breakdown_topic,disadvantage_status,pupil_count," \
       "attainment8_average,progress8_average,engmath_94_percent,sex"
REGISTER = "URN,LA (code),LA (name),EstablishmentName,TypeOfEstablishment (name),EstablishmentTypeGroup (name)," \
           "EstablishmentStatus (name),OpenDate,CloseDate,PhaseOfEducation (name),Gender (name)," \
           "ReligiousCharacter (name),AdmissionsPolicy (name),Postcode,GOR (name),DistrictAdministrative (code)," \
           "DistrictAdministrative (name),UrbanRural (name),Trusts (name),LSOA (code),Easting,Northing"


def put(path, lines, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(("\n".join(lines) + "\n").encode(encoding))
    return str(path)


def unit(i, name, postcode, area="301", open_date="", close_date="", zone="E01", kind="Community school",
         group="Local authority maintained schools", admissions="Non-selective", east="530268", north="179640",
         region="London"):
    return (f'{i},{area},Area {area},"{name}",{kind},{group},Open,{open_date},{close_date},Secondary,Mixed,None,'
            f'{admissions},{postcode},{region},D{area},District,Urban,Trust,{zone},{east},{north}')


def test_wide_reader(spark, tmp_path):
    path = put(tmp_path / "wide.csv", [
        WIDE, "1,301,4000,100001,Hill,ab1 2cd,200,,NA,25%,45.3,SUPP,50.1,-0.12,64%",
        "2,301,4001,100002,Park,zz1 1zz,10,NA,NA,5%,40,LOWCOV,41,NE,SUPP",
        "1,301,4002,100003,Twice,ab1 2ce,50,10,40,,30,29,31,0.1,50%",
        "1,301,4002,100003,Twice,ab1 2ce,80,20,,,33,32,34,0.2,51%",
        "4,301,,,,,9999,,,,,,,,", "5,,,,,,99999,,,,,,,,", "1,301,4009,abc,Bad,,1,,,,,,,,"])
    rows = {r.unit_id: r for r in res.read_wide(spark, path, "2022-2023").collect()}
    assert set(rows) == {100001, 100002, 100003}
    hill = rows[100001]
    assert (hill.period_label, hill.period, hill.is_special, hill.result_postcode) == ("2022-23", 2022, 0, "AB1 2CD")
    assert (hill.n_total, hill.n_focus, hill.n_rest, hill.pct_focus) == (200, 50, 150, 25.0)
    assert (hill.score_all, hill.score_focus, hill.score_rest) == (45.3, None, 50.1)
    assert hill.progress_all == -0.12 and hill.progress_focus is None and hill.basics_all == 64.0
    # 10 * 5 % = 0.5 rounds to even; record type 2 is special
    assert rows[100002].n_focus == 0 and rows[100002].is_special == 1
    assert rows[100003].n_total == 80 and rows[100003].n_rest == 60 and rows[100003].pct_focus == 25.0


def test_wide_reader_needs_ids(spark, tmp_path):
    with pytest.raises(ValueError, match="unit_id"):
        res.read_wide(spark, put(tmp_path / "w.csv", ["RECTYPE,TPUP", "1,5"]), "2022")


def long_rows(period, i, kind, figures):
    topics = [("Total", "Total"), ("Disadvantage status", "Disadvantaged"),
              ("Disadvantage status", "Not known to be disadvantaged")]
    return [f"{period},{i},Unit {i},{kind},{t},{s},{','.join(f)},Total" for (t, s), f in zip(topics, figures)]


def test_long_reader(spark, tmp_path):
    lines = [LONG, *long_rows("202223", 100001, "Academies", [("200", "45.3", "-0.1", "64"), ("50", "c", "z", "40"),
                                                             ("150", "50.1", "0.2", "70")]),
             "202223,100001,Unit,Academies,Sex,Total,99,99,99,99,Boys",
             *long_rows("202223", 100002, "Special schools", [("80", "33", "x", "51"), ("20", "32", "", "50"),
                                                              ("z", "34", "", "52")])]
    raw = read_text_table(spark, put(tmp_path / "ees_1.csv", lines))
    rows = {r.unit_id: r for r in res.tidy_long(raw).collect()}
    one, two = rows[100001], rows[100002]
    assert (one.period_label, one.n_total, one.n_focus, one.n_rest, one.pct_focus) == ("2022-23", 200, 50, 150, 25.0)
    assert (one.score_all, one.score_focus, one.score_rest, one.basics_focus) == (45.3, None, 50.1, 40.0)
    assert (two.is_special, two.n_rest, two.result_postcode) == (1, 60, None)
    slim = res.slim_long(raw)
    assert slim.count() == 6 and len([c for c in slim.columns if not c.startswith("_")]) == 10
    sinks.write_slim_long(raw, str(tmp_path / "slim"))
    again = res.tidy_long(read_text_table(spark, str(tmp_path / "slim")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, res.tidy_long(raw).collect()))
    with pytest.raises(ValueError, match="pupil_count"):
        res.slim_long(raw.drop("pupil_count"))


def test_long_equals_wide(spark, tmp_path):
    wide = res.read_wide(spark, put(tmp_path / "w.csv", [
        "RECTYPE,URN,SCHNAME,TPUP,TFSM6CLA1A,TNOTFSM6CLA1A,ATT8SCR,ATT8SCR_FSM6CLA1A,ATT8SCR_NFSM6CLA1A",
        "1,7,Unit 7,90,30,60,44.1,SUPP,48.2", "2,8,Unit 8,12,3,9,20,19,21"]), "2023-24")
    long = res.tidy_long(read_text_table(spark, put(tmp_path / "l.csv", [
        LONG, *long_rows("202324", 7, "Academies", [("90", "44.1", "", ""), ("30", "c", "", ""), ("60", "48.2", "", "")]),
        *long_rows("202324", 8, "Special", [("12", "20", "", ""), ("3", "19", "", ""), ("9", "21", "", "")])])))
    assert sorted(map(tuple, wide.select(*res.COLUMNS).collect())) == sorted(map(tuple, long.select(*res.COLUMNS).collect()))


def test_slim_wide_reads_the_same(spark, tmp_path):
    extra = [f"X{i}" for i in range(300)]
    path = put(tmp_path / "w.csv", [WIDE + "," + ",".join(extra),
                                    "1,301,4000,100001,Hill,ab1 2cd,200,,NA,25%,45.3,SUPP,50.1,-0.12,64%" + ",9" * 300])
    raw = read_text_table(spark, path)
    sinks.write_slim_wide(raw, str(tmp_path / "slim"))
    slim = read_text_table(spark, str(tmp_path / "slim"))
    assert "ESTAB" not in slim.columns and "X1" not in slim.columns and "LEA" in slim.columns
    assert res.tidy_wide(slim, "2022").collect() == res.tidy_wide(raw, "2022").collect()


def test_encodings(spark, tmp_path):
    lines = ["URN,Name – x", "1,St Thérèse’s"]
    utf = put(tmp_path / "u.csv", lines, "utf-8-sig")
    win = put(tmp_path / "w.csv", lines, "cp1252")
    odd = tmp_path / "o.csv"
    odd.write_bytes(b"URN,Name\n1,Th\xe9r\x8d\n")
    assert [detect_encoding(spark, str(p)) for p in (utf, win, odd)] == ["utf-8", "cp1252", "latin-1"]
    a, b = read_text_table(spark, utf), read_text_table(spark, win)
    assert a.columns == b.columns and a.columns[:2] == ["URN", "Name – x"]
    assert a.first()[1] == b.first()[1] == "St Thérèse’s"
    assert read_text_table(spark, str(odd)).first()[1] == "Thér\x8d"


def test_blanks_and_repeated_headers(spark, tmp_path):
    path = put(tmp_path / "b.csv", ['URN,a,urn,a,q', '1,x,2,y,', '3,"",4,z,"a ""b"", c"'])
    df = read_text_table(spark, path)
    assert [c for c in df.columns if not c.startswith("_")] == ["a", "urn", "q"]
    assert sorted((r["a"], r["urn"], r["q"]) for r in df.collect()) == [("", "4", 'a "b", c'), ("x", "2", "")]


def test_quoted_line_breaks_are_read_whole(spark, tmp_path):
    path = put(tmp_path / "reg.csv", [REGISTER, unit(1, "Hill\nPark ""\"\"the\"\" one", "AB1 2CD"), unit(2, "Vale", "AB1 2CE")])
    rows = {r.unit_id: r for r in read_register(spark, path).collect()}
    assert rows[1].unit_name == 'Hill\nPark "the" one' and rows[1].postcode == "AB1 2CD" and rows[1].area_code == "301"
    assert rows[2].unit_name == "Vale"
    plain = put(tmp_path / "plain.csv", [REGISTER, unit(1, "Hill", "AB1 2CD")])
    assert inspect_file(spark, plain) == ("utf-8", False) and inspect_file(spark, path) == ("utf-8", True)


def test_rows_with_surplus_cells_fail(spark, tmp_path):
    path = put(tmp_path / "extra.csv", ["URN,LinkURN,LinkType", "1,2,Successor", "3,4,Successor,EXTRA"])
    with pytest.raises(Exception, match="more cells than headers"):
        read_text_table(spark, path).collect()
    short = put(tmp_path / "short.csv", ["URN,LinkURN,LinkType", "1,2"])
    assert [tuple(r)[:3] for r in read_text_table(spark, short).collect()] == [("1", "2", "")]


def test_only_a_missing_folder_counts_as_none(spark, tmp_path):
    assert list_files(spark, str(tmp_path / "absent"), "*.csv") is None
    with pytest.raises(Exception):
        list_files(spark, "nosuchscheme://x/y", "*.csv")


def test_tidy_columns_fills_absent(spark, tmp_path):
    df = read_text_table(spark, put(tmp_path / "t.csv", ["b,Zone code (2021)", "1,E1"]))
    out = tidy_columns(df, {"x": ["a", "B"], "y": ["none"]}, ["x"])
    assert (out.first().x, out.first().y) == ("1", None)
    with pytest.raises(ValueError, match="no column for y"):
        tidy_columns(df, {"y": ["none"]}, ["y"])


def test_register(spark, tmp_path):
    path = put(tmp_path / "r.csv", [
        REGISTER, unit(1, "St Thérèse’s", "ab12cd", open_date="01-09-2010", close_date="bad"),
        unit(1, "Second row", "ab12cd"), unit(2, "Nowhere", "", east="0", north="0", zone="", region="Not Applicable"),
        unit("x", "No id", ""), unit(3, "Grammar", "ab12cd", kind="Academy converter", admissions="Selective")], "cp1252")
    rows = {r.unit_id: r for r in read_register(spark, path).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].unit_name == "St Thérèse’s" and rows[1].postcode == "AB1 2CD"
    assert rows[1].open_date == dt.date(2010, 9, 1) and rows[1].close_date is None
    assert rows[1].latitude == pytest.approx(51.5007, abs=2e-4) and rows[1].unit_type == "LA maintained"
    assert (rows[2].latitude, rows[2].easting, rows[2].zone_code, rows[2].region, rows[2].postcode) == (None,) * 5
    assert rows[3].unit_type == "Academy (converter)"


def test_links_and_directory(spark, tmp_path):
    links = read_links(spark, put(tmp_path / "l.csv", ["URN,LinkURN,LinkType,LinkName", "1,2, Successor ,x",
                                                       "3,,Successor,x", "x,4,Predecessor,y"]))
    assert [tuple(r) for r in links.collect()] == [(1, 2, "Successor")]
    rows = read_directory(spark, put(tmp_path / "d.csv", ["pcd,pcds,lsoa11,lsoa21cd,z", "x,ab1 2cd,old,new,1",
                                                          "x,AB12CD,old,later,1", "x,,old,new,1", "x,zz1 1zz,o,,1"]))
    assert [tuple(r) for r in rows.collect()] == [("AB1 2CD", "new")]
    with pytest.raises(ValueError):
        read_directory(spark, put(tmp_path / "e.csv", ["pcds,other", "a,b"]))


@pytest.mark.parametrize("year", ["2011", "2021"])
def test_zone_layouts(spark, tmp_path, year):
    head = (f"LSOA code ({year}),LSOA name ({year}),Local Authority District code (2019),"
            "Local Authority District name (2019),Index of Multiple Deprivation (IMD) Score,"
            '"Index of Multiple Deprivation (IMD) Rank (where 1 is most deprived)",'
            '"Index of Multiple Deprivation (IMD) Decile (where 1 is most deprived 10% of LSOAs)",'
            "Income Deprivation Affecting Children Index (IDACI) Score (rate),"
            "Income Deprivation Affecting Children Index (IDACI) Decile,Total population: mid 2015")
    path = put(tmp_path / "z.csv", [head, 'E1,n,D1,d,45.1,1,1,0.4,2,"1,500"', "E2,n,D1,d,5.2,2,10,0.1,9,900",
                                    "E1,again,D1,d,1,1,1,1,1,1"])
    rows = {r.zone_code: r for r in read_zones(spark, path).collect()}
    assert (rows["E1"].zone_score, rows["E1"].zone_decile, rows["E1"].population) == (45.1, 1, 1500.0)
    assert (rows["E2"].zone_score, rows["E2"].child_decile) == (5.2, 9)


def test_zone_ranks_only(spark, tmp_path):
    path = put(tmp_path / "z.csv", ["LSOA code (2021),Index of Multiple Deprivation (IMD) Rank", "a,1", "b,2", "c,3"])
    rows = read_zones(spark, path).orderBy("zone_code").collect()
    assert [r.zone_score for r in rows] == [100.0, 50.0, 0.0]
    with pytest.raises(ValueError):
        read_zones(spark, put(tmp_path / "y.csv", ["x,y", "1,2"]))


def test_which_file(spark, tmp_path):
    for name in ("edubasealldata20240101.csv", "edubasealldata20250101.csv", "links_edubasealldata20990101.csv"):
        put(tmp_path / "gias" / name, ["URN"])
    found = newest_file(spark, str(tmp_path / "gias"), "edubasealldata*.csv")
    assert found.endswith("edubasealldata20250101.csv")
    assert newest_file(spark, str(tmp_path / "absent"), "*.csv") is None
    for name in ("2018-2019/england_ks4provisional.csv", "2018-2019/england_ks4final.csv",
                 "2018-2019/england_ks4final_meta.csv", "2021-2022/england_ks4revised.csv", "2022-2023/other.csv"):
        put(tmp_path / "ks4" / name, ["URN"])
    files = yearly_files(spark, str(tmp_path))
    assert {k: v.rsplit("/", 1)[1] for k, v in files.items()} == {"2018-2019": "england_ks4final.csv",
                                                                   "2021-2022": "england_ks4revised.csv"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A small country: 12 units in two areas over five years, one id change by link, one by postcode."""
    root = tmp_path_factory.mktemp("country")

    def wide(year, ids):
        rows = [f"1,301,4,{i},Unit {i} Hill,ab{i % 9} {i % 9}cd,{100 + i},{20 + i % 7},,,"
                f"{40 + i % 5}.5,{30 + (i * 7 + year) % 11},{45 + (i + year) % 4},0.1,50%" for i in ids]
        put(root / "ks4" / f"{year}-{year + 1}" / "england_ks4final.csv", [WIDE, *rows, "5,,,,,,9,,,,,,,,"])

    old = list(range(1, 13))
    wide(2018, old)
    wide(2021, old)
    wide(2022, old)
    new = [i for i in old if i not in (1, 2)] + [101, 102]
    long = []
    for year in (2022, 2023, 2024):
        for i in (old if year == 2022 else new):
            long += long_rows(f"{year}{(year + 1) % 100}", i, "Academies", [
                (str(100 + i), f"{40 + i % 5}.5", "0.1", "50"), (str(20 + i % 7), str(30 + (i * 7 + year) % 11), "0", "40"),
                (str(80 + i - i % 7), str(45 + (i + year) % 4), "0.2", "60")])
    put(root / "ks4" / "ees_ks4.csv", [LONG, *long])
    register = [unit(i, f"Unit {i} Hill", f"AB{i % 9} {i % 9}CD", area="301" if i % 2 else "302", zone=f"E{i % 4}",
                     admissions="Selective" if i == 12 else "Non-selective") for i in range(3, 12)]
    register += [unit(1, "Linked one", "CC1 1CC", zone="E1"), unit(101, "Linked new", "CC1 1CC", zone="E1"),
                 unit(2, "Green Bank School", "DD1 1DD", close_date="31-08-2023", zone="E2"),
                 unit(102, "Green Bank Academy", "DD1 1DD", open_date="01-09-2023", zone="")]
    put(root / "gias" / "edubasealldata20250101.csv", [REGISTER, *register], "cp1252")
    put(root / "gias" / "links_edubasealldata20250101.csv", ["URN,LinkURN,LinkType", "1,101,Successor",
                                                             "101,1,Predecessor"])
    zones = [f"E{i},zone,D301,d,{10 * i + 5},{4 - i},{i + 1},0.1,3,1000" for i in range(4)]
    put(root / "imd" / "scores.csv", [
        "LSOA code (2021),LSOA name (2021),Local Authority District code (2024),Local Authority District name (2024),"
        "Index of Multiple Deprivation (IMD) Score,Index of Multiple Deprivation (IMD) Rank,"
        "Index of Multiple Deprivation (IMD) Decile,(IDACI) Score,(IDACI) Decile,Total population", *zones])
    put(root / "onspd" / "codes.csv", ["pcds,lsoa21cd", "DD1 1DD,E2"])
    return root


@pytest.fixture(scope="module")
def built(spark, folder, tmp_path_factory):
    return build.build(spark, str(folder), str(tmp_path_factory.mktemp("warehouse")), min_focus_cohort=5)


def test_build_results(built):
    rows = built["results"].select("period", "unit_id").collect()
    assert len(rows) == len(set(rows)) == 60
    assert {r.period for r in rows} == {2018, 2021, 2022, 2023, 2024}
    # The long source won 2022: only it has the rest count and the second focus measure.
    won = built["results"].filter("period = 2022").select("basics_focus").distinct().collect()
    assert [r[0] for r in won] == [40.0]


def test_build_units(built):
    rows = {r.unit_id: r for r in built["units"].collect()}
    assert len(rows) == 14
    assert (rows[1].lineage_id, rows[1].lineage_method) == (101, "gias_link")
    assert (rows[2].lineage_id, rows[2].lineage_method) == (102, "postcode_match")
    assert rows[5].lineage_method == "self" and rows[5].lineage_id == 5
    assert rows[102].zone_code == "E2" and rows[102].open_date == "2023-09-01"
    # Unit 12 is not in the register. The long source prints no postcode, so it stays without a place.
    assert rows[12].location_source is None and rows[12].unit_type == "Other" and rows[12].unit_name == "Unit 12"
    assert {r.location_source for r in rows.values()} == {"gias_urn", None}


def test_build_views(built):
    dash = built["dash_units"].collect()
    assert len(dash) == 60
    assert len({(r.lineage_id, r.period) for r in dash}) == 60
    bench = {r.period: r for r in built["benchmark"].collect()}
    assert bench[2024].n_units == 12
    model = built["odds"].select("period", "n_in_model").distinct().collect()
    assert len(model) == 5
    ranks = built["odds"].filter("period = 2024").orderBy("rank_residual").collect()
    assert [r.rank_residual for r in ranks][0] == 1
    assert all(a.residual >= b.residual - 1e-9 for a, b in zip(ranks, ranks[1:]))
    areas = built["dash_areas"].collect()
    assert {r.area_code for r in areas} == {"301", "302"}
    assert sum(r.is_latest for r in areas) == 2
    deprivation = {r.area_code: r for r in built["areas"].collect()}
    assert deprivation["301"].zone_score_rank == 1 and deprivation["302"].zone_score_rank is None


def test_views_are_registered(spark, built):
    row = spark.sql("SELECT count(*) AS n FROM dash_units WHERE is_latest = 1").first()
    assert row.n == 12
    checks = {r["check"]: r for r in build.coverage(built).collect()}
    assert checks["map point"].rate == pytest.approx(13 / 14) and checks["zone"].rate == pytest.approx(13 / 14)
    assert checks["zone"].is_low is False


def test_extracts(spark, built, tmp_path):
    sinks.write_extracts(built, str(tmp_path / "csv"))
    narrow_fields = ["period_label", "period", "score_focus", "score_rest", "score_gap"]
    sinks.write_json_extracts(built, str(tmp_path / "json"), {"benchmark": narrow_fields})
    units = spark.read.option("header", True).csv(str(tmp_path / "csv" / "units"))
    assert units.count() == 60 and units.columns[0] == "period_label"
    in_order = sinks.extract(built, "units").select("period", "area_name", "unit_name").collect()
    key = [(r.period, r.area_name is None, r.area_name or "", r.unit_name) for r in in_order]
    assert key == sorted(key)
    line = spark.read.text(str(tmp_path / "json" / "areas")).first()[0]
    assert '"prev_period":null' in line or '"prev_period":"' in line
    narrow = spark.read.json(str(tmp_path / "json" / "benchmark"))
    assert set(narrow.columns) == {"period_label", "period", "score_focus", "score_rest", "score_gap"}


def test_dropping_views(spark, built):
    build.drop_views(spark)
    assert not any(t.name in build.VIEWS for t in spark.catalog.listTables())
    build.create_views({k: built[k] for k in build.TABLES})
    assert {t.name for t in spark.catalog.listTables()} >= set(build.VIEWS)
