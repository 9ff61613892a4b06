import pytest
from pyspark.sql import functions as F

from cohort_gaps import functions as fn
from cohort_gaps.operators import cleaning


def column(spark, items, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")


def test_clean_number(spark, values):
    cells = ["23%", "1,204", "SUPP", "NE", "LOWCOV", "x", "", "45.3", " 7 ", None, "5d", "nan", "inf", "1e5", "\t7\t",
             "-0.12", "supp", "1e999", "23 %", " 8"]
    out = values(cleaning.clean_numeric(column(spark, cells), ["v"]), "v")
    assert out == [23.0, 1204.0, None, None, None, None, None, 45.3, 7.0, None, None, None, None, 1e5, 7.0, -0.12, None,
                   None, 23.0, 8.0]


def test_normalise_code(spark, values):
    cells = ["sw1a1aa", "SW1A  1AA", "m1 1ae", "", None, "X", "ab12 3cde", "abcd1"]
    out = values(cleaning.clean_codes(column(spark, cells), ["v"]), "v")
    assert out == ["SW1A 1AA", "SW1A 1AA", "M1 1AE", None, None, None, None, "AB CD1"]


def test_period_labels(spark):
    rows = cleaning.label_periods(column(spark, ["2022-2023", "2018-19", "202223", "1999-2000"]), "v").orderBy("i").collect()
    assert [(r.period_label, r.period) for r in rows] == [("2022-23", 2022), ("2018-19", 2018), ("2022-23", 2022),
                                                          ("1999-00", 1999)]


@pytest.mark.parametrize("bad", ["none", None, ""])
def test_period_without_year_fails(spark, bad):
    with pytest.raises(Exception, match="no period in"):
        cleaning.label_periods(column(spark, [bad]), "v").collect()


def test_numeric_id_keeps_long_ids(spark, values):
    cells = ["100001", " 100002 ", "", "abc", "100003.0", "9007199254740993", None, "1e5"]
    out = values(column(spark, cells).withColumn("v", fn.numeric_id("v")), "v")
    assert out == [100001, 100002, None, None, 100003, 9007199254740993, None, 100000]


def test_token_jaccard(spark):
    pairs = [("Hill Park School", "Hill Park Academy", 1.0), ("Hill Park School", "Valley Grange School", 0.0),
             ("The School", "Hill", 0.0), ("St Thérèse's", "th r se s", 1.0), (None, "Hill", 0.0),
             ("Hill Park", "Hill Grange", 1 / 3)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string")
    out = df.select("i", fn.token_jaccard(fn.token_set("a"), fn.token_set("b")).alias("s")).orderBy("i").collect()
    assert [r.s for r in out] == pytest.approx([s for _, _, s in pairs])


def test_half_even(spark, values):
    df = column(spark, [0.5, 1.5, 2.5, 0.125, 0.375, None], "double")
    assert values(df.withColumn("v", fn.half_even("v")), "v")[:3] == [0.0, 2.0, 2.0]
    assert values(df.withColumn("v", fn.half_even("v", 2)), "v")[3:] == [0.12, 0.38, None]


def test_not_nan(spark, values):
    df = column(spark, [1.0, float("nan"), None], "double")
    assert values(df.withColumn("v", fn.not_nan("v")), "v") == [1.0, None, None]


def test_weighted_mean_and_percent(spark):
    rows = [(10, 50.0), (None, 99.0), (30, None), (30, 10.0)]
    one = spark.createDataFrame(rows, "w long, x double").agg(fn.weighted_mean("w", "x").alias("m")).first()
    assert one.m == pytest.approx((500 + 300) / 40)
    none = spark.createDataFrame([(5, None)], "w long, x double").agg(fn.weighted_mean("w", "x").alias("m")).first()
    assert none.m is None
    zero = spark.createDataFrame([(0, 5.0)], "w long, x double").agg(fn.weighted_mean("w", "x").alias("m")).first()
    assert zero.m is None
    shares = spark.createDataFrame([(1, 0), (1, 4), (None, 4)], "a long, b long").select(fn.percent("a", "b").alias("p"))
    assert [r.p for r in shares.collect()] == [None, 25.0, None]


def test_categories(spark, values):
    cases = [("Academy special converter", "Academies", "Special"),
             ("Academy converter", "Academies", "Academy (converter)"),
             ("Academy sponsor led", "Academies", "Academy (sponsor led)"),
             ("Community school", "Local authority maintained schools", "LA maintained"),
             ("University technical college", "Free Schools", "Free school / UTC / studio"),
             ("Studio schools", None, "Free school / UTC / studio"),
             ("Other independent school", "Independent schools", "Independent"),
             ("Foundation", "Special schools", "Special"), (None, None, "Other")]
    df = spark.createDataFrame([(i, t, g) for i, (t, g, _) in enumerate(cases)],
                               "i int, type_name string, type_group string")
    assert values(cleaning.categorise_units(df), "unit_type") == [c for _, _, c in cases]


def test_dates_and_sentinels(spark, values):
    df = column(spark, ["31-12-2020", "2020-12-31", "", "30-02-2020", None])
    parsed = cleaning.parse_dates(df, ["v"])
    assert values(cleaning.iso_dates(parsed, ["v"]), "v") == ["2020-12-31", None, None, None, None]
    texts = column(spark, ["", "Not Applicable", "Not applicable", "not applicable", "x", None])
    assert values(cleaning.null_sentinels(texts, ["v"], ["", "Not Applicable", "Not applicable"]), "v") == [
        None, None, None, "not applicable", "x", None]


def test_coordinate_pairs(spark):
    df = spark.createDataFrame([(0, 5.0, 0.0), (1, -1.0, 3.0), (2, 2.0, 3.0), (3, None, 3.0)],
                               "i int, e double, n double")
    rows = cleaning.null_unless_both_positive(df, "e", "n").orderBy("i").collect()
    assert [(r.e, r.n) for r in rows] == [(None, None), (None, None), (2.0, 3.0), (None, 3.0)]


def test_rank_to_score_only_where_all_is_missing(spark):
    kind = "zone_code string, zone_rank double, zone_score double, zone_decile int"
    ranks = spark.createDataFrame([("a", 1.0, None, None), ("b", 2.0, None, None), ("c", 3.0, None, None)], kind)
    rows = cleaning.rank_to_score(ranks).orderBy("zone_code").collect()
    assert [r.zone_score for r in rows] == [100.0, 50.0, 0.0]
    assert [r.zone_decile for r in rows] == [4, 7, 10]
    some = spark.createDataFrame([("a", 1.0, 45.0, 1), ("b", 2.0, None, None)], kind)
    rows = cleaning.rank_to_score(some).orderBy("zone_code").collect()
    assert [(r.zone_score, r.zone_decile) for r in rows] == [(45.0, 1), (None, None)]


def test_locate_points(spark):
    df = spark.createDataFrame([(0, 530268.0, 179640.0), (1, None, 179640.0), (2, 651409.903, 313177.270)],
                               "i int, easting double, northing double")
    rows = cleaning.locate_points(df).orderBy("i").collect()
    assert rows[0].latitude == pytest.approx(51.5007, abs=2e-4) and rows[0].longitude == pytest.approx(-0.1246, abs=2e-4)
    assert rows[1].latitude is None and rows[1].longitude is None
    # The worked example of the public national grid guide, after the datum shift.
    assert rows[2].latitude == pytest.approx(52.6580, abs=2e-4) and rows[2].longitude == pytest.approx(1.7161, abs=2e-4)


def test_locate_points_agrees_with_iteration(spark):
    """The series against an independent Newton iteration of the meridian arc by numerical integration."""
    import math

    import numpy as np

    a, b, f0 = 6377563.396, 6356256.909, 0.9996012717
    e2 = 1 - b * b / (a * a)

    def arc(phi):
        x, w = np.polynomial.legendre.leggauss(40)
        lo = math.radians(49)
        u = (phi - lo) / 2 * x + (phi + lo) / 2
        return f0 * a * (1 - e2) * (phi - lo) / 2 * float(np.sum(w * (1 - e2 * np.sin(u) ** 2) ** -1.5))

    phi = math.radians(53)
    northing = arc(phi) - 100000.0
    df = spark.createDataFrame([(400000.0, northing)], "easting double, northing double")
    got = cleaning.locate_points(df).first()
    # On the central meridian the projection is the arc; only the datum shift is left.
    turn = [math.radians(t / 3600) for t in (0.1502, 0.2470, 0.8421)]
    nu, lam, s = a / math.sqrt(1 - e2 * math.sin(phi) ** 2), math.radians(-2), 1 - 20.4894e-6
    x, y, z = nu * math.cos(phi) * math.cos(lam), nu * math.cos(phi) * math.sin(lam), (1 - e2) * nu * math.sin(phi)
    x2 = 446.448 + s * x - turn[2] * y + turn[1] * z
    y2 = -125.157 + turn[2] * x + s * y - turn[0] * z
    z2 = 542.060 - turn[1] * x + turn[0] * y + s * z
    a2, b2 = 6378137.0, 6356752.3142
    f2, p = 1 - b2 * b2 / (a2 * a2), math.hypot(x2, y2)
    lat = math.atan2(z2, p * (1 - f2))
    for _ in range(20):
        n2 = a2 / math.sqrt(1 - f2 * math.sin(lat) ** 2)
        lat = math.atan2(z2 + f2 * n2 * math.sin(lat), p)
    assert got.latitude == pytest.approx(math.degrees(lat), abs=1e-8)
    assert got.longitude == pytest.approx(math.degrees(math.atan2(y2, x2)), abs=1e-8)


def test_stop_words_are_lower_case(spark):
    df = spark.createDataFrame([("The Saint A St",)], "v string")
    assert df.select(fn.token_set(F.col("v")).alias("t")).first().t == []
