"""Published files, registers and links read out of the shared test tables, in the layouts the readers expect."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.panel import GROUPS, MEASURE_COLUMNS, MEASURES
from ..sources import layouts as lay
from ..sources.text_tables import ORDER
from . import standins as st
from .standins import Tables


def _text(value: str, missing: str) -> Column:
    """One decimal as text, a code where the figure is missing."""
    return F.coalesce(F.round(value, 1).cast("decimal(18,1)").cast("string"), F.lit(missing))


def wide_file(t: Tables) -> DataFrame:
    """Results as the wide layout prints them: small cohorts twice, one totals row per period, unused columns."""
    rows = st.results(t).withColumn("period", F.col("period").cast("string"))
    figures = {c: _text(c, "SUPP") for c in MEASURE_COLUMNS}
    printed = {
        "RECTYPE": (F.col("is_special") + 1).cast("string"), "LEA": F.lit("300"), "ESTAB": F.lit("4000"),
        "URN": F.col("unit_id").cast("string"), "SCHNAME": F.concat(F.lit("Unit "), F.col("unit_id").cast("string")),
        "PCODE": F.concat(F.lit("u"), F.lpad(F.col("unit_id").cast("string"), 5, "0")),
        "TPUP": F.col("n_total").cast("string"),
        "TFSM6CLA1A": F.when(F.col("score_focus").isNull(), "NA").otherwise(F.col("n_focus").cast("string")),
        "TNOTFSM6CLA1A": F.when(F.col("period") >= "1999", F.col("n_rest").cast("string")).otherwise(""),
        "PTFSM6CLA1A": F.concat(_text("pct_focus", "NA"), F.lit("%")),
        **{lay.WIDE_FIGURE_HEADERS[c][0]: text for c, text in figures.items()}}
    one = rows.select("period", *[c.alias(n) for n, c in printed.items()])
    again = one.filter(F.col("TPUP").cast("int") < 75).withColumn("TPUP", F.lit("1"))
    totals = rows.groupBy("period").agg(F.sum("n_total").cast("string").alias("TPUP")).select("period", *[
        F.col("TPUP") if n == "TPUP" else F.lit("5" if n == "RECTYPE" else "").alias(n) for n in printed])
    return one.unionByName(again).unionByName(totals)


def long_file(t: Tables) -> DataFrame:
    """Results as the long layout prints them: a row per group, and a breakdown nobody asked for."""
    groups = {"all": ("Total", "Total"), "focus": ("Disadvantage status", "Disadvantaged"),
              "rest": ("Disadvantage status", "Not known to be disadvantaged")}
    counts = {"all": F.col("n_total").cast("string"), "focus": F.col("n_focus").cast("string"),
              "rest": F.when(F.col("period") >= 1999, F.col("n_rest").cast("string")).otherwise("z")}

    def row(topic: str, status: str, *figures: Column) -> Column:
        cells = [F.lit(topic), F.lit(status), *figures]
        return F.struct(*[c.alias(n) for c, n in zip(cells, lay.LONG_HEADERS[4:], strict=True)])

    rows = [row(topic, status, counts[g], *[_text(f"{m}_{g}", "c") for m in MEASURES])
            for g, (topic, status) in groups.items()]
    rows.append(row("Sex", "Total", counts["all"], F.lit("99"), F.lit("99"), F.lit("99")))
    period = F.col("period").cast("string")
    kind = F.when(F.col("is_special") == 1, "Special schools").otherwise("Academies")
    return st.results(t).select(
        F.concat(period, F.lpad(((F.col("period") + 1) % 100).cast("string"), 2, "0")).alias("time_period"),
        F.col("unit_id").cast("string").alias("school_urn"),
        F.concat(F.lit("Unit "), F.col("unit_id").cast("string")).alias("school_name"),
        kind.alias("establishment_type_group"), F.explode(F.array(*rows)).alias("row")).select(
        "time_period", "school_urn", "school_name", "establishment_type_group", "row.*", F.lit("x").alias("extra"))


def two_sources(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A long source from 1999 on, and a coarser wide source up to 1999; the year they share shows which one won."""
    rows = st.results(t).withColumns({"result_name": F.concat(F.lit("Unit "), F.col("unit_id").cast("string")),
                                      "result_postcode": F.lit(None).cast("string")})
    wide = rows.withColumns({f"{m}_{g}": F.round(f"{m}_{g}", 1) for m in MEASURES for g in GROUPS})
    return (rows.filter("period >= 1999").withColumn("source", F.lit("long")),
            wide.filter("period <= 1999").withColumn("source", F.lit("wide")))


def messy_customers(t: Tables) -> DataFrame:
    """Customers with the figures, codes and texts that published files contain."""
    whole = F.floor(F.abs("c_acctbal")).cast("bigint")
    text = whole.cast("string")
    style = F.col("c_custkey") % 7
    segment = F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey",
        F.when(style == 0, "SUPP").when(style == 1, F.concat(text, F.lit("%"))).when(style == 2, F.format_number(whole, 0))
        .when(style == 3, F.concat(F.lit(" \t"), text, F.lit(" "))).when(style == 4, "")
        .when(style == 5, F.concat(text, F.lit("d")))
        .otherwise(F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("amount"),
        F.when(segment == "BUILDING", "nan").when(segment == "MACHINERY", "inf")
        .when(segment == "FURNITURE", F.concat(F.col("c_nationkey").cast("string"), F.lit("e3")))
        .when(segment == "HOUSEHOLD", F.concat(F.lit("-."), F.col("c_nationkey").cast("string")))
        .otherwise("LOWCOV").alias("share"),
        F.when(F.col("c_acctbal") < 0, "X").when(F.col("c_acctbal") <= 9000, F.concat(
            F.lower(F.substring(segment, 1, 2)), F.col("c_nationkey").cast("string"), F.lit(" - "),
            (F.col("c_custkey") % 10).cast("string"), F.lit("xY"))).alias("code"),
        F.when(segment == "BUILDING", "").when(segment == "MACHINERY", "Not Applicable")
        .when(segment == "FURNITURE", "Not applicable").otherwise(F.col("c_name")).alias("region"),
        F.when(F.col("c_nationkey") == 7, "Not Applicable").otherwise("not applicable").alias("area_name"),
        F.col("c_acctbal").alias("easting"), (F.col("c_nationkey") - 2).cast("double").alias("northing"))


def period_texts(t: Tables) -> DataFrame:
    year = F.year("o_orderdate")
    after = F.lpad(((year + 1) % 100).cast("string"), 2, "0")
    first = year.cast("string")
    status = F.col("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(status == "F", F.concat(first, F.lit("-"), (year + 1).cast("string")))
                           .when(status == "O", F.concat(first, F.lit("-"), after))
                           .otherwise(F.concat(first, after)).alias("period_text"))


def date_texts(t: Tables) -> DataFrame:
    printed = F.date_format("o_orderdate", "dd-MM-yyyy")
    low = F.col("o_orderpriority") == "5-LOW"
    return t.orders.select("o_orderkey", F.when(low & (F.col("o_orderstatus") == "P"), "")
                           .when(low, "bad").otherwise(printed).alias("open_date"))


def typed_parts(t: Tables) -> DataFrame:
    kind, brand = F.col("p_type"), F.col("p_brand")
    return t.part.select(
        "p_partkey",
        F.when(kind == "ECONOMY", "Academy special converter").when(kind == "LARGE", "Academy converter")
        .when(kind == "MEDIUM", "Community school").when(kind == "PROMO", "University technical college")
        .when(kind == "SMALL", "Other school").otherwise("Academy sponsor led").alias("type_name"),
        F.when(brand.startswith("Brand#1"), "Academies")
        .when(brand.startswith("Brand#2"), "Local authority maintained schools")
        .when(brand == "Brand#3", "Independent schools").when(brand == "Brand#4", "Special schools")
        .when(brand == "Brand#5", "Free Schools").alias("type_group"))


def ranked_zones(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_name").alias("zone_code"), (F.col("c_custkey") + 1).cast("double").alias("zone_rank"),
                             F.lit(None).cast("double").alias("zone_score"), F.lit(None).cast("int").alias("zone_decile"))


def gappy_counts(t: Tables) -> DataFrame:
    """Results where the counts or the share are missing by period."""
    year = F.col("period")
    return st.results(t).select(
        "unit_id", "period", F.col("n_total").cast("double").alias("n_total"),
        F.when(year >= 1998, F.col("n_focus").cast("double")).alias("n_focus"),
        F.when(year == 2000, F.col("n_rest").cast("double")).alias("n_rest"),
        F.when(year != 1999, F.round("pct_focus", 1)).alias("pct_focus"))


def grid_points(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", (F.lit(200000.0) + (F.col("c_custkey") * 37) % 400000).alias("easting"),
                             (F.lit(100000.0) + (F.col("c_custkey") * 53) % 500000).alias("northing"))


def part_units(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("unit_id"), F.col("p_name").alias("result_name"),
                         F.col("p_brand").alias("result_postcode"))


def part_register(t: Tables) -> DataFrame:
    """Larger parts are in the register, small ones are missing from it."""
    return t.part.filter("p_size > 5").select(
        F.col("p_partkey").alias("unit_id"), F.when(F.col("p_size") > 8, F.col("p_name")).alias("unit_name"),
        F.col("p_brand").alias("postcode"), F.when(F.col("p_type") != "PROMO", F.col("p_type")).alias("unit_type"),
        F.col("p_type").alias("area_code"), F.col("p_retailprice").alias("latitude"))


def worded_parts(t: Tables) -> DataFrame:
    """Parts with names of one to fifteen words that share some of them; the larger the part, the more words."""
    size, price = F.col("p_size"), F.floor("p_retailprice").cast("bigint")
    name = F.when(size < 3, F.substring_index("p_name", " ", 1)).otherwise(F.concat_ws(
        " ", "p_name", "p_type", "p_brand", F.when(size > 9, F.concat(F.lit("size "), size.cast("string"))),
        F.when(size > 20, F.concat_ws(" ", F.lit("price"), price.cast("string"), F.lit("group"),
                                      F.floor(price / 100).cast("string"))),
        F.when(size > 35, F.concat_ws(" ", F.lit("lot"), (F.col("p_partkey") % 17).cast("string"), F.lit("shelf"),
                                      (price % 5).cast("string")))))
    return t.part.select(F.col("p_partkey").alias("unit_id"), name.alias("name"), F.col("p_brand").alias("postcode"),
                         (F.col("p_type") == "PROMO").alias("is_missing"))


def worded_orders(t: Tables) -> DataFrame:
    """Orders as units whose names share some of their words with others."""
    named = F.concat_ws(" ", "o_orderpriority", F.lit("grade"), "o_orderstatus",
                        F.when(F.col("o_totalprice") > 150000, F.date_format("o_orderdate", "'month' MM")),
                        F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("size "), F.floor(
                            F.col("o_totalprice") / 50000).cast("string"))))
    return order_register(t).drop("unit_name").join(
        t.orders.select(F.col("o_orderkey").alias("unit_id"), named.alias("unit_name")), "unit_id")


def register_file(t: Tables) -> DataFrame:
    """A register as published, with every customer twice: the second row of a unit does not count."""
    segment, key = F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    raw = t.customer.select(
        key.alias("URN"), F.col("c_name").alias("EstablishmentName"),
        F.concat(F.lit(" ab"), F.col("c_nationkey").cast("string"), F.lit(" "), (F.col("c_custkey") % 10).cast("string"),
                 F.lit("cd")).alias("Postcode"),
        F.col("c_nationkey").cast("string").alias("LA (code)"),
        F.when(segment == "BUILDING", "Not Applicable").otherwise(segment).alias("GOR (name)"),
        F.when(segment == "MACHINERY", "Academy sponsor led").otherwise("Community school")
        .alias("TypeOfEstablishment (name)"),
        F.when(segment == "FURNITURE", "Independent schools").otherwise("Academies").alias("EstablishmentTypeGroup (name)"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lpad((F.col("c_custkey") % 28 + 1).cast("string"), 2, "0"),
                                                F.lit("-03-20"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")))
        .otherwise("unknown").alias("OpenDate"), F.lit(0).cast("bigint").alias(ORDER))
    again = raw.withColumns({"EstablishmentName": F.lit("later row"), ORDER: F.lit(1).cast("bigint")})
    return raw.unionByName(again)


def links_file(t: Tables) -> DataFrame:
    """Links as published; those of cheap orders lack the other id."""
    return t.orders.select(
        F.col("o_orderkey").cast("string").alias("URN"),
        F.when(F.col("o_totalprice") > 50000, F.col("o_custkey").cast("string")).otherwise("").alias("LinkURN"),
        F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")).alias("LinkType"))


def zones_file(t: Tables) -> DataFrame:
    """Zone scores under the headers of a release; some zones come without a score."""
    return t.customer.select(
        F.concat(F.lit("E"), F.col("c_custkey").cast("string"), F.lit(" ")).alias("LSOA code (2011)"),
        F.col("c_mktsegment").alias("Local Authority District name (2019)"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("decimal(18,2)").cast("string")).otherwise("-")
        .alias("Index of Multiple Deprivation (IMD) Score"),
        (F.col("c_custkey") + 1).cast("string").alias("Index of Multiple Deprivation (IMD) Rank (where 1 is first)"),
        (F.col("c_custkey") % 10 + 1).cast("string").alias("Index of Multiple Deprivation (IMD) Decile"),
        F.format_number(F.col("c_nationkey") * 1000, 0).alias("Total population: mid 2015"))


def directory_file(t: Tables) -> DataFrame:
    """A postcode directory with the newer and the older zone column."""
    return t.customer.select(
        F.concat(F.char(97 + F.col("c_custkey") % 26), F.char(97 + F.floor(F.col("c_custkey") / 26) % 26),
                 (F.floor(F.col("c_custkey") / 676) % 100).cast("string"),
                 F.floor(F.col("c_custkey") / 67600).cast("string"), F.lit("aa")).alias("pcds"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit(" E"), F.col("c_nationkey").cast("string"))).otherwise("")
        .alias("lsoa21cd"), F.lit("old").alias("lsoa11cd"))


def part_zones(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Parts whose zone is known for some, and a directory that knows one zone per postcode."""
    units = t.part.select(F.col("p_partkey").alias("unit_id"), F.col("p_brand").alias("postcode"),
                          F.when(F.col("p_size") > 10, F.col("p_type")).alias("zone_code"))
    return units, t.part.groupBy(F.col("p_brand").alias("postcode")).agg(F.min("p_type").alias("zone_code"))


def order_results(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("unit_id"), F.year("o_orderdate").alias("period"),
                           F.col("o_orderpriority").alias("result_name"),
                           F.col("o_custkey").cast("string").alias("result_postcode"))


def order_register(t: Tables) -> DataFrame:
    """Orders as units that open on the order date and close with the last shipment."""
    closed = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_shipdate").cast("date").alias("close_date"))
    status = F.col("o_orderstatus")
    text = {"type_name": "Community school", "type_group": "Academies", "phase": "Secondary", "gender": "Mixed",
            "religious_character": "None", "admissions": "Non-selective", "setting": "Urban", "status": "Open",
            "district_name": "District", "trust_name": "Trust"}
    return t.orders.join(closed, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("unit_id"), F.col("o_orderpriority").alias("unit_name"),
        F.col("o_custkey").cast("string").alias("postcode"), F.col("o_orderdate").cast("date").alias("open_date"),
        "close_date", F.substring("o_orderpriority", 1, 1).alias("area_code"),
        F.col("o_orderpriority").alias("area_name"), status.alias("region"),
        F.when(status != "P", F.concat(F.lit("Z"), F.col("o_custkey").cast("string"))).alias("zone_code"),
        status.alias("district_code"), F.col("o_totalprice").alias("easting"), F.col("o_totalprice").alias("northing"),
        (F.col("o_totalprice") / 7000).alias("latitude"), (F.col("o_totalprice") / 9000).alias("longitude"),
        F.lit("LA maintained").alias("unit_type"), *[F.lit(v).alias(k) for k, v in text.items()])


def order_links(t: Tables) -> DataFrame:
    """Each order linked to the one with the next key; expensive ones also to the first of their ten, so that links fan
    in and out."""
    status, here = F.col("o_orderstatus"), F.col("o_orderkey")
    following = t.orders.select(
        F.when(status == "O", here + 1).otherwise(here).alias("unit_id"),
        F.when(status == "O", here).otherwise(here + 1).alias("link_id"),
        F.when(status == "F", "Successor").when(status == "O", "Predecessor").otherwise("Successor - amalgamated")
        .alias("link_type"))
    extra = t.orders.filter("o_totalprice > 450000").select(
        here.alias("unit_id"), (here - here % 10).alias("link_id"), F.lit("Successor").alias("link_type"))
    return following.unionByName(extra)


def order_directory(t: Tables) -> DataFrame:
    return t.customer.filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("postcode"),
                                                     F.concat(F.lit("D"), F.col("c_nationkey").cast("string"))
                                                     .alias("zone_code"))
