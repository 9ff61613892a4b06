"""Units, periods, zones and registers read out of the shared test tables.

A unit is a supplier, a period the year of shipment, the focus group the returned lines. Every flag comes from an
attribute of the row, and every table below covers its source whole.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import percent


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}


class Tables:
    """The shared tables of one scale, read lazily; a stated schema saves the footer scan that would infer it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")


def results(t: Tables) -> DataFrame:
    """Unit by period: counts and three measures for all, focus and rest. Small focus groups have no score."""
    focus = F.col("l_returnflag") == "R"
    measures = {"score": F.col("l_extendedprice") / F.col("l_quantity"),
                "progress": F.lit(100.0) * F.col("l_tax"), "basics": F.lit(100.0) * F.col("l_discount")}
    groups = {"all": F.lit(True), "focus": focus, "rest": ~focus}
    sums = t.lineitem.groupBy(F.col("l_suppkey").alias("unit_id"), F.year("l_shipdate").alias("period")).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(focus).alias("n_focus"),
        *[F.avg(F.when(g, x)).alias(f"{m}_{k}") for m, x in measures.items() for k, g in groups.items()])
    return (sums.withColumn("period_label", F.concat(F.col("period").cast("string"), F.lit("-"),
                                                     F.lpad(((F.col("period") + 1) % 100).cast("string"), 2, "0")))
            .withColumn("n_rest", F.col("n_total") - F.col("n_focus"))
            .withColumn("pct_focus", percent("n_focus", "n_total"))
            .withColumn("score_focus", F.when(F.col("n_focus") >= 20, F.col("score_focus")))
            .withColumn("is_special", (F.col("n_rest") < 45).cast("int")))


def units(t: Tables) -> DataFrame:
    """Suppliers as units, nations as areas."""
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    balance = F.col("s_acctbal")
    kind = (F.when(balance < 0, "Independent").when(balance < 3000, "LA maintained")
            .when(balance < 6000, "Academy (converter)").when(balance < 8000, "Academy (sponsor led)")
            .when(balance < 9500, "Free school / UTC / studio").otherwise("Other"))
    return t.supplier.join(place, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("unit_id"), F.col("s_suppkey").alias("lineage_id"), F.col("s_name").alias("unit_name"),
        F.concat(F.lit("PC"), F.col("s_nationkey").cast("string")).alias("postcode"),
        F.col("s_nationkey").cast("string").alias("area_code"), F.col("n_name").alias("area_name"),
        F.col("r_name").alias("region"), kind.alias("unit_type"), kind.alias("type_name"),
        F.concat(F.lit("Trust "), F.col("r_name")).alias("trust_name"), F.lit("Mixed").alias("gender"),
        F.lit("None").alias("religious_character"),
        F.when(balance.between(4000, 4600), "Selective").when(balance > 2000, "Non-selective").alias("admissions"),
        F.when(balance > 5000, "Urban").otherwise("Rural").alias("setting"),
        (F.lit(50.0) + balance / 3000).alias("latitude"), (F.lit(0.0) - balance / 7000).alias("longitude"),
        F.when(~balance.between(5000, 5300), F.concat(F.lit("Z"), F.col("s_suppkey").cast("string")))
        .alias("zone_code"))


def zones(t: Tables) -> DataFrame:
    """One zone per supplier: score from the balance, decile by equal steps of it."""
    decile = F.least(F.lit(10), F.greatest(F.lit(1), F.lit(1) + F.floor((F.lit(10000.0) - F.col("s_acctbal")) / 1100)))
    return t.supplier.select(
        F.concat(F.lit("Z"), F.col("s_suppkey").cast("string")).alias("zone_code"),
        F.col("s_acctbal").alias("zone_score"), decile.cast("int").alias("zone_decile"),
        (F.col("s_acctbal") / 100).alias("child_score"), (F.lit(11) - decile).cast("int").alias("child_decile"))


def params(t: Tables) -> DataFrame:
    """Thresholds as rows, the share thresholds taken from the overall focus share."""
    share = t.lineitem.agg(F.round(F.lit(100.0) * F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1)), 2)
                           .alias("share"))
    return share.select(F.expr("""stack(5, 'min_focus_cohort', floor(share * 0.66D) * 1.0D, 'odds_z', 0.5D,
        'deprived_decile', 5.0D, 'deprived_area_min_pct', share, 'deprived_pct', share + 4.0D) AS (name, value)"""))


def area_register(t: Tables) -> DataFrame:
    """Customers as register rows that say which area each district belongs to."""
    return t.customer.select(F.col("c_custkey").alias("unit_id"), _district().alias("district_code"),
                             F.col("c_nationkey").cast("string").alias("area_code"))


def area_zones(t: Tables) -> DataFrame:
    """Customers as zones: population and score are missing for some."""
    balance = F.col("c_acctbal")
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("zone_code"), _district().alias("district_code"),
        F.when(balance >= 500, F.floor(balance) * F.lit(1.0)).alias("population"),
        F.when(~balance.between(3000, 3700), balance).alias("zone_score"),
        (F.lit(1) + F.floor(F.greatest(balance, F.lit(0.0)) / 1000)).cast("int").alias("zone_decile"))


def _district():
    return F.concat(F.col("c_mktsegment"), F.lit("-"), F.floor(F.col("c_acctbal") / 1000).cast("string"))
