"""Follow a unit through changes of its id."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.intervals import interval_similarity_edges
from ..session import cut_lineage

# Link types that name a merger or a split, and the labels of the methods.
NOT_ONE_TO_ONE = "amalgamat|merge|split"
SELF, BY_LINK, BY_POSTCODE = "self", "gias_link", "postcode_match"


def one_to_one_links(links: DataFrame) -> DataFrame:
    """(predecessor, successor) pairs where neither side has another partner; mergers, splits and loops are left out."""
    kind = F.lower("link_type")
    plain = links.filter(~kind.rlike(NOT_ONE_TO_ONE))
    forward = plain.filter(kind.startswith("successor")).select(F.col("unit_id").alias("pred"),
                                                                F.col("link_id").alias("succ"))
    backward = plain.filter(kind.startswith("predecessor")).select(F.col("link_id").alias("pred"),
                                                                   F.col("unit_id").alias("succ"))
    pairs = forward.union(backward).filter("pred <> succ").distinct()
    # Only the ids with one partner are kept, so a hub of links is one count and joins nothing.
    single_pred = pairs.groupBy("pred").agg(F.count(F.lit(1)).alias("n"), F.max("succ").alias("succ")).filter("n = 1")
    single_succ = pairs.groupBy("succ").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("succ")
    return single_pred.select("pred", "succ").join(single_succ, "succ", "left_semi").select("pred", "succ")


def lineage_clashes(years: DataFrame) -> DataFrame:
    """Components with two or more units in one period; ``years`` is (unit_id, period, component)."""
    return (years.groupBy("component", "period").agg(F.countDistinct("unit_id").alias("n_units"))
            .filter(F.col("n_units") > 1))


def build_lineage(results: DataFrame, register: DataFrame, links: DataFrame | None, max_gap_days: int = 60,
                  min_similarity: float = 0.5) -> DataFrame:
    """``unit_id``, ``lineage_id`` and ``lineage_method`` for every unit with results.

    Links come first, through ids without results. Units that are then alone in their group may join by postcode, date
    and name. A group with two units in one period is dissolved. The lineage id is the largest id with results.
    """
    years = cut_lineage(results.select("unit_id", "period").distinct())
    units = years.select("unit_id").distinct()
    if links is None:
        linked = units.select("unit_id", F.col("unit_id").alias("first_group"), F.lit(False).alias("is_linked"))
    else:
        groups = connected_components(one_to_one_links(links), "pred", "succ")
        linked = units.join(groups.withColumnRenamed("node", "unit_id"), "unit_id", "left").select(
            "unit_id", F.coalesce("component", "unit_id").alias("first_group"),
            F.col("component").isNotNull().alias("is_linked"))
    linked = cut_lineage(linked)

    alone = linked.groupBy("first_group").agg(F.count(F.lit(1)).alias("n"), F.max("unit_id").alias("unit_id"))
    alone = alone.filter("n = 1").select("unit_id")
    edges = interval_similarity_edges(register.join(alone, "unit_id", "left_semi"), max_gap_days=max_gap_days,
                                      min_similarity=min_similarity)
    met = connected_components(edges, "unit", "centre").select(F.col("node").alias("unit_id"),
                                                               F.col("component").alias("second_group"))
    both = linked.join(met, "unit_id", "left").select(
        "unit_id",
        F.when(F.col("second_group").isNotNull(), F.struct(F.lit(2).alias("stage"), F.col("second_group").alias("id")))
        .otherwise(F.struct(F.lit(1).alias("stage"), F.col("first_group").alias("id"))).alias("component"),
        F.when(F.col("second_group").isNotNull(), BY_POSTCODE).when(F.col("is_linked"), BY_LINK)
        .otherwise(SELF).alias("method"))
    both = cut_lineage(both)

    bad = lineage_clashes(years.join(both, "unit_id")).select("component").distinct()
    # A group without a clash has at most one unit per period, so its size is bounded by the number of periods.
    sizes = (both.join(bad, "component", "left_anti").groupBy("component")
             .agg(F.max("unit_id").alias("lineage_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    return both.join(sizes, "component", "left").select(
        "unit_id", F.coalesce("lineage_id", "unit_id").alias("lineage_id"),
        F.when(F.col("lineage_id").isNotNull(), F.col("method")).otherwise(SELF).alias("lineage_method"))
