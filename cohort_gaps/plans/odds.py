"""Units whose focus group does better than zone and intake predict."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rank_key
from ..operators.ranking import with_rank
from ..operators.regression import ols_two
from ..session import cut_lineage
from .panel import per_period
from .params import param

# Evidence labels.
CONSISTENT = "Consistent (2+ years)"
LATEST = "Latest year"
EARLIER = "Earlier year"


def odds_eligible(gaps: DataFrame) -> DataFrame:
    """Rows the model is fitted on: mainstream, not selective, large enough, and with all three variables."""
    return gaps.filter(
        (F.col("is_mainstream") == 1) & (F.coalesce("admissions", F.lit("")) != "Selective")
        & (F.col("reportable") == 1) & F.col("score_focus").isNotNull() & F.col("zone_score").isNotNull()
        & F.col("pct_focus").isNotNull())


def odds_model(eligible: DataFrame) -> DataFrame:
    """The fitted model, one row per period."""
    fitted = ols_two(eligible, ["period"], "score_focus", "zone_score", "pct_focus")
    return fitted.select("period", F.col("n").alias("n_in_model"), "m1", "m2", "my", "b0", F.col("b1").alias("b_zone"),
                         F.col("b2").alias("b_pct"), "residual_sd")


def odds_residuals(eligible: DataFrame, model: DataFrame) -> DataFrame:
    """Expected value, residual and z per row."""
    joined = eligible.join(per_period(model), "period")
    expected = (F.col("my") + F.col("b_zone") * (F.col("zone_score") - F.col("m1"))
                + F.col("b_pct") * (F.col("pct_focus") - F.col("m2")))
    return (joined.withColumn("score_focus_expected", expected)
            .withColumn("residual", F.col("score_focus") - F.col("score_focus_expected"))
            .withColumn("residual_z", F.try_divide("residual", "residual_sd"))
            .drop("m1", "m2", "my"))


def odds_flagged(residuals: DataFrame, params: DataFrame) -> DataFrame:
    """Who serves a deprived community, and who beats the odds while doing so."""
    share = F.col("pct_focus")
    deprived = (((F.col("zone_decile") <= param(params, "deprived_decile"))
                 & (share >= param(params, "deprived_area_min_pct")))
                | (share >= param(params, "deprived_pct")))
    return (residuals.withColumn("serves_deprived", F.when(deprived, 1).otherwise(0))
            .withColumn("z_threshold", param(params, "odds_z"))
            .withColumn("beating_odds", F.when((F.col("serves_deprived") == 1)
                                               & (F.col("residual_z") >= F.col("z_threshold")), 1).otherwise(0)))


def odds(gaps: DataFrame, params: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Model, residuals and flags per unit and period, without the ranks. The model is fitted on ``base``, which has all
    it needs, if that is given."""
    model = odds_model(odds_eligible(gaps if base is None else base))
    return odds_flagged(odds_residuals(odds_eligible(gaps), model), params)


def odds_ranked(flagged: DataFrame, written: bool = False) -> DataFrame:
    """Rank of the residual in its period and in its area. A period holds every unit, so neither is a plain window.

    Both ranks count the rows and join back to them, so they are written first, unless ``written`` says they are.
    """
    keyed = (flagged if written else cut_lineage(flagged)).withColumn("_residual_key", rank_key("residual"))
    ranked = with_rank(keyed, ["period"], "_residual_key", "rank_residual", counted=keyed)
    return with_rank(ranked, ["period", "area_code"], "_residual_key", "rank_residual_in_area",
                     counted=keyed).drop("_residual_key")


LIST_COLUMNS = ["lineage_id", "unit_id", "unit_name", "area_code", "area_name", "region", "unit_type", "trust_name",
                "postcode", "latitude", "longitude", "latest_period", "zone_decile", "pct_focus", "n_focus",
                "score_focus", "score_focus_expected", "residual", "residual_z", "gap_vs_benchmark", "gap_within_unit",
                "progress_focus", "basics_focus", "beating_odds_latest", "periods_in_model", "periods_beating_odds",
                "avg_residual", "avg_residual_z", "evidence"]


def beating_the_odds(flagged: DataFrame) -> DataFrame:
    """One row per lineage that ever beat the odds and serves a deprived community in its latest model period.

    A lineage has at most one row per period, so its windows are small.
    """
    lineage = Window.partitionBy("lineage_id")
    history = (flagged
               .withColumn("periods_in_model", F.count(F.lit(1)).over(lineage))
               .withColumn("periods_beating_odds", F.sum("beating_odds").over(lineage))
               .withColumn("avg_residual", F.avg("residual").over(lineage))
               .withColumn("avg_residual_z", F.avg("residual_z").over(lineage))
               .withColumn("_recency", F.row_number().over(lineage.orderBy(F.desc("period")))))
    evidence = (F.when(F.col("periods_beating_odds") >= 2, CONSISTENT)
                .when(F.col("beating_odds") == 1, LATEST).otherwise(EARLIER))
    listed = history.filter((F.col("_recency") == 1) & (F.col("serves_deprived") == 1)
                            & (F.col("periods_beating_odds") >= 1))
    return (listed.withColumn("latest_period", F.col("period_label"))
            .withColumn("beating_odds_latest", F.col("beating_odds")).withColumn("evidence", evidence)
            .select(*LIST_COLUMNS))


def model_summary(flagged: DataFrame) -> DataFrame:
    """The model behind the flags, one row per period."""
    return flagged.select("period_label", "n_in_model", "b0", "b_zone", "b_pct", "residual_sd").distinct().orderBy(
        "period_label")
