"""Two-predictor least squares per group from two aggregates."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Predictors whose squared correlation is nearer to 1 than this count as collinear.
SINGULAR = 1e-12


def ols_two(df: DataFrame, groups: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Per group ``n``, means, ``b0``, ``b1``, ``b2`` and the residual standard error with ``n - 3`` degrees of freedom.

    The slopes come from one pass of mergeable variance and covariance aggregates, which centre as they go; a second
    aggregate sums the squared residuals themselves, because a difference of moments loses the digits of a close fit.
    Slopes are NULL for collinear predictors; the standard error is NULL without a degree of freedom.
    """
    moments = df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.avg(y).alias("my"),
        F.var_pop(x1).alias("_v1"), F.var_pop(x2).alias("_v2"), F.covar_pop(x1, x2).alias("_c12"),
        F.covar_pop(x1, y).alias("_c1y"), F.covar_pop(x2, y).alias("_c2y"))
    spread = F.col("_v1") * F.col("_v2")
    det = spread - F.col("_c12") * F.col("_c12")
    solved = moments.withColumn("_det", F.when(det > spread * F.lit(SINGULAR), det)).select(
        *groups, "n", "m1", "m2", "my",
        ((F.col("_v2") * F.col("_c1y") - F.col("_c12") * F.col("_c2y")) / F.col("_det")).alias("b1"),
        ((F.col("_v1") * F.col("_c2y") - F.col("_c12") * F.col("_c1y")) / F.col("_det")).alias("b2"))

    def keyed(table: DataFrame, mark: str, columns: list[str]) -> DataFrame:
        return table.select(*[F.col(g).alias(f"_{mark}{i}") for i, g in enumerate(groups)],
                            *[F.col(c).alias(f"_{mark}_{c}") for c in columns])

    def on(left: str, right: str):
        return reduce(lambda a, b: a & b, [F.col(f"_{left}{i}").eqNullSafe(F.col(f"_{right}{i}"))
                                           for i in range(len(groups))], F.lit(True))

    rows = keyed(df, "r", [y, x1, x2]).join(keyed(solved, "s", ["m1", "m2", "my", "b1", "b2"]), on("r", "s"))
    residual = (F.col(f"_r_{y}") - F.col("_s_my") - F.col("_s_b1") * (F.col(f"_r_{x1}") - F.col("_s_m1"))
                - F.col("_s_b2") * (F.col(f"_r_{x2}") - F.col("_s_m2")))
    errors = rows.groupBy(*[f"_r{i}" for i in range(len(groups))]).agg(F.sum(residual * residual).alias("_error"))
    found = errors.select(*[F.col(f"_r{i}").alias(f"_e{i}") for i in range(len(groups))], "_error")
    same = reduce(lambda a, b: a & b, [solved[g].eqNullSafe(F.col(f"_e{i}")) for i, g in enumerate(groups)], F.lit(True))
    return solved.join(found, same, "left").select(
        *groups, "n", "m1", "m2", "my",
        (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("b0"), "b1", "b2",
        F.when((F.col("n") > 3) & F.col("b1").isNotNull(),
               F.sqrt(F.col("_error") / F.when(F.col("n") > 3, F.col("n") - 3))).alias("residual_sd"))
