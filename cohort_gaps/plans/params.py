"""Analysis parameters: a two-column table, read by the plans as one row."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The default thresholds.
DEFAULTS = {
    "min_focus_cohort": 10.0,          # fewer focus members than this: figures say little
    "odds_z": 1.0,                     # residual z needed to beat the odds
    "deprived_decile": 3.0,            # serves a deprived zone: decile up to this ...
    "deprived_area_min_pct": 25.0,     # ... together with at least this focus share
    "deprived_pct": 40.0,              # or at least this focus share in any zone
}


def params_table(spark: SparkSession, **changes: float) -> DataFrame:
    """The parameters as ``(name, value)`` rows; keyword arguments replace defaults."""
    unknown = set(changes) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    rows = [(name, float(value)) for name, value in {**DEFAULTS, **changes}.items()]
    return spark.createDataFrame(rows, "name string, value double")


def params_pivot(params: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows to one row with a column per parameter."""
    return params.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names or list(DEFAULTS)])


def param(params: DataFrame, name: str) -> Column:
    """One parameter from a scalar subquery; every use has the same subquery, so Spark runs it once."""
    one_row = params.agg(F.struct(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in DEFAULTS]))
    return one_row.scalar().getField(name)
