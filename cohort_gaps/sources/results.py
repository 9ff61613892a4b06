"""Results per unit and period, from the wide and the long layout, and both merged."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (clean_number, half_even, normalise_code, numeric_id, percent, period_label, period_start,
                         trim_all)
from ..operators.dedupe import keep_largest
from ..plans.panel import GROUPS, MEASURE_COLUMNS, MEASURES, per_period
from . import layouts as lay
from .files import newest_file, yearly_files
from .text_tables import ORDER, pick, read_text_table, tidy_columns

FIGURES = ["n_total", "n_focus", "n_rest", "pct_focus", *MEASURE_COLUMNS]
COLUMNS = ["period_label", "period", "unit_id", "result_name", "result_postcode", "is_special", *FIGURES]


def derive_counts(df: DataFrame) -> DataFrame:
    """Fill the focus count from its share, the rest from the total, and the share from the counts; counts are whole."""
    from_share = half_even(F.col("n_total") * F.col("pct_focus") / F.lit(100.0))
    filled = df.withColumn("n_focus", F.coalesce("n_focus", from_share))
    filled = filled.withColumn("n_rest", F.coalesce("n_rest", F.col("n_total") - F.col("n_focus")))
    filled = filled.withColumn("pct_focus", F.coalesce("pct_focus", percent("n_focus", "n_total")))
    return filled.withColumns({c: half_even(c).try_cast("bigint") for c in ("n_total", "n_focus", "n_rest")})


def tidy_wide(raw: DataFrame, period: Column | str) -> DataFrame:
    """Wide layout to results: record types 1 and 2 only, one row per unit (the larger one) and period."""
    has_type = pick(raw, lay.WIDE_ID_HEADERS["record_type"]) is not None
    period_text = F.lit(period) if isinstance(period, str) else period
    tidy = tidy_columns(raw.withColumn("_period", period_text), {**lay.WIDE_ID_HEADERS, **lay.WIDE_FIGURE_HEADERS,
                                                                 "period_text": ["_period"]}, ["unit_id"])
    kind = trim_all("record_type")
    if has_type:
        tidy = tidy.filter(kind.isin(lay.RECORD_MAINSTREAM, lay.RECORD_SPECIAL))
    start = period_start("period_text")
    rows = tidy.select(
        start.alias("period"), numeric_id("unit_id").alias("unit_id"), "result_name",
        normalise_code("result_postcode").alias("result_postcode"),
        (F.when(kind == lay.RECORD_SPECIAL, 1).otherwise(0) if has_type else F.lit(0)).alias("is_special"),
        *[clean_number(c).alias(c) for c in lay.WIDE_FIGURE_HEADERS], ORDER).filter(F.col("unit_id").isNotNull())
    rows = derive_counts(rows.withColumn("period_label", period_label("period")))
    return keep_largest(rows, ["period", "unit_id"], "n_total", [F.col(ORDER)]).select(*COLUMNS)


def slim_wide(raw: DataFrame) -> DataFrame:
    """The id and figure columns of a wide file, untouched."""
    wanted = [*lay.WIDE_KEPT_IDS, *[h for hs in lay.WIDE_FIGURE_HEADERS.values() for h in hs]]
    if pick(raw, ["URN"]) is None:
        raise ValueError("no URN column: is this the unit-level file?")
    upper = {w.upper() for w in wanted}
    return raw.select(*[F.col(f"`{c}`") for c in raw.columns if c.upper() in upper])


def slim_long(raw: DataFrame) -> DataFrame:
    """The rows and columns of a long file that the reader uses, untouched."""
    missing = [c for c in lay.LONG_HEADERS if c not in raw.columns]
    if missing:
        raise ValueError(f"the long results file has no columns {missing}")
    kept = raw.filter(F.col("breakdown_topic").isin(lay.LONG_TOPICS))
    return kept.select(*lay.LONG_HEADERS, *[c for c in raw.columns if c == ORDER])


def tidy_long(raw: DataFrame) -> DataFrame:
    """Long layout to results: three groups by four figures pivoted to one row per unit and period.

    The first published figure in file order counts. ``min_by`` combines before the shuffle.
    """
    slim = slim_long(raw)
    order = F.col(ORDER) if ORDER in slim.columns else F.monotonically_increasing_id()
    status = F.col("disadvantage_status")
    group = F.when(F.col("breakdown_topic") == "Total", "all")
    for text, name in lay.LONG_GROUPS.items():
        group = group.when(status == text, name)
    rows = slim.select(
        period_start("time_period").alias("period"), "time_period", numeric_id("school_urn").alias("unit_id"),
        group.alias("group"), F.struct("school_name", "establishment_type_group").alias("_info"),
        *[clean_number(c).alias(name) for c, name in lay.LONG_FIGURES.items()], order.alias(ORDER))
    rows = rows.filter(F.col("group").isNotNull() & F.col("unit_id").isNotNull())
    wide = rows.groupBy("time_period", "period", "unit_id").pivot("group", list(GROUPS)).agg(
        *[F.min_by(name, F.when(F.col(name).isNotNull(), F.col(ORDER))).alias(name)
          for name in lay.LONG_FIGURES.values()],
        F.min_by("_info", ORDER).alias("info"))
    total, focus = F.col("all_n"), F.col("focus_n")
    rest = F.coalesce(F.col("rest_n"), total - focus)
    special = F.lower(F.coalesce(F.col("all_info.establishment_type_group"), F.lit(""))).contains("special")
    return wide.select(
        period_label("period").alias("period_label"), "period", "unit_id",
        F.col("all_info.school_name").alias("result_name"), F.lit(None).cast("string").alias("result_postcode"),
        special.cast("int").alias("is_special"),
        *[half_even(c).try_cast("bigint").alias(n) for c, n in ((total, "n_total"), (focus, "n_focus"),
                                                               (rest, "n_rest"))],
        percent(focus, total).alias("pct_focus"),
        *[F.col(f"{g}_{m}").alias(f"{m}_{g}") for m in MEASURES for g in GROUPS])


def merge_results(long: DataFrame | None, wide: DataFrame | None) -> DataFrame:
    """The long source wins the periods it has; the wide source fills the others."""
    if long is None or wide is None:
        merged = wide if long is None else long
        if merged is None:
            raise ValueError("no results: give a long or a wide source")
        return merged
    fill = wide.join(per_period(long.select("period").distinct()), "period", "left_anti")
    return long.unionByName(fill, allowMissingColumns=True)


def read_wide(spark: SparkSession, path: str, period: str) -> DataFrame:
    return tidy_wide(read_text_table(spark, path), period)


def read_long(spark: SparkSession, path: str) -> DataFrame:
    return tidy_long(read_text_table(spark, path))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """All results below ``folder``; two folders of one year count once."""
    path = newest_file(spark, f"{folder}/{lay.LONG_FILES[0]}", lay.LONG_FILES[1])
    long = read_long(spark, path) if path else None
    wide = None
    for period, file in yearly_files(spark, folder).items():
        rows = read_wide(spark, file, period).withColumn("_folder", F.lit(period))
        wide = rows if wide is None else wide.unionByName(rows)
    if wide is not None:
        wide = keep_largest(wide, ["period", "unit_id"], "n_total", [F.col("_folder")]).drop("_folder")
    return merge_results(long, wide)
