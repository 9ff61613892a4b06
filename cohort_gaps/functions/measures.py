"""Arithmetic on measures that may be suppressed (NULL)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weighted_mean(weight: Column | str, value: Column | str) -> Column:
    """Mean of the published values only; a row without a weight counts in neither sum."""
    weight = F.col(weight) if isinstance(weight, str) else weight
    value = F.col(value) if isinstance(value, str) else value
    published = value.isNotNull()
    return F.try_divide(F.sum(F.when(published, weight * value)),
                        F.sum(F.when(published, weight)).cast("double"))


def percent(part: Column | str, whole: Column | str) -> Column:
    """``100 * part / whole`` as a double, NULL when ``whole`` is 0 or NULL."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.try_divide(F.lit(100.0) * part, whole.cast("double"))


def half_even(value: Column | str, decimals: int = 0) -> Column:
    """Round half to even, which ``F.round`` does not do."""
    value = F.col(value) if isinstance(value, str) else value
    if decimals == 0:
        return F.rint(value)
    factor = float(10 ** decimals)
    return F.rint(value * F.lit(factor)) / F.lit(factor)


def rank_key(value: Column | str) -> Column:
    """The value ranks are taken on: 9 decimals, so that summation order cannot split a tie."""
    return F.round(value, 9)


def not_nan(value: Column | str) -> Column:
    """NaN to NULL: a missing figure is NULL in every table."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), value)
