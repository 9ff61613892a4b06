"""Text clean-up as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes printed in place of a number (suppressed, not applicable, no entries, low coverage, ...).
SUPPRESSION_CODES = ("SUPP", "NE", "NA", "NP", "LOWCOV", "NEW", "SP", "DNS", "NAT", "NEWSCH",
                     "x", "c", "z", "u", "low", ":", ".", "-", "")

# Words that say nothing about which unit a name means.
STOP_WORDS = ("the", "school", "academy", "college", "of", "and", "a", "st", "saint")

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_OUTER_SPACE = r"(?U)^\s+|\s+$"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def trim_all(value: Column | str) -> Column:
    """Drop every kind of leading and trailing white space, tabs included."""
    return F.regexp_replace(_column(value), _OUTER_SPACE, "")


def clean_number(value: Column | str) -> Column:
    """``'23%'`` to 23.0, ``'1,204'`` to 1204.0, suppression codes and other text to NULL."""
    text = trim_all(_column(value).cast("string"))
    bare = trim_all(F.regexp_replace(text, "[%,]", ""))
    number = F.when(~text.isin(*SUPPRESSION_CODES) & bare.rlike(_NUMBER), bare.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def numeric_id(value: Column | str) -> Column:
    """A whole-number id from text; NULL when the text is not a number. Decimal keeps long ids exact."""
    text = trim_all(_column(value).cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("decimal(38,6)").try_cast("bigint"))


def normalise_code(value: Column | str) -> Column:
    """One spelling per postcode: upper case, one space before the last three; NULL unless 5 to 7 characters."""
    bare = F.regexp_replace(F.upper(_column(value)), "[^A-Z0-9]", "")
    return F.when(F.length(bare).between(5, 7), F.regexp_replace(bare, "^(.+)(.{3})$", "$1 $2"))


def period_start(value: Column | str) -> Column:
    """First year of ``2022-2023``, ``2018-19`` or ``202223``; the job fails on text without one."""
    text = _column(value).cast("string")
    found = F.regexp_extract(text, r"^(\d{4})", 1)
    return F.when(F.length(found) == 4, found.try_cast("int")).otherwise(
        F.raise_error(F.concat(F.lit("no period in: "), F.coalesce(text, F.lit("NULL")))).cast("int"))


def period_label(start: Column | str) -> Column:
    """``2022`` to ``2022-23``."""
    start = _column(start)
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def token_set(name: Column | str) -> Column:
    """Sorted distinct words of a name without the stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(_column(name), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_sort(F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS])))


def token_jaccard(left: Column | str, right: Column | str) -> Column:
    """Shared tokens over all tokens of two token sets; 0 when either is empty."""
    left, right = _column(left), _column(right)
    shared = F.size(F.array_intersect(left, right)).cast("double")
    total = F.size(left) + F.size(right) - shared
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(F.try_divide(shared, total))
