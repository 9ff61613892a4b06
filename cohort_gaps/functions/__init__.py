"""Column helpers built from native Spark expressions."""
from .measures import half_even, not_nan, percent, rank_key, weighted_mean
from .text import (clean_number, normalise_code, numeric_id, period_label, period_start, token_jaccard, token_set,
                   trim_all)

__all__ = ["clean_number", "half_even", "normalise_code", "not_nan", "numeric_id", "percent", "period_label",
           "period_start", "rank_key", "token_jaccard", "token_set", "trim_all", "weighted_mean"]
