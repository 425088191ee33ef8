"""Reusable aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noisy_or(conf: Column | str, digits: int = 4) -> Column:
    """1 − ∏(1 − c) with every c clamped to [0, 1]; null counts as 0.

    The product is a sum of logs, so it combines map-side; c = 1 makes the result 1.
    """
    col = F.col(conf) if isinstance(conf, str) else conf
    c = F.least(F.greatest(F.coalesce(col, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    certain = F.max(F.when(c >= 1.0, 1).otherwise(0)) == 1
    logs = F.sum(F.when(c < 1.0, F.log1p(-c)).otherwise(0.0))
    return F.when(certain, F.lit(1.0)).otherwise(F.round(1.0 - F.exp(logs), digits))


def unanimous(col: Column | str) -> Column:
    """The one agreed value, else null."""
    return F.when(F.count_distinct(col) == 1, F.max(col))


def rate(num: Column, den: Column, digits: int = 4, empty: float | None = 0.0) -> Column:
    """Rounded ratio; an empty denominator gives ``empty`` (0 for plain rates, null by contract elsewhere)."""
    value = F.round(F.try_divide(num.cast("double"), den.cast("double")), digits)
    return value if empty is None else F.coalesce(value, F.lit(empty))


def share_where(cond: Column, digits: int = 4, empty: float | None = 0.0) -> Column:
    return rate(F.count_if(cond), F.count("*"), digits, empty)
