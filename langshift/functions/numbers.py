"""Column functions over numbers and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Non-negative doubles, rounded on their own value (Spark's ``round`` goes by the decimal form)."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def duration_days(first: Column, last: Column) -> Column:
    """Whole days between two times in seconds, at least one; one if either is zero."""
    days = F.floor((last - first) / F.lit(86400.0)).cast("bigint")
    return F.when((first == 0) | (last == 0), F.lit(1)).otherwise(F.greatest(days, F.lit(1))).cast("bigint")


def strong_from_stored(magnitude: Column, before: Column, after: Column, from_language: Column) -> Column:
    """Whether stored history columns speak of a strong transition."""
    return (
        (F.coalesce(magnitude, F.lit(0.0)) >= rules.MIN_MAGNITUDE)
        & (F.coalesce(after, F.lit(0.0)) >= rules.MIN_AFTER)
        & from_language.isNotNull()
        & (F.coalesce(before, F.lit(100.0)) <= rules.MAX_BEFORE)
    )
