"""Conditional measures shared by the reports.

Money is summed as decimal (exact, independent of row order). Averages are
the decimal sum over the count, as double, so they too do not depend on the
order in which partitions finish.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three meanings of an occupied room.
EARNED = ("confirmed", "completed")
BLOCKING = ("pending", "confirmed")
ON_CALENDAR = ("pending", "confirmed", "completed")


def status_in(statuses: tuple[str, ...], name: str = "booking_status") -> Column:
    return F.col(name).isin(*statuses)


def earned() -> Column:
    return status_in(EARNED)


def tally(condition: Column) -> Column:
    """Rows that satisfy ``condition``; null over no rows at all."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0)))


def status_tallies(*statuses: str, suffix: str = "") -> list[Column]:
    return [tally(F.col("booking_status") == s).alias(s + suffix) for s in statuses]


def money_where(condition: Column, amount: str = "total_amount") -> Column:
    """Decimal sum of the amounts under ``condition``, others counted as 0."""
    return F.sum(F.when(condition, F.col(amount)).otherwise(F.lit(0).cast("decimal(10,2)")))


def mean(value: Column, condition: Column | None = None) -> Column:
    """Mean of the non-null values (under ``condition``), null over none."""
    picked = value if condition is None else F.when(condition, value)
    return ratio(F.sum(picked), F.count(picked))


def ratio(part: Column, whole: Column) -> Column:
    """Double quotient; null when ``whole`` is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * F.lit(100.0)


def earned_revenue() -> Column:
    return money_where(earned())


def earned_count() -> Column:
    return F.count(F.when(earned(), F.lit(1)))


def earned_mean() -> Column:
    return mean(F.col("total_amount"), earned())
