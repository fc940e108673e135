"""Time windows relative to an explicit ``as_of``.

No function here reads the wall clock: the caller passes ``as_of``, so a run
can be repeated. Bounds are computed once on the driver and reach the scan as
literals, which keeps them eligible for parquet pushdown.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("week", "month", "year")


def timestamp(value: dt.datetime) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def day(value: dt.date) -> Column:
    return F.lit(value.isoformat()).cast("date")


def months_back(value: dt.datetime, months: int) -> dt.datetime:
    """Calendar months earlier, clamped to the last day of a short month."""
    index = value.year * 12 + value.month - 1 - months
    year, month = divmod(index, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return value.replace(year=year, month=month + 1, day=min(value.day, last))


def period_start(as_of: dt.datetime, period: str) -> dt.datetime:
    """Start of the trailing week, month or year; other names mean month."""
    if period == "week":
        return as_of - dt.timedelta(days=7)
    return months_back(as_of, 12 if period == "year" else 1)


def first_whole_day(moment: dt.datetime) -> dt.date:
    """Earliest date whose midnight is not before ``moment``."""
    at_midnight = moment.time() == dt.time(0)
    return moment.date() if at_midnight else moment.date() + dt.timedelta(days=1)


def _midnight(value: dt.date) -> dt.datetime:
    return dt.datetime.combine(value, dt.time(0))


def in_report_window(
    name: str,
    as_of: dt.datetime,
    period: str = "month",
    start: dt.date | None = None,
    end: dt.date | None = None,
    is_date: bool = False,
) -> Column:
    """Report predicate: ``[start, end]`` when both are given, else trailing.

    On a timestamp column ``end`` means midnight at its start, so later times
    of that day fall outside; on a date column the whole end day is inside.
    """
    column = F.col(name)
    if start and end:
        if is_date:
            return column.between(day(start), day(end))
        return column.between(timestamp(_midnight(start)), timestamp(_midnight(end)))
    since = period_start(as_of, period)
    if is_date:
        return column >= day(first_whole_day(since))
    return column >= timestamp(since)


def in_stats_period(name: str, as_of: dt.datetime, period: str | None) -> Column:
    """Statistics predicate: trailing period, or everything for other names."""
    if period not in PERIODS:
        return F.lit(True)
    return F.col(name) >= timestamp(period_start(as_of, period))


def groups_by_month(period: str, start: dt.date | None, end: dt.date | None) -> bool:
    """Only a trailing year is reported by month."""
    return period == "year" and not (start and end)


def month_label(column: Column) -> Column:
    return F.date_format(column, "yyyy-MM")


def same_day(name: str, as_of: dt.datetime) -> Column:
    low = _midnight(as_of.date())
    return (F.col(name) >= timestamp(low)) & (
        F.col(name) < timestamp(low + dt.timedelta(days=1))
    )


def same_month(name: str, as_of: dt.datetime) -> Column:
    low = _midnight(as_of.date().replace(day=1))
    return (F.col(name) >= timestamp(low)) & (F.col(name) < timestamp(months_back(low, -1)))
