"""Dashboards and revenue reports from totals per day that grow with the bookings.

A day's totals per source and status are sums, so an increment is a few signed rows: what
the touched bookings add now, less what they added before. Increments are appended in any
order, a reader sums them up, and ``compact_days`` folds them now and then. A report reads
one row per day, source, status and increment; only the days that a window cuts are read
from the bookings, by a range that reaches the scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.functions.clock import day, month_label, months_back, period_start, timestamp
from roomledger.functions.measures import EARNED, ratio
from roomledger.operators.changes import apply_status_changes, latest_changes
from roomledger.operators.reports import ReportWindow
from roomledger.sources.tables import Tables

KEYS = ("day", "source", "booking_status")
_SUMS = ("n", "amount", "priced")
_MONEY = "decimal(20,2)"


def booking_days(bookings: DataFrame) -> DataFrame:
    """``(day, source, booking_status, n, amount, priced)`` of bookings; ``priced`` counts those
    that have an amount."""
    return bookings.groupBy(F.to_date("created_at").alias("day"), "source", "booking_status").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("total_amount"), F.lit(0)).cast(_MONEY).alias("amount"),
        F.count("total_amount").alias("priced"),
    )


def day_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """The increment of bookings that were ``before`` and are ``after``; new ones have no before."""
    was = booking_days(before)
    gone = was.select(*KEYS, *[(-F.col(c)).cast(was.schema[c].dataType).alias(c) for c in _SUMS])
    return summed(gone.unionByName(booking_days(after)))


def status_day_changes(bookings: DataFrame, changes: DataFrame) -> DataFrame:
    """The increment of a change feed, given the bookings before it; late changes move a
    booking's day, however long ago it was."""
    touched = bookings.join(
        latest_changes(changes).select(F.col("booking_id").alias("id")), "id", "left_semi"
    ).select(*bookings.columns)
    return day_changes(touched, apply_status_changes(touched, changes))


def summed(days: DataFrame) -> DataFrame:
    """One row per day, source and status that has bookings."""
    sums = [F.sum(c).cast(days.schema[c].dataType).alias(c) for c in _SUMS]
    changed = (F.col("n") != 0) | (F.col("amount") != 0) | (F.col("priced") != 0)
    return days.groupBy(*KEYS).agg(*sums).where(changed)


def compact_days(days: DataFrame, path: str) -> None:
    """Writes the sums of all increments, in the order of the days, as a new table."""
    summed(days).repartitionByRange("day").sortWithinPartitions("day").write.parquet(path)


def _tally(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(F.lit(0)))


def _earned() -> Column:
    return F.col("booking_status").isin(*EARNED)


def _money(condition: Column) -> Column:
    """Sum of the amounts; null, as over bookings, where all that count have none."""
    known = F.when(F.col("priced") != 0, F.col("amount"))
    return F.sum(F.when(condition, known).otherwise(F.lit(0))).cast(_MONEY)


def _mean_earned() -> Column:
    priced = F.sum(F.when(_earned(), F.col("priced")))
    return ratio(F.sum(F.when(_earned(), F.col("amount"))), priced)


def _month(as_of: dt.datetime) -> Column:
    first = as_of.date().replace(day=1)
    following = months_back(dt.datetime.combine(first, dt.time()), -1).date()
    return (F.col("day") >= day(first)) & (F.col("day") < day(following))


def dashboard_bookings(days: DataFrame, as_of: dt.datetime) -> DataFrame:
    """As the dashboard of the same name."""
    status = F.col("booking_status")
    return summed(days).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_bookings"),
        *[_tally(status == s).alias(f"{s}_bookings") for s in ("pending", "confirmed", "cancelled", "completed")],
        _tally(F.col("day") == day(as_of.date())).alias("today_bookings"),
        _tally(_month(as_of)).alias("month_bookings"),
    )


def dashboard_revenue(days: DataFrame, as_of: dt.datetime) -> DataFrame:
    """As the dashboard of the same name."""
    return summed(days).agg(
        _money(_earned()).alias("total_revenue"),
        _money(_earned() & (F.col("day") == day(as_of.date()))).alias("today_revenue"),
        _money(_earned() & _month(as_of)).alias("month_revenue"),
        _mean_earned().alias("avg_booking_value"),
    )


def _within(t: Tables, days: DataFrame, window: ReportWindow) -> DataFrame:
    """Totals of a window: whole days from ``days``, the day it cuts from the bookings."""
    at = F.col("created_at")
    if window.start and window.end:
        # the end is the one moment that begins its day
        whole = (F.col("day") >= day(window.start)) & (F.col("day") < day(window.end))
        edge = at == timestamp(dt.datetime.combine(window.end, dt.time()))
        if window.start > window.end:
            edge = F.lit(False)
    else:
        since = period_start(window.as_of, window.period)
        following = since.date() + dt.timedelta(days=1)
        whole = F.col("day") >= day(following)
        edge = (at >= timestamp(since)) & (at < timestamp(dt.datetime.combine(following, dt.time())))
    return summed(days.where(whole)).unionByName(booking_days(t.bookings.where(edge)))


def _money_columns() -> list[Column]:
    return [
        _money(_earned()).alias("revenue"),
        F.coalesce(_tally(_earned()), F.lit(0)).alias("bookings"),
        _mean_earned().alias("avg_value"),
    ]


def revenue_overall(t: Tables, days: DataFrame, window: ReportWindow) -> DataFrame:
    """As the report of the same name."""
    return _within(t, days, window).agg(
        _money(_earned()).alias("total_revenue"),
        F.coalesce(_tally(_earned()), F.lit(0)).alias("successful_bookings"),
        _mean_earned().alias("avg_booking_value"),
        _tally(F.col("booking_status") == "cancelled").alias("cancelled_bookings"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_bookings"),
    )


def revenue_by_date(t: Tables, days: DataFrame, window: ReportWindow) -> DataFrame:
    """As the report of the same name."""
    label = month_label(F.col("day")) if window.by_month() else F.col("day")
    return _within(t, days, window).groupBy(label.alias("date")).agg(*_money_columns()).orderBy("date")


def revenue_by_source(t: Tables, days: DataFrame, window: ReportWindow) -> DataFrame:
    """As the report of the same name."""
    grouped = _within(t, days, window).groupBy("source").agg(*_money_columns())
    return grouped.orderBy(F.desc("revenue"), F.asc("source"))


def customer_days(customers: DataFrame) -> DataFrame:
    """``(day, n)``: guests per day of their first sight."""
    return customers.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def dashboard_customers(days: DataFrame, as_of: dt.datetime) -> DataFrame:
    """As the dashboard of the same name; ``days`` are appended ``customer_days``."""
    return days.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_customers"),
        _tally(F.col("day") == day(as_of.date())).alias("new_customers_today"),
        _tally(_month(as_of)).alias("new_customers_month"),
    )
