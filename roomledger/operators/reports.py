"""Revenue, occupancy, booking and customer reports.

Every report takes the same window: ``[start, end]`` when both are given,
else the trailing ``period`` before ``as_of``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.functions.clock import (
    groups_by_month,
    in_report_window,
    month_label,
    period_start,
    timestamp,
)
from roomledger.functions.measures import (
    earned,
    earned_count,
    earned_mean,
    earned_revenue,
    mean,
    percent,
    ratio,
    status_tallies,
    tally,
)
from roomledger.functions.stays import nights
from roomledger.operators.bookings import active_room_count
from roomledger.operators.rooms import with_category
from roomledger.plans.keyed import key_set, renamed
from roomledger.plans.paging import bounded, page_of
from roomledger.sources.tables import Tables


class ReportWindow:
    """The report window, applied to whichever column a report is about."""

    def __init__(
        self,
        as_of: dt.datetime,
        period: str = "month",
        start: dt.date | None = None,
        end: dt.date | None = None,
    ):
        self.as_of, self.period, self.start, self.end = as_of, period, start, end

    def created(self) -> Column:
        return in_report_window("created_at", self.as_of, self.period, self.start, self.end)

    def arriving(self) -> Column:
        return in_report_window(
            "check_in_date", self.as_of, self.period, self.start, self.end, is_date=True
        )

    def by_month(self) -> bool:
        return groups_by_month(self.period, self.start, self.end)


def _money_columns() -> list[Column]:
    return [
        earned_revenue().alias("revenue"),
        earned_count().alias("bookings"),
        earned_mean().alias("avg_value"),
    ]


# Revenue ------------------------------------------------------------------


def revenue_overall(t: Tables, window: ReportWindow) -> DataFrame:
    return t.bookings.where(window.created()).agg(
        earned_revenue().alias("total_revenue"),
        earned_count().alias("successful_bookings"),
        earned_mean().alias("avg_booking_value"),
        tally(F.col("booking_status") == "cancelled").alias("cancelled_bookings"),
        F.count(F.lit(1)).alias("total_bookings"),
    )


def revenue_by_date(t: Tables, window: ReportWindow) -> DataFrame:
    """By day; by month over a trailing year."""
    created = F.col("created_at")
    label = month_label(created) if window.by_month() else F.to_date(created)
    chosen = t.bookings.where(window.created())
    return chosen.groupBy(label.alias("date")).agg(*_money_columns()).orderBy("date")


def revenue_by_category(t: Tables, window: ReportWindow) -> DataFrame:
    """By category; rooms without a category are left out.

    Bookings are folded to one row per room before the room join, so neither
    a busy room nor the width of a booking reaches the shuffle.
    """
    per_room = (
        t.bookings.where(window.created() & F.col("room_id").isNotNull())
        .groupBy("room_id")
        .agg(earned_revenue().alias("revenue"), earned_count().alias("bookings"))
    )
    rooms = renamed(t.rooms, room_id="id", category_id="room_category_id")
    names = renamed(t.room_categories, category_id="id", category_name="name")
    return (
        per_room.join(rooms, "room_id")
        .join(names, "category_id")
        .groupBy("category_id", "category_name")
        .agg(F.sum("revenue").alias("revenue"), F.sum("bookings").alias("bookings"))
        .select(
            "category_name",
            "revenue",
            "bookings",
            ratio(F.col("revenue"), F.col("bookings")).alias("avg_value"),
        )
        .orderBy(F.desc("revenue"), F.asc("category_name"))
    )


def revenue_by_source(t: Tables, window: ReportWindow) -> DataFrame:
    chosen = t.bookings.where(window.created())
    grouped = chosen.groupBy("source").agg(*_money_columns())
    return grouped.orderBy(F.desc("revenue"), F.asc("source"))


def revenue_report(t: Tables, window: ReportWindow) -> DataFrame:
    """All four revenue sections from one scan of the bookings.

    Grouping sets give the totals per day, room and source together; rooms
    then fold into categories. ``section`` is overall, date, category or
    source, ``label`` its key as text.
    """
    created = F.col("created_at")
    day = month_label(created) if window.by_month() else F.to_date(created).cast("string")
    chosen = t.bookings.where(window.created()).select(
        day.alias("day"), "room_id", "source", "booking_status", "total_amount"
    )
    keys = [F.col("day"), F.col("room_id"), F.col("source")]
    totals = chosen.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(
        F.grouping_id().alias("absent"),
        earned_revenue().alias("revenue"),
        earned_count().alias("bookings"),
        tally(F.col("booking_status") == "cancelled").alias("cancelled"),
        F.count(F.lit(1)).alias("total"),
    )
    rooms = renamed(t.rooms, room_id="id", category_id="room_category_id")
    names = renamed(t.room_categories, category_id="id", category_name="name")
    # Bits of the absent keys: day 4, room 2, source 1.
    by_day, by_room, by_source, overall = 3, 5, 6, 7
    placed = totals.join(rooms, "room_id", "left").join(names, "category_id", "left")
    section = (
        F.when(F.col("absent") == overall, "overall")
        .when(F.col("absent") == by_day, "date")
        .when(F.col("absent") == by_room, "category")
        .when(F.col("absent") == by_source, "source")
    )
    label = F.coalesce(
        F.when(F.col("absent") == by_room, F.col("category_name")), F.col("day"), F.col("source")
    )
    return (
        placed.where((F.col("absent") != by_room) | F.col("category_name").isNotNull())
        .groupBy(
            section.alias("section"),
            # Categories may share a name; they are told apart by id.
            F.when(F.col("absent") == by_room, F.col("category_id")).alias("_category"),
            label.alias("label"),
        )
        .agg(*[F.sum(n).alias(n) for n in ("revenue", "bookings", "cancelled", "total")])
        .withColumn("avg_value", ratio(F.col("revenue"), F.col("bookings")))
        .drop("_category")
    )


# Occupancy ----------------------------------------------------------------


def occupancy_total_rooms(t: Tables) -> DataFrame:
    return t.rooms.where("is_active").agg(F.count(F.lit(1)).alias("total_rooms"))


def _arrivals(t: Tables, window: ReportWindow) -> DataFrame:
    """Distinct rooms that take an arrival, per arrival day."""
    return (
        t.bookings.where(earned() & window.arriving())
        .groupBy(F.col("check_in_date").alias("date"))
        .agg(F.count_distinct("room_id").alias("occupied_rooms"))
    )


def occupancy_average(t: Tables, window: ReportWindow) -> DataFrame:
    """Mean daily share of rooms with an arrival; days without one do not count."""
    days = _arrivals(t, window).agg(
        F.sum("occupied_rooms").alias("rooms"), F.count(F.lit(1)).alias("days")
    )
    rate = percent(F.col("rooms"), F.col("days") * active_room_count(t))
    return days.select(F.coalesce(rate, F.lit(0.0)).alias("avg_occupancy_rate"))


def occupancy_by_date(t: Tables, window: ReportWindow) -> DataFrame:
    return (
        _arrivals(t, window)
        .withColumn(
            "occupancy_rate", percent(F.col("occupied_rooms"), active_room_count(t))
        )
        .orderBy("date")
    )


def occupancy_by_category(t: Tables, window: ReportWindow) -> DataFrame:
    """Active rooms per category and those with an earned stay in the window.

    Each booked room becomes one key first, so plain counts replace two
    distinct counts over the joined bookings.
    """
    booked = key_set(t.bookings.where(earned() & window.arriving()), "room_id", "_booked")
    return category_occupancy(t, booked)


def category_occupancy(t: Tables, booked: DataFrame) -> DataFrame:
    """Active rooms per category and those among the distinct ``booked._booked``."""
    rooms = with_category(t.rooms.where("is_active"), t.room_categories)
    return (
        rooms.join(booked, F.col("id") == F.col("_booked"), "left")
        .groupBy(
            F.when(F.col("category_name").isNotNull(), F.col("room_category_id")).alias("_category"),
            "category_name",
        )
        .agg(
            F.count(F.lit(1)).alias("category_rooms"), F.count("_booked").alias("occupied_rooms")
        )
        .select(
            "category_name",
            "category_rooms",
            "occupied_rooms",
            percent(F.col("occupied_rooms"), F.col("category_rooms")).alias("occupancy_rate"),
        )
        .orderBy(F.desc("occupancy_rate"), F.asc("category_name"))
    )


def length_of_stay(t: Tables, window: ReportWindow) -> DataFrame:
    # The labels of the stay lengths.
    stay = (
        F.when(nights() == 1, "1 night")
        .when(nights().between(2, 3), "2-3 nights")
        .when(nights().between(4, 7), "4-7 nights")
        .when(nights() > 7, "7+ nights")
        .otherwise("Other")
    )
    chosen = t.bookings.where(earned() & window.arriving())
    return (
        chosen.groupBy(stay.alias("stay_length"))
        .agg(F.count(F.lit(1)).alias("bookings"), mean(F.col("total_amount")).alias("avg_revenue"))
        .orderBy(F.desc("bookings"), F.asc("stay_length"))
    )


# Bookings -----------------------------------------------------------------


def _booked(
    t: Tables, window: ReportWindow, status: str | None = None, source: str | None = None
) -> DataFrame:
    chosen = t.bookings.where(window.created())
    if status:
        chosen = chosen.where(F.col("booking_status") == status)
    if source:
        chosen = chosen.where(F.col("source") == source)
    return chosen


def booking_summary(
    t: Tables, window: ReportWindow, status: str | None = None, source: str | None = None
) -> DataFrame:
    """Counts per status, mean stay and mean party.

    A booking with an unknown number of children has no party size.
    """
    return _booked(t, window, status, source).agg(
        F.count(F.lit(1)).alias("total_bookings"),
        *status_tallies("pending", "confirmed", "cancelled", "completed", "no_show"),
        mean(nights()).alias("avg_length_of_stay"),
        mean(F.col("adults") + F.col("children")).alias("avg_guests"),
    )


def bookings_by_date(
    t: Tables, window: ReportWindow, status: str | None = None, source: str | None = None
) -> DataFrame:
    chosen = _booked(t, window, status, source)
    return (
        chosen.groupBy(F.to_date("created_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_bookings"),
            *status_tallies("pending", "confirmed", "cancelled", "completed"),
        )
        .orderBy("date")
    )


def bookings_by_source(
    t: Tables, window: ReportWindow, status: str | None = None, source: str | None = None
) -> DataFrame:
    chosen = _booked(t, window, status, source)
    return (
        chosen.groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("total_bookings"),
            tally(earned()).alias("successful_bookings"),
            tally(F.col("booking_status") == "cancelled").alias("cancelled_bookings"),
            earned_revenue().alias("total_revenue"),
        )
        .orderBy(F.desc("total_bookings"), F.asc("source"))
    )


def _timing(ahead: Column) -> Column:
    """How long before the arrival a booking was cancelled. The labels."""
    return (
        F.when(ahead >= 7, "7+ days before")
        .when(ahead.between(1, 6), "1-6 days before")
        .when(ahead == 0, "Same day")
        .otherwise("After check-in")
    )


def cancellation_timing(t: Tables, window: ReportWindow, source: str | None = None) -> DataFrame:
    """Cancelled bookings by days from the last change to the arrival."""
    ahead = F.date_diff(F.col("check_in_date"), F.to_date("updated_at"))
    # The labels of the cancellation lead times.
    timing = _timing(ahead)
    return (
        _booked(t, window, "cancelled", source)
        .groupBy(timing.alias("cancellation_timing"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("cancellation_timing"))
    )


def bookings_report(
    t: Tables, window: ReportWindow, status: str | None = None, source: str | None = None
) -> DataFrame:
    """Summary with means, daily, per-source and per-cancellation counts from one scan."""
    ahead = F.date_diff(F.col("check_in_date"), F.to_date("updated_at"))
    chosen = _booked(t, window, status, source).select(
        F.to_date("created_at").alias("day"),
        "source",
        F.when(F.col("booking_status") == "cancelled", _timing(ahead)).alias("timing"),
        "booking_status",
        "total_amount",
        nights().alias("_nights"),
        (F.col("adults") + F.col("children")).alias("_party"),
    )
    keys = [F.col("day"), F.col("source"), F.col("timing")]
    totals = chosen.groupingSets([[keys[0]], [keys[1]], [keys[2]], []], *keys).agg(
        F.grouping_id().alias("absent"),
        mean(F.col("_nights")).alias("avg_nights"),
        mean(F.col("_party")).alias("avg_party"),
        F.count(F.lit(1)).alias("total_bookings"),
        *status_tallies("pending", "confirmed", "cancelled", "completed", "no_show"),
        earned_revenue().alias("total_revenue"),
    )
    # Bits of the absent keys: day 4, source 2, timing 1.
    by_timing = F.col("absent") == 6
    section = (
        F.when(F.col("absent") == 3, "date")
        .when(F.col("absent") == 5, "source")
        .when(by_timing, "cancellation")
        .otherwise("summary")
    )
    label = F.coalesce(F.col("day").cast("string"), F.col("source"), F.col("timing"))
    return totals.where(~by_timing | F.col("timing").isNotNull()).select(
        section.alias("section"),
        label.alias("label"),
        "total_bookings",
        *("pending", "confirmed", "cancelled", "completed", "no_show"),
        "total_revenue",
        "avg_nights",
        "avg_party",
    )


# Customers ----------------------------------------------------------------


def booking_totals(t: Tables, spend: Column) -> DataFrame:
    """One row per guest with bookings: count, spend and last booking."""
    return (
        t.bookings.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("total_bookings"),
            spend.alias("total_spent"),
            F.max("created_at").alias("last_booking_date"),
        )
    )


def with_totals(customers: DataFrame, totals: DataFrame) -> DataFrame:
    """All given guests with their totals, null for those without bookings."""
    return customers.join(totals, F.col("id") == F.col("customer_id"), "left").drop("customer_id")


def spent_or_zero() -> Column:
    return F.coalesce("total_spent", F.lit(0).cast("decimal(20,2)"))


def customer_summary(t: Tables, window: ReportWindow) -> DataFrame:
    """Guest counts and means over the guests who have bookings."""
    guests = t.customers.where(window.created()).select("id", "created_at")
    month = timestamp(period_start(window.as_of, "month"))
    week = timestamp(period_start(window.as_of, "week"))
    return with_totals(guests, booking_totals(t, earned_revenue())).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count(F.when(F.col("created_at") >= month, 1)).alias("new_customers_month"),
        F.count(F.when(F.col("created_at") >= week, 1)).alias("new_customers_week"),
        mean(F.col("total_bookings")).alias("avg_bookings_per_customer"),
        mean(F.col("total_spent")).alias("avg_spent_per_customer"),
    )


def customers_by_country(t: Tables, window: ReportWindow, n: int = 10) -> DataFrame:
    guests = t.customers.where(window.created() & (F.col("country") != ""))
    return (
        with_totals(guests.select("id", "country"), booking_totals(t, earned_revenue()))
        .groupBy("country")
        .agg(
            F.count(F.lit(1)).alias("customer_count"), mean(F.col("total_spent")).alias("avg_spent")
        )
        .orderBy(F.desc("customer_count"), F.asc("country"))
        .limit(n)
    )


def top_customers(t: Tables, window: ReportWindow, n: int = 20) -> DataFrame:
    """The guests who spent most; wide guest columns are read for them only."""
    guests = t.customers.where(window.created())
    totals = with_totals(guests.select("id"), booking_totals(t, earned_revenue())).select(
        F.col("id").alias("_guest"),
        F.coalesce("total_bookings", F.lit(0)).alias("total_bookings"),
        spent_or_zero().alias("total_spent"),
        "last_booking_date",
    )
    best = bounded(page_of(totals, [F.desc("total_spent"), F.asc("_guest")], 1, n), n)
    return (
        t.customers.join(best, F.col("id") == F.col("_guest"))
        .select(
            "id",
            "first_name",
            "last_name",
            "email",
            "country",
            "total_bookings",
            "total_spent",
            "last_booking_date",
        )
        .orderBy(F.desc("total_spent"), F.asc("id"))
    )


def customer_acquisition(t: Tables, window: ReportWindow) -> DataFrame:
    return (
        t.customers.where(window.created())
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("new_customers"))
        .orderBy("date")
    )


def repeat_customers(t: Tables, window: ReportWindow) -> DataFrame:
    """Guests by number of bookings; those without any form the null group."""
    guests = t.customers.where(window.created()).select("id")
    joined = with_totals(guests, booking_totals(t, earned_revenue()))
    held = F.coalesce("total_bookings", F.lit(0))
    # The labels of the loyalty groups.
    group = (
        F.when(held == 1, "One-time")
        .when(held.between(2, 3), "2-3 bookings")
        .when(held.between(4, 10), "4-10 bookings")
        .when(held > 10, "10+ bookings")
    )
    return (
        joined.groupBy(group.alias("customer_type"))
        .agg(F.count(F.lit(1)).alias("customer_count"), mean(spent_or_zero()).alias("avg_spent"))
        .orderBy(F.desc("customer_count"), F.asc("customer_type"))
    )
