"""Booking lookup, pages, statistics, conflicts and price quotes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions.clock import (
    day,
    groups_by_month,
    in_report_window,
    in_stats_period,
    month_label,
    timestamp,
)
from roomledger.functions.measures import (
    BLOCKING,
    EARNED,
    earned_mean,
    earned_revenue,
    money_where,
    status_in,
)
from roomledger.functions.stays import CHECK_IN, CHECK_OUT, in_house, nights, overlaps
from roomledger.operators.rooms import with_category
from roomledger.plans.dominance import count_before_and_beyond
from roomledger.plans.keyed import key_set, renamed
from roomledger.plans.paging import bounded, fetch, older_than, page_at, page_count, page_of
from roomledger.sources.tables import Tables

TAX_RATE = "0.10"


def _guests(t: Tables, *extra: str) -> DataFrame:
    wanted = {name: name for name in ("first_name", "last_name", "email", *extra)}
    return renamed(t.customers, customer_id="id", **wanted)


def _rooms(t: Tables, *extra: str) -> DataFrame:
    wanted = {name: name for name in ("room_name", "room_number", *extra)}
    return renamed(t.rooms, room_id="id", **wanted)


def _rooms_by_category(t: Tables, *extra: str) -> DataFrame:
    return renamed(
        with_category(t.rooms, t.room_categories),
        room_id="id",
        category_name="category_name",
        **{name: name for name in ("room_name", "room_number", *extra)},
    )


def with_guest_and_room(bookings: DataFrame, t: Tables, rows: int | None = None) -> DataFrame:
    """Bookings that have both a guest and a room, with their names.

    At most ``rows`` bookings are known to be few and are broadcast to both tables.
    """
    few = (lambda df: df) if rows is None else (lambda df: bounded(df, rows))
    return few(bookings.join(_guests(t), "customer_id")).join(_rooms(t), "room_id")


def booking_lookup(t: Tables, reference: str | None = None) -> DataFrame:
    """A booking by reference (or all), with nights and whether it may be cancelled."""
    bookings = t.bookings
    if reference is not None:
        bookings = bookings.where(F.col("booking_reference") == reference)
    return (
        bookings.join(_guests(t, "phone"), "customer_id")
        .join(
            _rooms_by_category(t, "price_per_night", "description", "cancellation_policy"),
            "room_id",
        )
        .withColumn("nights", nights())
        .withColumn("can_cancel", status_in(BLOCKING))
    )


def _filters(
    status: str | None,
    room_id: int | None,
    date_from: dt.date | None,
    date_to: dt.date | None,
) -> list[Column]:
    chosen = []
    if status:
        chosen.append(F.col("booking_status") == status)
    if room_id:
        chosen.append(F.col("room_id") == room_id)
    if date_from:
        chosen.append(F.col(CHECK_IN) >= day(date_from))
    if date_to:
        chosen.append(F.col(CHECK_IN) <= day(date_to))
    return chosen


def _known(bookings: DataFrame, t: Tables, trusted: bool = False) -> DataFrame:
    """Bookings whose guest and room exist, without reading either one's columns.

    With ``trusted`` references (``orphan_rows`` found none) a set reference
    exists, and two shuffles of the booking table become two null checks.
    """
    if trusted:
        return bookings.where("customer_id IS NOT NULL AND room_id IS NOT NULL")
    return bookings.join(
        t.customers.select(F.col("id").alias("customer_id")), "customer_id", "left_semi"
    ).join(t.rooms.select(F.col("id").alias("room_id")), "room_id", "left_semi")


def _newest_page(
    t: Tables,
    filters: list[Column],
    page: int,
    limit: int,
    trusted: bool,
    after: tuple | None = None,
) -> DataFrame:
    """The wide rows of one page, newest first; at most ``limit`` rows."""
    bookings = t.bookings.where(older_than(after))
    for condition in filters:
        bookings = bookings.where(condition)
    keys = _known(bookings.select("id", "created_at", "customer_id", "room_id"), t, trusted)
    newest = page_at(keys, "created_at", [F.desc("created_at"), F.desc("id")], page, limit)
    return bounded(fetch(bookings, newest, "id", limit), limit)


def bookings_page(
    t: Tables,
    status: str | None = None,
    room_id: int | None = None,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    page: int = 1,
    limit: int = 50,
    trusted: bool = False,
    after: tuple[dt.datetime, int] | None = None,
) -> DataFrame:
    """One page of the filtered bookings, newest first.

    The dates bound the check-in day, both ends included. ``after`` is the
    creation time and id of the last row shown: pages are then counted from
    there, and the next one is page 1.
    """
    chosen = _filters(status, room_id, date_from, date_to)
    rows = _newest_page(t, chosen, page, limit, trusted, after)
    named = bounded(rows.join(_guests(t, "phone"), "customer_id"), limit)
    placed = named.join(_rooms(t, "room_category_id"), "room_id")
    categories = renamed(t.room_categories, room_category_id="id", category_name="name")
    return (
        placed.join(categories, "room_category_id", "left")
        .drop("room_category_id")
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def bookings_page_count(
    t: Tables,
    status: str | None = None,
    room_id: int | None = None,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    limit: int = 50,
    trusted: bool = False,
) -> DataFrame:
    """Number of filtered bookings and of pages they fill."""
    bookings = t.bookings
    for condition in _filters(status, room_id, date_from, date_to):
        bookings = bookings.where(condition)
    total = _known(bookings.select("customer_id", "room_id"), t, trusted).agg(
        F.count(F.lit(1)).alias("total")
    )
    return total.select("total", page_count(F.col("total"), limit).alias("pages"))


def status_breakdown(t: Tables, as_of: dt.datetime, period: str = "month") -> DataFrame:
    chosen = t.bookings.where(in_stats_period("created_at", as_of, period))
    return chosen.groupBy("booking_status").agg(F.count(F.lit(1)).alias("count"))


def booking_revenue_stats(t: Tables, as_of: dt.datetime, period: str = "month") -> DataFrame:
    chosen = t.bookings.where(in_stats_period("created_at", as_of, period))
    status = F.col("booking_status")
    return chosen.agg(
        F.count(F.lit(1)).alias("total_bookings"),
        money_where(status == "confirmed").alias("confirmed_revenue"),
        money_where(status == "completed").alias("completed_revenue"),
        earned_mean().alias("avg_booking_value"),
    )


def active_room_count(t: Tables) -> Column:
    """Number of active rooms as a scalar subquery: no join, no driver trip."""
    return t.rooms.where("is_active").agg(F.count(F.lit(1))).scalar()


def current_occupancy(t: Tables, today: dt.date) -> DataFrame:
    """Rooms in house today against active rooms; the rate is 0 without rooms.

    The numerator counts inactive rooms too, so the rate may pass 100.
    """
    occupied = t.bookings.where(status_in(EARNED) & in_house(today)).agg(
        F.count_distinct("room_id").alias("occupied_rooms")
    )
    return occupancy_of(occupied, t)


def occupancy_of(occupied: DataFrame, t: Tables) -> DataFrame:
    """``occupied_rooms`` against the active rooms."""
    counted = occupied.withColumn("total_rooms", active_room_count(t))
    share = F.try_divide(
        (F.col("occupied_rooms") * 100).cast("decimal(20,0)"),
        F.col("total_rooms").cast("decimal(20,0)"),
    )
    rate = F.coalesce(F.round(share, 2), F.lit(0)).cast("decimal(20,2)")
    return counted.withColumn("occupancy_rate", rate)


def recent_bookings(t: Tables, n: int = 10, trusted: bool = False) -> DataFrame:
    newest = with_guest_and_room(_newest_page(t, [], 1, n, trusted), t, n)
    return newest.orderBy(F.desc("created_at"), F.desc("id"))


def _within_days(name: str, today: dt.date, days: int) -> Column:
    return F.col(name).between(day(today), day(today + dt.timedelta(days=days)))


def upcoming_check_ins(t: Tables, today: dt.date, days: int = 7) -> DataFrame:
    due = t.bookings.where(
        (F.col("booking_status") == "confirmed") & _within_days(CHECK_IN, today, days)
    )
    return with_guest_and_room(due, t).orderBy(F.asc(CHECK_IN), F.asc("id"))


def upcoming_check_outs(t: Tables, today: dt.date, days: int = 7) -> DataFrame:
    due = t.bookings.where(status_in(EARNED) & _within_days(CHECK_OUT, today, days))
    return with_guest_and_room(due, t).orderBy(F.asc(CHECK_OUT), F.asc("id"))


def stale_pending(t: Tables, as_of: dt.datetime) -> DataFrame:
    """Pending bookings at least one day old."""
    old = t.bookings.where(
        (F.col("booking_status") == "pending")
        & (F.col("created_at") <= timestamp(as_of - dt.timedelta(days=1)))
    )
    return with_guest_and_room(old, t)


def booking_trends(
    t: Tables, as_of: dt.datetime, period: str = "month", measure: str = "bookings"
) -> DataFrame:
    """Bookings or revenue per day, per month for a year; the label is text."""
    created = F.col("created_at")
    label = (
        month_label(created)
        if groups_by_month(period, None, None)
        else F.date_format(created, "yyyy-MM-dd")
    )
    value = earned_revenue() if measure == "revenue" else F.count(F.lit(1))
    chosen = t.bookings.where(in_report_window("created_at", as_of, period))
    return chosen.groupBy(label.alias("date")).agg(value.alias("value")).orderBy("date")


def conflicts_with(
    t: Tables, room_id: int, check_in: dt.date, check_out: dt.date
) -> DataFrame:
    """Pending and confirmed bookings of a room that collide with one stay."""
    return t.bookings.where(
        (F.col("room_id") == room_id) & status_in(BLOCKING) & overlaps(check_in, check_out)
    )


def booking_conflicts(t: Tables) -> DataFrame:
    """Open bookings of a room that collide with other open bookings of it.

    Gives each booking the number of bookings it collides with, without ever
    pairing them. For a stay ``[in, out)`` the colliding ones are those that
    begin before ``out`` less those that end by ``in``. Begins and ends are
    first counted per room and day, so a room with any number of bookings
    reaches the running sums as one row per calendar day.

    A stay that ends before it begins collides with those that hold it, which
    are counted over both days at once.
    """
    every = t.bookings.where(
        status_in(BLOCKING)
        & F.col("room_id").isNotNull()
        & F.col(CHECK_IN).isNotNull()
        & F.col(CHECK_OUT).isNotNull()
    ).select("id", "room_id", CHECK_IN, CHECK_OUT)
    stays = every.where(F.col(CHECK_IN) <= F.col(CHECK_OUT))
    one, none = F.lit(1), F.lit(0)
    empty = F.col(CHECK_IN) == F.col(CHECK_OUT)
    marks = stays.select(
        "room_id",
        F.explode(
            F.array(
                F.struct(
                    F.col(CHECK_IN).alias("day"),
                    one.alias("begins"),
                    none.alias("ends"),
                    F.when(empty, one).otherwise(none).alias("empties"),
                ),
                F.struct(
                    F.col(CHECK_OUT).alias("day"),
                    none.alias("begins"),
                    one.alias("ends"),
                    none.alias("empties"),
                ),
            )
        ).alias("mark"),
    ).select("room_id", "mark.*")
    daily = marks.groupBy("room_id", "day").agg(
        F.sum("begins").alias("begins"),
        F.sum("ends").alias("ends"),
        F.sum("empties").alias("empties"),
    )
    upto = Window.partitionBy("room_id").orderBy("day")
    running = daily.select(
        "room_id",
        "day",
        (F.sum("begins").over(upto) - F.col("begins")).alias("begun_before"),
        F.sum("ends").over(upto).alias("ended_by"),
        "empties",
    )
    at_out = renamed(running, room_id="room_id", check_out_date="day", begun="begun_before")
    at_in = renamed(
        running, room_id="room_id", check_in_date="day", ended="ended_by", empties="empties"
    )
    placed = stays.join(at_out, ["room_id", CHECK_OUT]).join(at_in, ["room_id", CHECK_IN])
    # A stay of no night begins nothing before its own end, but every such
    # stay on that day is among those ended by it: add them back. A stay
    # with nights has counted itself once.
    others = F.when(
        empty, F.col("begun") - F.col("ended") + F.col("empties")
    ).otherwise(F.col("begun") - F.col("ended") - 1)
    plain = placed.select("id", "room_id", CHECK_IN, CHECK_OUT, others.cast("bigint").alias("_plain"))
    inverted = every.where(F.col(CHECK_IN) > F.col(CHECK_OUT)).withColumn(
        "_plain", F.lit(0).cast("bigint")
    )
    stay = ["room_id", CHECK_IN, CHECK_OUT]
    return (
        plain.unionByName(inverted)
        .join(_held_inverted(every), stay, "left")
        .withColumn("conflict_count", F.col("_plain") + F.coalesce("_more", F.lit(0)))
        .where("conflict_count > 0")
        .select("id", *stay, "conflict_count")
    )


def _held_inverted(stays: DataFrame) -> DataFrame:
    """Collisions of each distinct stay that involve a stay of negative length.

    A stay that ends on ``o`` before it begins on ``i`` collides with those that begin
    before ``o`` and end after ``i``. Both sides are counted over the calendar days of
    their room.
    """
    folded = stays.groupBy("room_id", CHECK_IN, CHECK_OUT).agg(F.count(F.lit(1)).alias("n"))
    back = folded.where(F.col(CHECK_IN) > F.col(CHECK_OUT))
    proper = folded.where(F.col(CHECK_IN) < F.col(CHECK_OUT)).join(
        key_set(back, "room_id"), "room_id", "left_semi"
    )
    named = {"room_id": "room_id", "n": "n"}
    holding = count_before_and_beyond(
        renamed(back, **named, x=CHECK_IN, y=CHECK_OUT),
        renamed(proper, room_id="room_id", x=CHECK_OUT, y=CHECK_IN),
        "room_id", "_more",
    )
    held = count_before_and_beyond(
        renamed(proper, **named, x=CHECK_IN, y=CHECK_OUT),
        renamed(back, room_id="room_id", x=CHECK_OUT, y=CHECK_IN),
        "room_id", "_more",
    )
    return holding.unionByName(held).select(
        "room_id", F.col("y").alias(CHECK_IN), F.col("x").alias(CHECK_OUT), "_more"
    )


def quoted(df: DataFrame, tax_rate: str = TAX_RATE) -> DataFrame:
    """Adds nights, subtotal, tax and total to stays with a room rate."""
    length = nights()
    subtotal = F.col("price_per_night") * length.cast("decimal(10,0)")
    tax = subtotal * F.lit(tax_rate).cast("decimal(5,4)")
    return (
        df.withColumn("nights", length)
        .withColumn("subtotal", subtotal.cast("decimal(20,2)"))
        .withColumn("tax_amount", F.round(tax, 2).cast("decimal(20,2)"))
        .withColumn("quote_total", F.round(subtotal + tax, 2).cast("decimal(20,2)"))
    )


def price_quotes(t: Tables, tax_rate: str = TAX_RATE) -> DataFrame:
    """What each booking would cost at the present room rate."""
    rates = renamed(t.rooms, room_id="id", price_per_night="price_per_night")
    stays = t.bookings.select("id", "room_id", CHECK_IN, CHECK_OUT).join(rates, "room_id")
    return quoted(stays, tax_rate)
