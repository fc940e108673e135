"""Dashboard totals, alert rules and the activity feed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.functions.clock import same_day, same_month, timestamp
from roomledger.functions.measures import (
    earned,
    earned_mean,
    earned_revenue,
    money_where,
    status_tallies,
    tally,
)
from roomledger.operators.bookings import current_occupancy, stale_pending
from roomledger.operators.channels import failed_syncs
from roomledger.operators.rooms import rooms_without_images
from roomledger.plans.keyed import renamed
from roomledger.plans.paging import bounded, fetch, page_at
from roomledger.sources.tables import Tables

# Fixed value: occupancy below this many per cent raises an alert.
LOW_OCCUPANCY = 30


def dashboard_bookings(t: Tables, as_of: dt.datetime) -> DataFrame:
    return t.bookings.agg(
        F.count(F.lit(1)).alias("total_bookings"),
        *status_tallies("pending", "confirmed", "cancelled", "completed", suffix="_bookings"),
        tally(same_day("created_at", as_of)).alias("today_bookings"),
        tally(same_month("created_at", as_of)).alias("month_bookings"),
    )


def dashboard_revenue(t: Tables, as_of: dt.datetime) -> DataFrame:
    return t.bookings.agg(
        earned_revenue().alias("total_revenue"),
        money_where(earned() & same_day("created_at", as_of)).alias("today_revenue"),
        money_where(earned() & same_month("created_at", as_of)).alias("month_revenue"),
        earned_mean().alias("avg_booking_value"),
    )


def dashboard_rooms(t: Tables) -> DataFrame:
    return t.rooms.agg(
        F.count(F.lit(1)).alias("total_rooms"),
        tally(F.col("is_active")).alias("active_rooms"),
        tally(~F.col("is_active")).alias("inactive_rooms"),
    )


def dashboard_customers(t: Tables, as_of: dt.datetime) -> DataFrame:
    return t.customers.agg(
        F.count(F.lit(1)).alias("total_customers"),
        tally(same_day("created_at", as_of)).alias("new_customers_today"),
        tally(same_month("created_at", as_of)).alias("new_customers_month"),
    )


# What each alert asks for.
ALERT_ACTIONS = {
    "rooms": "Upload images for these rooms",
    "bookings": "Follow up on pending bookings",
    "occupancy": "Consider promotional campaigns",
    "ota": "Check OTA configurations and retry sync",
}


def alert_rows(
    t: Tables, category: str, as_of: dt.datetime, logs_as_of: dt.datetime | None = None
) -> DataFrame:
    """The rows an alert of ``system_alerts`` is about."""
    if category == "rooms":
        return rooms_without_images(t)
    if category == "bookings":
        return stale_pending(t, as_of)
    if category == "occupancy":
        return current_occupancy(t, as_of.date())
    if category == "ota":
        return failed_syncs(t, logs_as_of or as_of)
    raise ValueError(f"no alert is called {category}")


def system_alerts(t: Tables, as_of: dt.datetime, logs_as_of: dt.datetime | None = None) -> DataFrame:
    """One row per alert rule that fires: how many things are affected and what to do.

    The affected rows are those of ``alert_rows``. ``logs_as_of`` dates the channel rule when the logs run on another clock.
    """

    def alert(df: DataFrame, kind: str, category: str, message) -> DataFrame:
        return df.select(
            F.lit(kind).alias("type"),
            F.lit(category).alias("category"),
            message.alias("message"),
            F.col("affected").cast("bigint").alias("affected"),
            F.lit(ALERT_ACTIONS[category]).alias("action"),
        )

    def counted(df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("affected")).where("affected > 0")

    amount = F.col("affected").cast("string")
    occupancy = current_occupancy(t, as_of.date())
    share = F.coalesce(
        F.try_divide(
            (F.col("occupied_rooms") * 100).cast("decimal(20,0)"),
            F.col("total_rooms").cast("decimal(20,0)"),
        ),
        F.lit(0).cast("decimal(20,2)"),
    )
    low = occupancy.withColumn("share", share).where(F.col("share") < LOW_OCCUPANCY)
    low = low.withColumn("affected", F.col("occupied_rooms"))
    shown = F.round("share", 1).cast("decimal(20,1)").cast("string")
    # The texts of the alerts.
    alerts = [
        alert(
            counted(rooms_without_images(t)),
            "warning",
            "rooms",
            F.concat(amount, F.lit(" active rooms have no images")),
        ),
        alert(
            counted(stale_pending(t, as_of).select("id")),
            "warning",
            "bookings",
            F.concat(amount, F.lit(" pending bookings are over 24 hours old")),
        ),
        alert(
            low, "info", "occupancy", F.concat(F.lit("Current occupancy is "), shown, F.lit("%"))
        ),
        alert(
            counted(failed_syncs(t, logs_as_of or as_of)),
            "error",
            "ota",
            F.lit("OTA sync failures detected"),
        ),
    ]
    union = alerts[0]
    for one in alerts[1:]:
        union = union.unionByName(one)
    return union


def activity_log(
    t: Tables,
    as_of: dt.datetime,
    page: int = 1,
    limit: int = 50,
    after: tuple[dt.datetime, str, int] | None = None,
) -> DataFrame:
    """New bookings and rooms changed in the last week, newest first, paged.

    No booking carries the name of a user, so ``user_name`` is always null. ``after`` is the
    time, type and id of the last line shown: pages are then counted from there. The page is
    cut from keys alone; wide rows are fetched for its lines only.
    """
    booked = t.bookings.select("id", "created_at", "customer_id").join(
        t.customers.select(F.col("id").alias("customer_id")), "customer_id", "left_semi"
    )
    changed = t.rooms.where(F.col("updated_at") >= timestamp(as_of - dt.timedelta(days=7)))
    lines = booked.select(
        F.lit("booking").alias("type"), F.col("created_at").alias("timestamp"), "id"
    ).unionByName(
        changed.select(F.lit("room").alias("type"), F.col("updated_at").alias("timestamp"), "id")
    )
    if after is not None:
        moment, kind, last = F.lit(after[0]).cast("timestamp_ntz"), after[1], after[2]
        follows = (F.col("type") > kind) | ((F.col("type") == kind) & (F.col("id") < last))
        lines = lines.where((F.col("timestamp") < moment) | ((F.col("timestamp") == moment) & follows))
    order = [F.desc("timestamp"), F.asc("type"), F.desc("id")]
    shown = page_at(lines, "timestamp", order, page, limit)
    guests = renamed(
        t.customers, customer_id="id", first_name="first_name", last_name="last_name"
    )
    theirs = fetch(t.bookings, shown.where("type = 'booking'"), "id", limit)
    booking_lines = bounded(theirs, limit).join(guests, "customer_id").select(
        F.lit("booking").alias("type"),
        F.concat(
            F.lit("New booking #"),
            F.col("booking_reference"),
            F.lit(" by "),
            F.col("first_name"),
            F.lit(" "),
            F.col("last_name"),
        ).alias("description"),
        F.col("created_at").alias("timestamp"),
        "id",
    )
    room_lines = fetch(t.rooms, shown.where("type = 'room'"), "id", limit).select(
        F.lit("room").alias("type"),
        F.concat(F.lit("Room "), F.col("room_number"), F.lit(" updated")).alias("description"),
        F.col("updated_at").alias("timestamp"),
        "id",
    )
    return booking_lines.unionByName(room_lines).orderBy(*order).select(
        "type", "description", "timestamp", F.lit(None).cast("string").alias("user_name"), "id"
    )
