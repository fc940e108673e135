"""The three flat extracts and their csv text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.functions.measures import earned_mean, earned_revenue
from roomledger.operators.bookings import with_guest_and_room
from roomledger.operators.reports import booking_totals, spent_or_zero, with_totals
from roomledger.sources.tables import Tables


def export_bookings(t: Tables, ordered: bool = True) -> DataFrame:
    """Every booking with guest and room, newest first."""
    rows = with_guest_and_room(t.bookings, t).select(
        "booking_reference",
        "created_at",
        "check_in_date",
        "check_out_date",
        "adults",
        "children",
        "total_amount",
        "booking_status",
        "source",
        F.concat("first_name", F.lit(" "), "last_name").alias("customer_name"),
        F.col("email").alias("customer_email"),
        "room_number",
        "room_name",
    )
    return rows.orderBy(F.desc("created_at"), F.asc("booking_reference")) if ordered else rows


def export_customers(t: Tables, ordered: bool = True) -> DataFrame:
    """Every guest with bookings and earned spend, highest spend first."""
    rows = with_totals(t.customers, booking_totals(t, earned_revenue())).select(
        "first_name",
        "last_name",
        "email",
        "phone",
        "country",
        "created_at",
        F.coalesce("total_bookings", F.lit(0)).alias("total_bookings"),
        spent_or_zero().alias("total_spent"),
    )
    return rows.orderBy(F.desc("total_spent"), F.asc("email")) if ordered else rows


def export_revenue(t: Tables) -> DataFrame:
    return (
        t.bookings.groupBy(F.to_date("created_at").alias("date"))
        .agg(
            F.count(F.lit(1)).alias("total_bookings"),
            earned_revenue().alias("revenue"),
            earned_mean().alias("avg_booking_value"),
        )
        .orderBy(F.desc("date"))
    )
