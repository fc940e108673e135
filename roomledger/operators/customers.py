"""Guest pages, search, history, statistics and preferences.

On these pages spend means completed bookings only, unlike in the reports.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions.clock import in_stats_period, period_start, timestamp
from roomledger.functions.measures import earned, mean, money_where, status_tallies
from roomledger.functions.stays import CHECK_IN, nights
from roomledger.operators.reports import booking_totals, spent_or_zero, with_totals
from roomledger.operators.rooms import with_category
from roomledger.operators.search import SEARCHED, candidates
from roomledger.plans.keyed import renamed
from roomledger.plans.paging import bounded, fetch, older_than, page_at, page_count, page_of
from roomledger.sources.tables import Tables


def completed_spend() -> Column:
    return money_where(F.col("booking_status") == "completed")


def _mentions(text: str, *names: str) -> Column:
    """Any of the columns contains ``text``; ``%`` and ``_`` stay wildcards."""
    found = F.lit(False)
    for name in names:
        found = found | F.coalesce(F.col(name).ilike(f"%{text}%"), F.lit(False))
    return found


def _matching(t: Tables, search: str | None, index: str | None = None) -> DataFrame:
    if not search:
        return t.customers
    names = ("first_name", "last_name", "email")
    return candidates(t.customers, search, names, index).where(_mentions(search, *names))


def _page_with_totals(guests: DataFrame, t: Tables, page: int, limit: int) -> DataFrame:
    """One page of guests, newest first, with totals of just those guests.

    The page is cut before any booking is read; the bookings are then reduced
    by a broadcast of at most ``limit`` guest ids.
    """
    keys = guests.select("id", "created_at")
    chosen = page_at(keys, "created_at", [F.desc("created_at"), F.desc("id")], page, limit)
    shown = bounded(fetch(guests, chosen, "id", limit), limit)
    ids = bounded(shown.select(F.col("id").alias("customer_id")), limit)
    theirs = (
        t.bookings.join(ids, "customer_id", "left_semi")
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("total_bookings"),
            completed_spend().alias("total_spent"),
            F.max("created_at").alias("last_booking_date"),
        )
    )
    return (
        with_totals(shown, theirs)
        .withColumn("total_bookings", F.coalesce("total_bookings", F.lit(0)))
        .withColumn("total_spent", spent_or_zero())
        .orderBy(F.desc("created_at"), F.desc("id"))
    )


def customers_page(
    t: Tables,
    search: str | None = None,
    page: int = 1,
    limit: int = 50,
    after: tuple[dt.datetime, int] | None = None,
    index: str | None = None,
) -> DataFrame:
    """One page of guests, newest first; ``after`` seeks as in ``bookings_page``.

    ``index`` is where ``write_search_index`` put the postings of these guests.
    """
    found = _matching(t, search, index).where(older_than(after))
    return _page_with_totals(found, t, page, limit)


def customers_page_count(
    t: Tables, search: str | None = None, limit: int = 50, index: str | None = None
) -> DataFrame:
    total = _matching(t, search, index).agg(F.count(F.lit(1)).alias("total"))
    return total.select("total", page_count(F.col("total"), limit).alias("pages"))


def customer_search(
    t: Tables, text: str, limit: int = 10, index: str | None = None
) -> DataFrame:
    """Guests whose name, e-mail or phone contains ``text``, newest first."""
    found = candidates(t.customers, text, SEARCHED, index).where(_mentions(text, *SEARCHED))
    return _page_with_totals(found, t, 1, limit).drop("total_spent")


def _of(bookings: DataFrame, customer_id: int | None) -> DataFrame:
    if customer_id is None:
        return bookings.where(F.col("customer_id").isNotNull())
    return bookings.where(F.col("customer_id") == customer_id)


def _listed(df: DataFrame, customer_id: int | None, *order: Column) -> DataFrame:
    """Ordered for one guest; the rows of all guests are not sorted as a whole."""
    return df if customer_id is None else df.orderBy(*order)


def customer_history(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Bookings of one guest with room and category, newest first (or of all)."""
    rooms = renamed(
        with_category(t.rooms, t.room_categories),
        room_id="id",
        room_name="room_name",
        room_number="room_number",
        category_name="category_name",
    )
    stays = _of(t.bookings, customer_id).join(rooms, "room_id")
    return _listed(stays, customer_id, F.desc("created_at"), F.desc("id"))


def customer_stats(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Bookings per status and completed spend of each guest, zeros without bookings.

    Only bookings whose room exists count, as in the history.
    """
    known = _of(t.bookings, customer_id).join(
        t.rooms.select(F.col("id").alias("room_id")), "room_id", "left_semi"
    )
    folded = known.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_bookings"),
        completed_spend().alias("total_spent"),
        *status_tallies("pending", "confirmed", "cancelled", "completed", suffix="_bookings"),
    )
    guests = t.customers.select(F.col("id").alias("customer_id"))
    every = _of(guests, customer_id).join(folded, "customer_id", "left")
    return every.na.fill(0)


def customers_overview(t: Tables, as_of: dt.datetime, period: str = "month") -> DataFrame:
    month = timestamp(period_start(as_of, "month"))
    week = timestamp(period_start(as_of, "week"))
    return t.customers.where(in_stats_period("created_at", as_of, period)).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count(F.when(F.col("created_at") >= month, 1)).alias("new_customers_month"),
        F.count(F.when(F.col("created_at") >= week, 1)).alias("new_customers_week"),
    )


def top_customers_completed(t: Tables, n: int = 10) -> DataFrame:
    """The guests with the highest completed spend, with all their columns."""
    totals = with_totals(t.customers.select("id"), booking_totals(t, completed_spend())).select(
        F.col("id").alias("_guest"),
        F.coalesce("total_bookings", F.lit(0)).alias("total_bookings"),
        spent_or_zero().alias("total_spent"),
    )
    best = bounded(page_of(totals, [F.desc("total_spent"), F.asc("_guest")], 1, n), n)
    return (
        t.customers.join(best, F.col("id") == F.col("_guest"))
        .drop("_guest")
        .orderBy(F.desc("total_spent"), F.asc("id"))
    )


def customer_countries(t: Tables, n: int = 10) -> DataFrame:
    return (
        t.customers.where(F.col("country") != "")
        .groupBy("country")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("country"))
        .limit(n)
    )


def customer_category_prefs(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Earned bookings of each guest per room category, most used first."""
    rooms = renamed(
        with_category(t.rooms, t.room_categories), room_id="id", preferred_category="category_name"
    )
    stays = _of(t.bookings, customer_id).where(earned()).join(rooms, "room_id")
    prefs = stays.groupBy("customer_id", "preferred_category").agg(
        F.count(F.lit(1)).alias("total_bookings"),
        mean(F.col("adults")).alias("avg_adults"),
        mean(F.col("children")).alias("avg_children"),
        mean(F.col("total_amount")).alias("avg_spending"),
        mean(nights()).alias("avg_stay_length"),
        F.count("preferred_category").alias("category_bookings"),
    )
    return _listed(prefs, customer_id, F.desc("category_bookings"), F.asc("preferred_category"))


def customer_amenity_prefs(t: Tables, customer_id: int | None = None, k: int = 5) -> DataFrame:
    """The ``k`` amenities each guest met most often on earned stays.

    Stays fold to one row per guest and room before they fan out to the
    amenities of the room, and a guest has at most one row per amenity when
    the ranking window sees them.
    """
    visits = (
        _of(t.bookings, customer_id)
        .where(earned())
        .groupBy("customer_id", "room_id")
        .agg(F.count(F.lit(1)).alias("visits"))
    )
    catalogue = renamed(t.amenities, amenity_id="id", name="name", icon="icon")
    existing = t.rooms.select(F.col("id").alias("room_id"))
    usage = (
        visits.join(existing, "room_id", "left_semi")
        .join(t.room_amenities, "room_id")
        .groupBy("customer_id", "amenity_id")
        .agg(F.sum("visits").alias("usage_count"))
        .join(catalogue, "amenity_id")
    )
    best = Window.partitionBy("customer_id").orderBy(F.desc("usage_count"), F.asc("amenity_id"))
    liked = (
        usage.withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= k)
        .select("customer_id", "amenity_id", "name", "icon", "usage_count")
    )
    return _listed(liked, customer_id, F.desc("usage_count"), F.asc("amenity_id"))


def customer_seasonality(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Earned bookings of each guest per month of arrival."""
    months = (
        _of(t.bookings, customer_id)
        .where(earned())
        .groupBy("customer_id", F.month(CHECK_IN).alias("month"))
        .agg(F.count(F.lit(1)).alias("bookings"), mean(F.col("total_amount")).alias("avg_amount"))
    )
    return _listed(months, customer_id, F.asc("month"))
