"""Room catalogue, availability search, calendar and room performance."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions.clock import day, in_stats_period
from roomledger.functions.measures import (
    BLOCKING,
    ON_CALENDAR,
    earned,
    earned_revenue,
    percent,
    ratio,
    status_in,
    tally,
)
from roomledger.functions.stays import CHECK_IN, CHECK_OUT, in_house, overlaps
from roomledger.plans.keyed import key_set, renamed
from roomledger.sources.tables import Tables


# Images in the detail of each room where all rooms are listed.
IMAGES_SHOWN = 100


def with_category(rooms: DataFrame, categories: DataFrame) -> DataFrame:
    """Rooms with the name and text of their category, null without one."""
    named = renamed(
        categories,
        _category_id="id",
        category_name="name",
        category_description="description",
    )
    joined = rooms.join(named, F.col("room_category_id") == F.col("_category_id"), "left")
    return joined.drop("_category_id")


def _image_summary(images: DataFrame) -> DataFrame:
    primary = F.when(F.col("is_primary"), F.col("image_path"))
    first_primary = F.min_by(primary, F.when(F.col("is_primary"), F.col("id")))
    return images.groupBy(F.col("room_id").alias("_image_room")).agg(
        F.count(F.lit(1)).alias("image_count"), first_primary.alias("primary_image")
    )


def _amenity_lists(t: Tables) -> DataFrame:
    """Distinct amenities per room: no list outgrows the amenity catalogue."""
    catalogue = renamed(
        t.amenities, _amenity="id", name="name", icon="icon", description="description"
    )
    pairs = t.room_amenities.join(catalogue, F.col("amenity_id") == F.col("_amenity"))
    item = F.struct(F.col("amenity_id").alias("id"), "name", "icon", "description")
    return pairs.groupBy(F.col("room_id").alias("_amenity_room")).agg(
        F.array_sort(F.collect_set(item)).alias("amenities")
    )


def _with_media(rooms: DataFrame, t: Tables) -> DataFrame:
    images, amenities = _image_summary(t.room_images), _amenity_lists(t)
    return (
        rooms.join(images, F.col("id") == F.col("_image_room"), "left")
        .join(amenities, F.col("id") == F.col("_amenity_room"), "left")
        .drop("_image_room", "_amenity_room")
        .withColumn("image_count", F.coalesce("image_count", F.lit(0)))
    )


def rooms_list(
    t: Tables, category_id: int | None = None, is_active: bool | None = True
) -> DataFrame:
    """Rooms with category, image count, primary image and amenities, newest first.

    ``is_active=None`` lists every room.
    """
    rooms = t.rooms
    if category_id is not None:
        rooms = rooms.where(F.col("room_category_id") == category_id)
    if is_active is not None:
        rooms = rooms.where(F.col("is_active") == is_active)
    listed = _with_media(with_category(rooms, t.room_categories), t)
    return listed.orderBy(F.desc("created_at"), F.desc("id"))


def room_detail(t: Tables, room_id: int | None = None) -> DataFrame:
    """One room (or all) with category, amenities and images.

    ``images`` holds the images in order: all of them for one room, the first
    ``IMAGES_SHOWN`` of each where all rooms are listed. ``image_count`` tells how
    many there are; ``room_gallery`` has them as rows.
    """
    rooms = t.rooms if room_id is None else t.rooms.where(F.col("id") == room_id)
    shown_of_each = IMAGES_SHOWN if room_id is None else None
    amenities, gallery = _amenity_lists(t), room_gallery(t, room_id, shown_of_each)
    shown = F.struct("position", "id", "image_path", "image_alt", "is_primary")
    images = gallery.groupBy(F.col("room_id").alias("_image_room")).agg(
        F.array_sort(F.collect_list(shown)).alias("images")
    )
    counts = _image_summary(t.room_images).select(
        F.col("_image_room").alias("_counted_room"), "image_count"
    )
    return (
        with_category(rooms, t.room_categories)
        .join(amenities, F.col("id") == F.col("_amenity_room"), "left")
        .join(images, F.col("id") == F.col("_image_room"), "left")
        .join(counts, F.col("id") == F.col("_counted_room"), "left")
        .withColumn("image_count", F.coalesce("image_count", F.lit(0)))
        .drop("_amenity_room", "_image_room", "_counted_room")
    )


def room_gallery(
    t: Tables, room_id: int | None = None, most: int | None = None
) -> DataFrame:
    """Images of one room (or of all), primary first, then display order.

    Images come as rows: a room may own more of them than one list should
    hold. ``position`` counts them per room; with ``most``, only the first
    ones of each room are kept, which a task does for its own rows before
    anything is shuffled.
    """
    images = t.room_images
    if room_id is not None:
        images = images.where(F.col("room_id") == room_id)
    order = Window.partitionBy("room_id").orderBy(
        F.desc("is_primary"), F.asc("display_order"), F.asc("id")
    )
    placed = images.withColumn("position", F.row_number().over(order))
    if most is not None:
        placed = placed.where(F.col("position") <= most)
    return placed if room_id is None else placed.orderBy("position")


def room_search(
    t: Tables,
    check_in: dt.date,
    check_out: dt.date,
    adults: int,
    children: int = 0,
    category_id: int | None = None,
    today: dt.date | None = None,
) -> DataFrame:
    """Active rooms that hold the party and are free for the stay, cheapest first.

    The price is nights times the room rate, without tax. A booking that lost
    its room blocks nothing.
    """
    if check_in >= check_out:
        raise ValueError("check-out date must be after check-in date")
    if today is not None and check_in < today:
        raise ValueError("check-in date cannot be in the past")
    rooms = t.rooms.where(F.col("is_active") & (F.col("max_occupancy") >= adults + children))
    if category_id is not None:
        rooms = rooms.where(F.col("room_category_id") == category_id)
    taken = key_set(
        t.bookings.where(status_in(BLOCKING) & overlaps(check_in, check_out)), "room_id", "id"
    )
    length = (check_out - check_in).days
    free = rooms.join(taken, "id", "left_anti")
    return (
        _with_media(with_category(free, t.room_categories), t)
        .drop("image_count")
        .withColumn("nights", F.lit(length))
        .withColumn(
            "total_price", (F.col("price_per_night") * F.lit(length)).cast("decimal(14,2)")
        )
        .orderBy(F.asc("price_per_night"), F.asc("id"))
    )


def categories_list(t: Tables) -> DataFrame:
    return t.room_categories.orderBy("name", "id")


def amenities_list(t: Tables) -> DataFrame:
    return t.amenities.orderBy("name", "id")


def availability_calendar(
    t: Tables, start: dt.date, end: dt.date | None = None, ordered: bool = True
) -> DataFrame:
    """Every active room on every day from ``start`` to ``end`` inclusive.

    A stay that begins on ``end`` itself is outside the requested range, so
    the last day shows its room as free. When stays collide, the lowest
    booking id names the status.

    Stays fold to one row per room before they are shuffled, with one code for each day of
    the range: the lowest booking id and its status. Days become rows after the join, so no
    exchange carries more than a row per room and task; ``ordered=False`` leaves out the
    sort by day, which moves them all.
    """
    end = end or start + dt.timedelta(days=30)
    days = [start + dt.timedelta(days=n) for n in range((end - start).days + 1)]
    statuses = F.array(*map(F.lit, ON_CALENDAR))
    # ids below 2^61 keep their order; larger ones fail instead of wrapping
    code = F.col("id") * 4 + F.array_position(statuses, F.col("booking_status")) - 1
    on = [
        F.min(F.when((F.col(CHECK_IN) <= day(d)) & (F.col(CHECK_OUT) > day(d)), code)).alias(f"_{n}")
        for n, d in enumerate(days)
    ]
    stays = t.bookings.where(status_in(ON_CALENDAR) & overlaps(start, end) & (F.col(CHECK_IN) < F.col(CHECK_OUT)))
    codes = stays.groupBy(F.col("room_id").alias("_stay_room")).agg(*on)
    codes = codes.select("_stay_room", F.array(*[f"_{n}" for n in range(len(days))]).alias("_codes"))
    shown = with_category(t.rooms.where("is_active"), t.room_categories).join(
        codes, F.col("id") == F.col("_stay_room"), "left"
    )
    free = F.array_repeat(F.lit(None).cast("bigint"), len(days))
    grid = shown.select(
        F.col("id").alias("room_id"), "room_number", "room_name", "category_name",
        F.posexplode(F.coalesce("_codes", free)).alias("_day", "_code"),
    ).select(
        "room_id",
        F.date_add(day(start), F.col("_day")).alias("date"),
        "room_number", "room_name", "category_name",
        F.get(statuses, F.pmod("_code", F.lit(4)).cast("int")).alias("booking_status"),
        F.col("_code").isNull().alias("is_available"),
    )
    return grid.orderBy("date", "room_number", "room_id") if ordered else grid


def channel_room_status(t: Tables, today: dt.date) -> DataFrame:
    """Active rooms with a flag that no pending or confirmed stay covers today."""
    taken = key_set(
        t.bookings.where(status_in(BLOCKING) & in_house(today)), "room_id", "_taken_room"
    )
    rooms = with_category(t.rooms.where("is_active"), t.room_categories)
    return (
        rooms.join(taken, F.col("id") == F.col("_taken_room"), "left")
        .withColumn("is_available", F.col("_taken_room").isNull())
        .drop("_taken_room")
    )


def rooms_without_images(t: Tables) -> DataFrame:
    pictured = key_set(t.room_images, "room_id", "id")
    active = t.rooms.where("is_active").select("id", "room_number", "room_name")
    return active.join(pictured, "id", "left_anti")


def room_performance(t: Tables, as_of: dt.datetime, period: str = "month") -> DataFrame:
    """Bookings, revenue and success rate of every active room, best first.

    Rooms without bookings stay, with no success rate.
    """
    booked = (
        t.bookings.where(in_stats_period("created_at", as_of, period))
        .groupBy(F.col("room_id").alias("_room"))
        .agg(
            F.count(F.lit(1)).alias("total_bookings"),
            earned_revenue().alias("total_revenue"),
            F.count(F.when(earned(), F.col("total_amount"))).alias("_earned"),
            tally(F.col("booking_status") == "cancelled").alias("cancelled_bookings"),
        )
    )
    rooms = with_category(t.rooms.where("is_active"), t.room_categories)
    zero = F.lit(0)
    joined = rooms.join(booked, F.col("id") == F.col("_room"), "left")
    total = F.coalesce("total_bookings", zero)
    cancelled = F.coalesce("cancelled_bookings", zero)
    return joined.select(
        "id",
        "room_number",
        "room_name",
        "category_name",
        total.alias("total_bookings"),
        F.coalesce("total_revenue", zero.cast("decimal(20,2)")).alias("total_revenue"),
        ratio(F.col("total_revenue"), F.col("_earned")).alias("avg_revenue"),
        cancelled.alias("cancelled_bookings"),
        percent(total - cancelled, total).alias("success_rate"),
    ).orderBy(F.desc("total_revenue"), F.asc("id"))
