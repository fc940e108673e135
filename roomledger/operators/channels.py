"""Sales channels: configurations, logs, health, payloads and sync results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.functions.clock import PERIODS, in_stats_period, timestamp
from roomledger.functions.measures import tally
from roomledger.operators.bookings import active_room_count
from roomledger.operators.rooms import channel_room_status
from roomledger.plans.keyed import renamed
from roomledger.plans.paging import bounded, fetch, older_than, page_at
from roomledger.sources.tables import Tables

# Channel names in lower case and the message form each takes.
XML_CHANNELS = ("booking.com", "booking_com")
RATES_JSON_CHANNELS = ("agoda",)
OPERATIONS_JSON_CHANNELS = ("airbnb",)
SUPPORTED = XML_CHANNELS + RATES_JSON_CHANNELS + OPERATIONS_JSON_CHANNELS

# The name that the messages of a channel carry.
SHOWN_NAMES = {
    "booking.com": "Booking.com",
    "booking_com": "Booking.com",
    "agoda": "Agoda",
    "airbnb": "Airbnb",
}

# Elements of the xml messages. A list repeats its own tag.
ARI_ROOT = "ari_update"
ARI_ROOM = "rooms"
EXPORT_ROOT = "ota_export"
EXPORT_ATTRIBUTES = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" version="1.0"'

# Constants of the channel messages.
INVENTORY = 1
MIN_STAY = 1
MAX_STAY = 30
RATE_PLAN = "Standard"
CURRENCY = "USD"

# Rooms per json document: the bound of every collected list.
ROOMS_PER_DOCUMENT = 500


def channel_configs(t: Tables) -> DataFrame:
    """Configurations without their secrets, newest first."""
    return t.ota_configurations.select(
        "id",
        "ota_name",
        "api_username",
        "endpoint_url",
        "hotel_id",
        "is_active",
        "last_sync_at",
        "sync_frequency",
        "created_at",
        "updated_at",
    ).orderBy(F.desc("created_at"), F.desc("id"))


def _names(t: Tables) -> DataFrame:
    return renamed(t.ota_configurations, ota_configuration_id="id", ota_name="ota_name")


def sync_logs(
    t: Tables,
    ota_id: int | None = None,
    page: int = 1,
    limit: int = 50,
    after: tuple[dt.datetime, int] | None = None,
) -> DataFrame:
    """One page of the sync log with channel names, newest first.

    ``after`` is the start and id of the last row shown; the next page is page 1 then.
    """
    logs = t.ota_sync_logs.where(older_than(after, "sync_started_at"))
    if ota_id is not None:
        logs = logs.where(F.col("ota_configuration_id") == ota_id)
    keys = logs.select("id", "ota_configuration_id", "sync_started_at").join(
        _names(t).select("ota_configuration_id"), "ota_configuration_id", "left_semi"
    )
    order = [F.desc("sync_started_at"), F.desc("id")]
    rows = bounded(fetch(logs, page_at(keys, "sync_started_at", order, page, limit), "id", limit), limit)
    return rows.join(_names(t), "ota_configuration_id").orderBy(*order)


def failed_syncs(t: Tables, as_of: dt.datetime) -> DataFrame:
    """Failures of the last day per channel."""
    failed = t.ota_sync_logs.where(
        (F.col("status") == "failed")
        & (F.col("sync_started_at") >= timestamp(as_of - dt.timedelta(days=1)))
    )
    counts = failed.groupBy("ota_configuration_id").agg(F.count(F.lit(1)).alias("failed_count"))
    return counts.join(_names(t), "ota_configuration_id").select("ota_name", "failed_count")


def sync_stats(t: Tables, as_of: dt.datetime, period: str | None = "week") -> DataFrame:
    """Sync totals of the active channels.

    A period keeps only channels with logs inside it; without one, channels
    that never synced appear with zero counts.
    """
    totals = (
        t.ota_sync_logs.where(in_stats_period("sync_started_at", as_of, period))
        .groupBy("ota_configuration_id")
        .agg(
            F.count(F.lit(1)).alias("total_syncs"),
            tally(F.col("status") == "success").alias("successful_syncs"),
            tally(F.col("status") == "failed").alias("failed_syncs"),
            F.max("sync_started_at").alias("last_sync_at"),
            F.sum("records_processed").alias("total_records_processed"),
        )
    )
    active = renamed(
        t.ota_configurations.where("is_active"), ota_configuration_id="id", ota_name="ota_name"
    )
    how = "inner" if period in PERIODS else "left"
    counts = ("total_syncs", "successful_syncs", "failed_syncs")
    return (
        active.join(totals, "ota_configuration_id", how)
        .withColumns({name: F.coalesce(name, F.lit(0)) for name in counts})
        .orderBy("ota_name", "ota_configuration_id")
        .drop("ota_configuration_id")
    )


# Messages -----------------------------------------------------------------


def _flag(available: str, taken: str) -> Column:
    return F.when(F.col("is_available"), available).otherwise(taken)


def _open() -> Column:
    return F.when(F.col("is_available"), 1).otherwise(0)


def channel_payload_xml(t: Tables, today: dt.date) -> DataFrame:
    """One rate-and-availability element per active room."""
    element = F.struct(
        F.col("id").alias("room_id"),
        "room_name",
        F.col("price_per_night").alias("rate"),
        _open().alias("availability"),
        F.lit(INVENTORY).alias("inventory"),
        F.struct(
            F.lit(MIN_STAY).alias("min_stay"),
            F.lit(MAX_STAY).alias("max_stay"),
            F.lit(0).alias("closed_to_arrival"),
            F.lit(0).alias("closed_to_departure"),
        ).alias("restrictions"),
    )
    return channel_room_status(t, today).select(
        F.col("id").alias("room_id"), F.to_xml(element, {"rowTag": ARI_ROOM}).alias("payload")
    )


def hotel_of(t: Tables, channel_id: int) -> Column:
    """Hotel id a channel knows us by, as a scalar subquery."""
    chosen = t.ota_configurations.where(F.col("id") == channel_id)
    return chosen.select("hotel_id").scalar()


def _documents(
    rooms: DataFrame, item: Column, hotel: Column, shape, size: int
) -> DataFrame:
    """Json documents of at most ``size`` rooms, cut by ranges of the room id.

    Ids are unique, so no list can outgrow its id range.
    """
    listed = rooms.select(
        F.floor(F.col("id") / F.lit(size)).cast("bigint").alias("document"),
        F.struct(F.col("id").alias("_id"), item.alias("item")).alias("entry"),
    )
    grouped = listed.groupBy("document").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    items = F.transform("entries", lambda entry: entry["item"])
    return grouped.select("document", F.to_json(shape(hotel, items)).alias("payload"))


def channel_payload_rates_json(
    t: Tables, channel_id: int, as_of: dt.datetime, size: int = ROOMS_PER_DOCUMENT
) -> DataFrame:
    """Rate documents: hotel, request id and one dated rate per room."""
    rate = F.struct(
        F.lit(RATE_PLAN).alias("RatePlan"),
        F.col("price_per_night").alias("Rate"),
        F.lit(as_of.date().isoformat()).alias("Date"),
        _open().alias("Availability"),
        F.lit(INVENTORY).alias("Inventory"),
    )
    item = F.struct(
        F.col("id").alias("RoomId"),
        F.col("room_name").alias("RoomType"),
        F.array(rate).alias("Rates"),
    )
    millis = int(as_of.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)

    def shape(hotel: Column, items: Column) -> Column:
        request = F.concat(F.lit(f"agoda_{millis}_"), F.col("document").cast("string"))
        return F.struct(
            hotel.alias("HotelId"), request.alias("RequestId"), items.alias("Rooms")
        )

    rooms = channel_room_status(t, as_of.date())
    return _documents(rooms, item, hotel_of(t, channel_id), shape, size)


def channel_payload_ops_json(
    t: Tables, channel_id: int, as_of: dt.datetime, size: int = ROOMS_PER_DOCUMENT
) -> DataFrame:
    """Operation documents: listing and one dated operation per room."""
    item = F.struct(
        F.col("id").cast("string").alias("room_id"),
        F.col("is_available").alias("availability"),
        F.struct(
            F.col("price_per_night").alias("amount"), F.lit(CURRENCY).alias("currency")
        ).alias("price"),
        F.lit(as_of.date().isoformat()).alias("date"),
        F.lit(1).alias("minimum_nights"),
    )

    def shape(hotel: Column, items: Column) -> Column:
        return F.struct(hotel.alias("listing_id"), items.alias("operations"))

    rooms = channel_room_status(t, as_of.date())
    return _documents(rooms, item, hotel_of(t, channel_id), shape, size)


def channel_export_rooms(t: Tables, today: dt.date) -> DataFrame:
    """Rooms as the xml export shows them; the id is an attribute."""
    return channel_room_status(t, today).select(
        F.col("id").alias("_id"),
        F.col("room_name").alias("name"),
        F.col("category_name").alias("category"),
        F.col("max_occupancy").alias("capacity"),
        F.col("price_per_night").alias("rate"),
        _flag("available", "unavailable").alias("availability"),
        "description",
        F.lit("").alias("amenities"),  # the export leaves this element empty
    )


def channel_export_xml(t: Tables, today: dt.date) -> DataFrame:
    """The room elements of the xml export as text, one per room."""
    rooms = channel_export_rooms(t, today)
    element = F.to_xml(F.struct(*rooms.columns), {"rowTag": "room"})
    return rooms.select(F.col("_id").alias("room_id"), element.alias("element"))


# Results of a sync run ----------------------------------------------------


def sync_log_rows(t: Tables, deliveries: DataFrame) -> DataFrame:
    """Log rows for channel calls of active channels.

    A failed call still counts every active room as processed; a channel
    without a message form fails with none. A call without a start time is
    taken to have started when it ended. ``moves_clock`` tells whether the
    call sets the last sync time of its channel; the other columns have the
    names and types of the stored log.
    """
    active = renamed(
        t.ota_configurations.where("is_active"), ota_configuration_id="id", ota_name="ota_name"
    )
    supported = F.lower("ota_name").isin(*SUPPORTED)
    done = F.coalesce("delivered", F.lit(False))
    names = F.create_map(*[F.lit(x) for pair in SHOWN_NAMES.items() for x in pair])
    shown = names[F.lower("ota_name")]
    # The messages of the sync log.
    message = (
        F.when(~supported, F.concat(F.lit("Unsupported OTA: "), F.col("ota_name")))
        .when(done, F.concat(shown, F.lit(" ARI sync completed successfully")))
        .otherwise(F.concat(shown, F.lit(" sync failed")))
    )
    return deliveries.join(active, "ota_configuration_id").select(
        F.col("delivery_id").alias("id"),
        "ota_configuration_id",
        F.lit("availability").alias("sync_type"),
        F.when(supported & done, "success").otherwise("failed").alias("status"),
        message.alias("message"),
        F.coalesce("started_at", "completed_at").alias("sync_started_at"),
        F.col("completed_at").alias("sync_completed_at"),
        F.when(supported, active_room_count(t))
        .otherwise(F.lit(0))
        .cast("int")
        .alias("records_processed"),
        supported.alias("moves_clock"),
    )


def last_syncs(t: Tables, log_rows: DataFrame) -> DataFrame:
    """Configurations with the last sync time moved by the given log rows."""
    newest = (
        log_rows.where("moves_clock")
        .groupBy(F.col("ota_configuration_id").alias("_channel"))
        .agg(F.max("sync_completed_at").alias("_newest"))
    )
    return (
        t.ota_configurations.join(newest, F.col("id") == F.col("_channel"), "left")
        .withColumn("last_sync_at", F.greatest("last_sync_at", "_newest"))
        .drop("_channel", "_newest")
    )


def sync_run_summary(log_rows: DataFrame) -> DataFrame:
    """Totals of one run."""
    good = F.col("status") == "success"
    return log_rows.agg(
        F.count(F.lit(1)).alias("total_otas"),
        F.count(F.when(good, 1)).alias("successful_syncs"),
        F.count(F.when(~good, 1)).alias("failed_syncs"),
    )


# Rates over time, batch or stream -------------------------------------------


def sync_health(logs: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Syncs and failures per channel and tumbling window.

    On a stream, ``late`` sets the watermark of ``sync_started_at``.
    """
    if late:
        logs = logs.withWatermark("sync_started_at", late)
    return (
        logs.groupBy(F.window("sync_started_at", width).alias("w"), "ota_configuration_id")
        .agg(
            F.count(F.lit(1)).alias("total_syncs"),
            F.count_if(F.col("status") == "failed").alias("failed_syncs"),
            F.sum("records_processed").alias("records_processed"),
        )
        .select(
            "ota_configuration_id",
            F.col("w.start").alias("window_start"),
            "total_syncs",
            "failed_syncs",
            "records_processed",
        )
    )


def request_rate(
    log: DataFrame, width: str = "15 minutes", limit: int = 100, late: str | None = None
) -> DataFrame:
    """Requests per client and fixed window, flagged above ``limit``."""
    if late:
        log = log.withWatermark("ts", late)
    return (
        log.groupBy(F.window("ts", width).alias("w"), "client_id")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(
            "client_id",
            F.col("w.start").alias("window_start"),
            "requests",
            (F.col("requests") > limit).alias("over_limit"),
        )
    )
