"""Every operator as a named query over a star-schema directory."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from roomledger.operators import (
    admission,
    bookings,
    changes,
    channels,
    customers,
    dashboard,
    day_totals,
    exports,
    gaps,
    quality,
    reports,
    room_days,
    rooms,
    search,
    settings,
)
from roomledger.operators.reports import ReportWindow
from roomledger.plans.stored import scratch_path
from roomledger.sinks import files
from roomledger.sources.starmap import StarSource
from roomledger.sources.tables import load_tables, store_tables, table_contents, table_sizes

# The clock of the bookings and that of the channel logs.
AS_OF = dt.datetime(2001, 6, 15, 12)
LOGS_AS_OF = dt.datetime(2024, 1, 31)
TODAY = AS_OF.date()
ADMISSION_AS_OF = dt.datetime(1997, 1, 1)
CANCEL_AS_OF = dt.datetime(1998, 6, 15, 12)

# The whole history of the bookings.
START, END = dt.date(1995, 1, 1), dt.date(2001, 12, 31)
ALL_TIME = ReportWindow(AS_OF, start=START, end=END)
LAST_YEAR = ReportWindow(AS_OF, period="year")
LAST_MONTH = ReportWindow(AS_OF)
LAST_WEEK = ReportWindow(AS_OF, period="week")

SEARCH_STAY = (dt.date(2001, 6, 20), dt.date(2001, 6, 23))
CALENDAR = (dt.date(2001, 6, 15), dt.date(2001, 7, 15))

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, the form the comparison reads."""
    money = [f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)]
    return df.withColumns({name: F.col(name).cast("double") for name in money})


def _names(df: DataFrame) -> DataFrame:
    """The amenity list of a room as the text of its names."""
    names = F.array_join(F.transform("amenities", lambda a: a["name"]), ",")
    return df.withColumn("amenities", names)


def _typed_settings(src: StarSource) -> DataFrame:
    typed = settings.settings_typed(src.tables())
    text = F.variant_get("json_value", "$.k", "int")
    return typed.withColumn("json_k", text).drop("json_value")


def _primary_images(src: StarSource) -> DataFrame:
    images = src.room_images()
    first = images.groupBy("room_id").agg(F.min("id").alias("id"))
    flagged = changes.set_single_flag(images, "is_primary", first, "room_id")
    return flagged.select("id", "room_id", "image_path", "is_primary", "display_order")


def _cascade(src: StarSource) -> DataFrame:
    t = src.tables()
    return changes.room_cascade_counts(t, changes.deletable_rooms(t))


def _admit(src: StarSource) -> DataFrame:
    return admission.admit_bookings(
        src.booking_requests(), src.bookings(), src.rooms(), ADMISSION_AS_OF
    ).drop("email")


def _applied_cancellations(src: StarSource) -> DataFrame:
    t = src.tables()
    outcomes = changes.cancel_bookings(src.cancel_requests(), t, CANCEL_AS_OF)
    return changes.apply_cancellations(t.bookings, outcomes, CANCEL_AS_OF).select(
        "id", "booking_status", "updated_at"
    )


def _status_after_changes(src: StarSource) -> DataFrame:
    after = changes.apply_status_changes(src.bookings(), src.status_changes())
    return after.select("id", "booking_reference", "booking_status", "updated_at")


def _upsert(src: StarSource) -> DataFrame:
    after = changes.upsert_customers(src.incoming_customers(), src.customers(), AS_OF)
    return after.select(
        "id", "first_name", "last_name", "email", "phone", "country", "updated_at", "action"
    )


def _written_csv(src: StarSource) -> DataFrame:
    """The lines that the csv sink writes, read back."""
    extract = exports.export_bookings(src.tables(), ordered=False)
    path = scratch_path(extract.sparkSession, "write_csv")
    files.write_csv(extract, path)
    return files.csv_text(extract.sparkSession, path)


def _stored_tables(src: StarSource) -> DataFrame:
    """All tables written, loaded again and compared with what was written."""
    path = scratch_path(src.spark, "tables")
    store_tables(src.tables(), path)
    given = table_contents(src.tables()).select("table_name", F.col("contents").alias("given"))
    read = table_contents(load_tables(src.spark, path)).join(given, "table_name")
    return read.select("table_name", "row_count", (F.col("contents") == F.col("given")).alias("same"))


def _booking_days(src: StarSource) -> DataFrame:
    """Stored totals per day: of the bookings as they were, and of the feed of changes."""
    path = scratch_path(src.spark, "booking-days")
    day_totals.booking_days(src.bookings()).write.parquet(path)
    return src.spark.read.parquet(path)


def _changed_days(src: StarSource) -> DataFrame:
    """The dashboard after the feed of status changes, from totals and one increment."""
    path = scratch_path(src.spark, "booking-days")
    day_totals.booking_days(src.bookings()).write.parquet(path)
    increment = day_totals.status_day_changes(src.bookings(), src.status_changes())
    increment.write.mode("append").parquet(path)
    return day_totals.dashboard_bookings(src.spark.read.parquet(path), AS_OF)


def _indexed(src: StarSource) -> str:
    """Where the search index of the guests was written."""
    path = scratch_path(src.spark, "guest-search")
    search.write_search_index(src.customers(), path)
    return path


def _room_days(src: StarSource) -> DataFrame:
    """The stored bitmaps of all bookings."""
    path = scratch_path(src.spark, "room-days")
    room_days.write_room_days(src.bookings(), path)
    return src.spark.read.parquet(path)


def _log_rows(src: StarSource) -> DataFrame:
    return channels.sync_log_rows(src.tables(), src.deliveries())


def _row_violations(src: StarSource) -> DataFrame:
    checked = quality.quality_report(src.bookings(), "bookings")
    return checked.select("id", F.array_join("violations", ",").alias("violations")).where(
        F.col("violations") != ""
    )


def _booked(op: Callable[..., DataFrame], **args) -> Callable[[StarSource], DataFrame]:
    return lambda src: op(src.tables(), **args)


_QUERIES: dict[str, Callable[[StarSource], DataFrame]] = {
    # Sources and sinks
    "load_tables": lambda src: table_sizes(src.tables()),
    "load_tables_stored": _stored_tables,
    "export_bookings": _booked(exports.export_bookings),
    "export_customers": _booked(exports.export_customers),
    "export_revenue": _booked(exports.export_revenue),
    "write_csv": _written_csv,
    "channel_export_xml": _booked(channels.channel_export_xml, today=TODAY),
    "channel_payload_xml": _booked(channels.channel_payload_xml, today=TODAY),
    "channel_payload_rates_json": _booked(
        channels.channel_payload_rates_json, channel_id=2, as_of=AS_OF
    ),
    "channel_payload_ops_json": _booked(
        channels.channel_payload_ops_json, channel_id=3, as_of=AS_OF
    ),
    "append_sync_log": _log_rows,
    "append_sync_log_last_sync": lambda src: channels.last_syncs(
        src.tables(), _log_rows(src)
    ).select("id", "ota_name", "last_sync_at"),
    # Rooms
    "rooms_list": lambda src: _names(rooms.rooms_list(src.tables())),
    "room_detail": lambda src: _names(rooms.room_detail(src.tables())).withColumn(
        "images", F.array_join(F.transform("images", lambda i: i["image_path"]), ",")
    ),
    "room_gallery": lambda src: rooms.room_gallery(src.tables()).select(
        "id", "room_id", "image_path", "is_primary", "display_order", "position"
    ),
    "room_search": lambda src: _names(
        rooms.room_search(src.tables(), *SEARCH_STAY, adults=2, children=1, today=TODAY)
    ),
    "free_room_counts": lambda src: gaps.free_room_counts(src.tables(), src.stays_asked()),
    "categories_list": _booked(rooms.categories_list),
    "amenities_list": _booked(rooms.amenities_list),
    "availability_calendar": _booked(
        rooms.availability_calendar, start=CALENDAR[0], end=CALENDAR[1], ordered=False
    ),
    "channel_room_status": lambda src: rooms.channel_room_status(src.tables(), TODAY).select(
        "id", "room_number", "room_name", "category_name", "price_per_night", "is_available"
    ),
    "rooms_without_images": _booked(rooms.rooms_without_images),
    "room_performance": _booked(rooms.room_performance, as_of=AS_OF, period="all"),
    "room_performance_year": _booked(rooms.room_performance, as_of=AS_OF, period="year"),
    "currencies_list": _booked(settings.currencies_list),
    "languages_list": _booked(settings.languages_list),
    "hotel_info": _booked(settings.hotel_info),
    "settings_typed": _typed_settings,
    "staff_directory": _booked(settings.staff_directory),
    # Bookings
    "booking_lookup": _booked(bookings.booking_lookup),
    "bookings_page": _booked(
        bookings.bookings_page,
        status="confirmed",
        date_from=dt.date(1996, 1, 1),
        date_to=dt.date(2000, 12, 31),
        page=2,
    ),
    "bookings_page_count": _booked(
        bookings.bookings_page_count,
        status="confirmed",
        date_from=dt.date(1996, 1, 1),
        date_to=dt.date(2000, 12, 31),
    ),
    "status_breakdown": _booked(bookings.status_breakdown, as_of=AS_OF, period="all"),
    "booking_revenue_stats": _booked(
        bookings.booking_revenue_stats, as_of=AS_OF, period="year"
    ),
    "current_occupancy": _booked(bookings.current_occupancy, today=TODAY),
    "recent_bookings": _booked(bookings.recent_bookings),
    "upcoming_check_ins": _booked(bookings.upcoming_check_ins, today=TODAY),
    "upcoming_check_outs": _booked(bookings.upcoming_check_outs, today=TODAY),
    "stale_pending": _booked(bookings.stale_pending, as_of=AS_OF),
    "booking_trends": _booked(bookings.booking_trends, as_of=AS_OF),
    "booking_trends_revenue": _booked(
        bookings.booking_trends, as_of=AS_OF, period="year", measure="revenue"
    ),
    "booking_conflicts": _booked(bookings.booking_conflicts),
    "price_quotes": _booked(bookings.price_quotes),
    # Dashboard
    "dashboard_bookings": _booked(dashboard.dashboard_bookings, as_of=AS_OF),
    "dashboard_revenue": _booked(dashboard.dashboard_revenue, as_of=AS_OF),
    "dashboard_bookings_days": lambda src: day_totals.dashboard_bookings(_booking_days(src), AS_OF),
    "dashboard_bookings_changed": _changed_days,
    "dashboard_revenue_days": lambda src: day_totals.dashboard_revenue(_booking_days(src), AS_OF),
    "dashboard_customers_days": lambda src: day_totals.dashboard_customers(
        day_totals.customer_days(src.customers()), AS_OF
    ),
    "revenue_overall_days": lambda src: day_totals.revenue_overall(
        src.tables(), _booking_days(src), LAST_MONTH
    ),
    "revenue_by_date_days": lambda src: day_totals.revenue_by_date(
        src.tables(), _booking_days(src), LAST_YEAR
    ),
    "revenue_by_source_days": lambda src: day_totals.revenue_by_source(
        src.tables(), _booking_days(src), ALL_TIME
    ),
    "dashboard_rooms": _booked(dashboard.dashboard_rooms),
    "dashboard_customers": _booked(dashboard.dashboard_customers, as_of=AS_OF),
    "system_alerts": _booked(dashboard.system_alerts, as_of=AS_OF, logs_as_of=LOGS_AS_OF),
    # Reports
    "revenue_overall": _booked(reports.revenue_overall, window=ALL_TIME),
    "revenue_overall_month": _booked(reports.revenue_overall, window=LAST_MONTH),
    "revenue_by_date": _booked(reports.revenue_by_date, window=ALL_TIME),
    "revenue_by_date_year": _booked(reports.revenue_by_date, window=LAST_YEAR),
    "revenue_by_category": _booked(reports.revenue_by_category, window=ALL_TIME),
    "revenue_by_source": _booked(reports.revenue_by_source, window=ALL_TIME),
    "revenue_report": _booked(reports.revenue_report, window=ALL_TIME),
    "occupancy_total_rooms": _booked(reports.occupancy_total_rooms),
    "occupancy_average": _booked(reports.occupancy_average, window=ALL_TIME),
    "occupancy_by_date": _booked(reports.occupancy_by_date, window=ALL_TIME),
    "occupancy_by_date_month": _booked(reports.occupancy_by_date, window=LAST_MONTH),
    "occupancy_average_stored": lambda src: room_days.occupancy_average(
        src.tables(), _room_days(src), ALL_TIME
    ),
    "occupancy_by_date_stored": lambda src: room_days.occupancy_by_date(
        src.tables(), _room_days(src), ALL_TIME
    ),
    "occupancy_by_category_stored": lambda src: room_days.occupancy_by_category(
        src.tables(), _room_days(src), LAST_YEAR
    ),
    "current_occupancy_stored": lambda src: room_days.current_occupancy(
        src.tables(), _room_days(src), TODAY
    ),
    "occupancy_by_category": _booked(reports.occupancy_by_category, window=LAST_YEAR),
    "length_of_stay": _booked(reports.length_of_stay, window=ALL_TIME),
    "booking_summary": _booked(reports.booking_summary, window=ALL_TIME),
    "booking_summary_direct": _booked(
        reports.booking_summary, window=LAST_YEAR, source="direct"
    ),
    "bookings_by_date": _booked(reports.bookings_by_date, window=ALL_TIME),
    "bookings_by_source": _booked(reports.bookings_by_source, window=ALL_TIME),
    "bookings_report": _booked(reports.bookings_report, window=ALL_TIME),
    "cancellation_timing": _booked(reports.cancellation_timing, window=ALL_TIME),
    "customer_summary": _booked(reports.customer_summary, window=ALL_TIME),
    "customers_by_country": _booked(reports.customers_by_country, window=ALL_TIME),
    "top_customers": _booked(reports.top_customers, window=ALL_TIME),
    "customer_acquisition": _booked(reports.customer_acquisition, window=ALL_TIME),
    "repeat_customers": _booked(reports.repeat_customers, window=ALL_TIME),
    # Customers
    "customers_page": lambda src: customers.customers_page(
        src.tables(), search="UILD", page=2, limit=20
    ),
    "customers_page_count": _booked(customers.customers_page_count, search="UILD", limit=20),
    "customer_history": _booked(customers.customer_history),
    "customer_stats": _booked(customers.customer_stats),
    "customers_overview": _booked(customers.customers_overview, as_of=AS_OF, period="year"),
    "top_customers_completed": _booked(customers.top_customers_completed),
    "customer_countries": _booked(customers.customer_countries),
    "customer_search": _booked(customers.customer_search, text="55500"),
    "customer_search_indexed": lambda src: customers.customer_search(
        src.tables(), text="55500", index=_indexed(src)
    ),
    "customers_page_indexed": lambda src: customers.customers_page(
        src.tables(), search="UILD", page=2, limit=20, index=_indexed(src)
    ),
    "customer_category_prefs": _booked(customers.customer_category_prefs),
    "customer_amenity_prefs": _booked(customers.customer_amenity_prefs),
    "customer_seasonality": _booked(customers.customer_seasonality),
    # Channels and activity
    "channel_configs": _booked(channels.channel_configs),
    "sync_logs": _booked(channels.sync_logs, page=2),
    "failed_syncs": _booked(channels.failed_syncs, as_of=LOGS_AS_OF),
    "sync_stats": _booked(channels.sync_stats, as_of=LOGS_AS_OF),
    "sync_stats_all": _booked(channels.sync_stats, as_of=LOGS_AS_OF, period=None),
    "activity_log": _booked(dashboard.activity_log, as_of=AS_OF),
    "sync_run_summary": lambda src: channels.sync_run_summary(_log_rows(src)),
    # Jobs and rules
    "admit_bookings": _admit,
    "cancel_bookings": lambda src: changes.cancel_bookings(
        src.cancel_requests(), src.tables(), CANCEL_AS_OF
    ),
    "cancel_bookings_applied": _applied_cancellations,
    "apply_status_changes": _status_after_changes,
    "upsert_customers": _upsert,
    "guests_without_email": lambda src: changes.guests_without_email(
        src.incoming_customers()
    ).select("request_id", "received_at", "email"),
    "deletable_customers": lambda src: changes.deletable_customers(src.tables()).select(
        "id", "email"
    ),
    "deletable_rooms": lambda src: changes.deletable_rooms(src.tables()).select(
        "id", "room_number"
    ),
    "deletable_rooms_cascade": _cascade,
    "deletable_currencies": lambda src: changes.deletable_currencies(src.tables()).select(
        "id", "code"
    ),
    "deletable_languages": lambda src: changes.deletable_languages(src.tables()).select(
        "id", "code"
    ),
    "quality_report": lambda src: quality.quality_overview(
        src.tables(), booking_requests=src.booking_requests()
    ),
    "quality_report_bookings": _row_violations,
    "uniqueness_violations": _booked(quality.uniqueness_violations),
    "orphan_rows": _booked(quality.orphan_rows),
    "set_single_flag": _primary_images,
    "set_single_flag_violations": lambda src: changes.flag_violations(
        src.room_images(), "is_primary", "room_id"
    ),
    "append_room_images": lambda src: changes.append_room_images(
        src.tables(), src.new_images()
    ),
    "request_rate": lambda src: channels.request_rate(src.access_log(), limit=1),
    "sync_health_stream": lambda src: channels.sync_health(src.ota_sync_logs()),
}


def run(name: str, spark: SparkSession, path: str) -> DataFrame:
    return plain(_QUERIES[name](StarSource(spark, path)))


def queries() -> dict[str, Query]:
    def bound(name: str) -> Query:
        return lambda spark, path: run(name, spark, path)

    return {name: bound(name) for name in _QUERIES}
