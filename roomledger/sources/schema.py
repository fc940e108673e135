"""Schemas and value domains of the lodging tables.

Ids are ``bigint``: a booking table at cluster scale outgrows 32 bits.
Password hashes and channel secrets are not part of any schema, so a scan
never reads them.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

# The domains of the enumerated columns.
BOOKING_STATUSES = ("pending", "confirmed", "cancelled", "completed", "no_show")
PAYMENT_STATUSES = ("pending", "paid", "refunded")
BOOKING_SOURCES = ("direct", "booking_com", "agoda", "airbnb", "expedia", "other")
SYNC_TYPES = ("availability", "rates", "inventory", "bookings")
SYNC_STATUSES = ("success", "failed", "partial")
SETTING_TYPES = ("string", "number", "boolean", "json")
USER_ROLES = ("admin", "manager", "staff")

_DDL = {
    "users": """
        id bigint, username string, email string, first_name string,
        last_name string, role string, phone string, is_active boolean,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "room_categories": """
        id int, name string, description string,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "amenities": """
        id int, name string, icon string, description string,
        created_at timestamp_ntz""",
    "rooms": """
        id bigint, room_number string, room_name string, description string,
        room_category_id int, price_per_night decimal(10,2), max_occupancy int,
        room_size decimal(8,2), bed_type string, cancellation_policy string,
        is_active boolean, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "room_images": """
        id bigint, room_id bigint, image_path string, image_alt string,
        is_primary boolean, display_order int, created_at timestamp_ntz""",
    "room_amenities": "room_id bigint, amenity_id int",
    "customers": """
        id bigint, first_name string, last_name string, email string,
        phone string, address string, city string, country string,
        postal_code string, date_of_birth date,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "bookings": """
        id bigint, booking_reference string, customer_id bigint, room_id bigint,
        check_in_date date, check_out_date date, adults int, children int,
        total_amount decimal(10,2), booking_status string, payment_status string,
        special_requests string, source string,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "room_availability": """
        id bigint, room_id bigint, date date, is_available boolean,
        price_override decimal(10,2), min_stay int, max_stay int,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "ota_configurations": """
        id bigint, ota_name string, api_username string, endpoint_url string,
        hotel_id string, is_active boolean, last_sync_at timestamp_ntz,
        sync_frequency int, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "ota_sync_logs": """
        id bigint, ota_configuration_id bigint, sync_type string, status string,
        message string, sync_started_at timestamp_ntz,
        sync_completed_at timestamp_ntz, records_processed int""",
    "settings": """
        id bigint, setting_key string, setting_value string, data_type string,
        description string, created_at timestamp_ntz, updated_at timestamp_ntz""",
    "currencies": """
        id bigint, code string, name string, symbol string,
        exchange_rate decimal(10,4), is_default boolean, is_active boolean,
        created_at timestamp_ntz, updated_at timestamp_ntz""",
    "languages": """
        id bigint, code string, name string, native_name string,
        is_default boolean, is_active boolean, created_at timestamp_ntz""",
}

TABLE_NAMES = tuple(_DDL)


def schema_of(table: str) -> StructType:
    """The declared schema of one table."""
    return StructType.fromDDL(_DDL[table])


# Child column -> parent table, for every declared reference.
REFERENCES = (
    ("rooms", "room_category_id", "room_categories"),
    ("room_images", "room_id", "rooms"),
    ("room_amenities", "room_id", "rooms"),
    ("room_amenities", "amenity_id", "amenities"),
    ("bookings", "customer_id", "customers"),
    ("bookings", "room_id", "rooms"),
    ("room_availability", "room_id", "rooms"),
    ("ota_sync_logs", "ota_configuration_id", "ota_configurations"),
)

# Table -> keys that must be unique; text keys compare without case.
UNIQUE_KEYS = (
    ("users", ("username",)),
    ("users", ("email",)),
    ("rooms", ("room_number",)),
    ("room_amenities", ("room_id", "amenity_id")),
    ("customers", ("email",)),
    ("bookings", ("booking_reference",)),
    ("room_availability", ("room_id", "date")),
    ("ota_configurations", ("ota_name",)),
    ("settings", ("setting_key",)),
    ("currencies", ("code",)),
    ("languages", ("code",)),
)
