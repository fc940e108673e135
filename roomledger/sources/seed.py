"""Default rows of the small reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.sources.schema import schema_of

# The rows a fresh installation starts with.
CATEGORIES = (
    ("Standard Single", "Comfortable single room for one guest"),
    ("Standard Double", "Spacious double room for two guests"),
    ("Deluxe", "Premium room with enhanced amenities"),
    ("Suite", "Luxurious suite with separate living area"),
    ("Presidential", "Top-tier luxury accommodation"),
)
AMENITIES = (
    ("WiFi", "wifi", "Complimentary high-speed internet"),
    ("Air Conditioning", "ac", "Climate control system"),
    ("TV", "tv", "Flat-screen television"),
    ("Mini Bar", "minibar", "Stocked mini refrigerator"),
    ("Room Service", "room-service", "24/7 room service available"),
    ("Balcony", "balcony", "Private balcony with view"),
    ("Jacuzzi", "jacuzzi", "Private jacuzzi in room"),
    ("Safe", "safe", "In-room safety deposit box"),
    ("Parking", "parking", "Free parking space"),
    ("Gym Access", "gym", "Access to fitness center"),
)
CURRENCIES = (
    ("USD", "US Dollar", "$", True),
    ("EUR", "Euro", "€", False),
    ("GBP", "British Pound", "£", False),
    ("JPY", "Japanese Yen", "¥", False),
)
LANGUAGES = (
    ("en", "English", "English", True),
    ("es", "Spanish", "Español", False),
    ("fr", "French", "Français", False),
    ("de", "German", "Deutsch", False),
)
SETTINGS = (
    ("hotel_name", "Grand Hotel", "string", "Hotel name"),
    ("hotel_email", "info@grandhotel.com", "string", "Hotel contact email"),
    ("hotel_phone", "+1-555-0123", "string", "Hotel contact phone"),
    ("hotel_address", "123 Main Street, City, Country", "string", "Hotel address"),
    ("check_in_time", "15:00", "string", "Standard check-in time"),
    ("check_out_time", "11:00", "string", "Standard check-out time"),
    ("tax_rate", "0.10", "number", "Tax rate (10%)"),
    ("cancellation_hours", "24", "number", "Free cancellation hours before check-in"),
    ("max_advance_booking_days", "365", "number", "Maximum days in advance for booking"),
)

_SEEDED = {
    "room_categories": (("name", "description"), CATEGORIES),
    "amenities": (("name", "icon", "description"), AMENITIES),
    "currencies": (("code", "name", "symbol", "is_default"), CURRENCIES),
    "languages": (("code", "name", "native_name", "is_default"), LANGUAGES),
    "settings": (("setting_key", "setting_value", "data_type", "description"), SETTINGS),
}


def seed_dims(spark: SparkSession) -> dict[str, DataFrame]:
    """The seeded tables in their declared schemas, ids counted from 1."""
    seeded = {}
    for table, (names, rows) in _SEEDED.items():
        numbered = [(i, *row) for i, row in enumerate(rows, start=1)]
        df = spark.createDataFrame(numbered, ["id", *names])
        defaults = {"is_active": F.lit(True), "exchange_rate": F.lit("1.0000")}
        seeded[table] = df.select(
            *[
                (
                    F.col(f.name)
                    if f.name in df.columns
                    else defaults.get(f.name, F.lit(None))
                )
                .cast(f.dataType)
                .alias(f.name)
                for f in schema_of(table).fields
            ]
        )
    return seeded
