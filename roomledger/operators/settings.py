"""Typed settings, hotel data, currencies, languages and the staff list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.sources.tables import Tables

# The settings that make up the public hotel record.
HOTEL_KEYS = (
    "hotel_name",
    "hotel_email",
    "hotel_phone",
    "hotel_address",
    "check_in_time",
    "check_out_time",
)

# The longest leading decimal number of a text, blanks before it allowed.
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def settings_typed(t: Tables) -> DataFrame:
    """Each setting with its value in the column of its type.

    A number is the numeric prefix of the text, a boolean is true only for
    the text ``true``, and text that is not valid json stays text.
    """
    text, kind = F.col("setting_value"), F.col("data_type")
    number = F.regexp_extract(text, NUMBER_PREFIX, 1).try_cast("double")
    # Sorted by key first: the sort samples its input, which is then still a
    # plain scan. The json text is parsed once, and only where it is declared.
    parsed = t.settings.orderBy("setting_key").withColumn(
        "_json", F.when(kind == "json", F.try_parse_json(text))
    )
    typed_elsewhere = F.coalesce(kind.isin("number", "boolean"), F.lit(False))
    return parsed.select(
        "setting_key",
        "data_type",
        "description",
        F.when(kind == "number", number).alias("number_value"),
        F.when(kind == "boolean", F.coalesce(text == "true", F.lit(False))).alias("boolean_value"),
        F.col("_json").alias("json_value"),
        F.when(~typed_elsewhere & F.col("_json").isNull(), text).alias("string_value"),
    )


def hotel_info(t: Tables) -> DataFrame:
    """The six public hotel settings as one record."""
    chosen = t.settings.where(F.col("setting_key").isin(*HOTEL_KEYS))
    return chosen.agg(
        *[
            F.max(F.when(F.col("setting_key") == key, F.col("setting_value"))).alias(key)
            for key in HOTEL_KEYS
        ]
    )


def currencies_list(t: Tables) -> DataFrame:
    return t.currencies.orderBy(F.desc("is_default"), F.asc("name"), F.asc("id"))


def languages_list(t: Tables) -> DataFrame:
    return t.languages.orderBy(F.desc("is_default"), F.asc("name"), F.asc("id"))


def staff_directory(t: Tables) -> DataFrame:
    return t.users.select(
        "id",
        "username",
        "email",
        "first_name",
        "last_name",
        "role",
        "phone",
        "is_active",
        "created_at",
    ).orderBy(F.desc("created_at"), F.desc("id"))
