"""Row rules, unique keys and references of the lodging tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from roomledger.sources import schema
from roomledger.sources.layout import parts_of
from roomledger.sources.tables import Tables

# The patterns of the text rules. The phone rule stands for the
# numbering plans of all countries.
USERNAME = r"^[a-zA-Z0-9_]+$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s.]{2,}$"
PHONE = r"^\+?[0-9]{7,15}$"

Rules = list[tuple[str, Column]]


def _length(name: str, low: int, high: int, required: bool = True) -> Column:
    outside = ~F.length(name).between(low, high)
    return F.coalesce(outside, F.lit(required))


def _pattern(name: str, pattern: str, required: bool = True) -> Column:
    return F.coalesce(~F.col(name).rlike(pattern), F.lit(required))


def _range(name: str, low: int, high: int | None = None, required: bool = True) -> Column:
    value = F.col(name)
    outside = value < low if high is None else ~value.between(low, high)
    return F.coalesce(outside, F.lit(required))


def _domain(name: str, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(~F.col(name).isin(*allowed), F.lit(False))


def _iso_date(name: str) -> Column:
    return F.col(name).cast("string").try_cast("date").isNull()


# Each rule: a name and the condition under which a row breaks it. Lengths,
# ranges and domains are fixed values of the data model.


def _user_rules() -> Rules:
    return [
        ("username_length", _length("username", 3, 50)),
        ("username_pattern", _pattern("username", USERNAME)),
        ("email_format", _pattern("email", EMAIL)),
        ("first_name_length", _length("first_name", 2, 100)),
        ("last_name_length", _length("last_name", 2, 100)),
        ("role_domain", _domain("role", schema.USER_ROLES)),
    ]


def _room_rules() -> Rules:
    return [
        ("room_number_length", _length("room_number", 1, 20)),
        ("room_name_length", _length("room_name", 1, 100)),
        ("description_length", _length("description", 0, 1000, required=False)),
        ("room_category_id_range", _range("room_category_id", 1)),
        ("price_per_night_range", _range("price_per_night", 0)),
        ("max_occupancy_range", _range("max_occupancy", 1, 20)),
        ("room_size_range", _range("room_size", 0, required=False)),
        ("bed_type_length", _length("bed_type", 0, 50, required=False)),
        ("cancellation_policy_length", _length("cancellation_policy", 0, 1000, required=False)),
    ]


def _stay_rules() -> Rules:
    return [
        ("check_in_date_format", _iso_date("check_in_date")),
        ("check_out_date_format", _iso_date("check_out_date")),
        (
            "check_out_after_check_in",
            F.coalesce(F.col("check_out_date") <= F.col("check_in_date"), F.lit(False)),
        ),
        ("adults_range", _range("adults", 1, 20)),
        ("children_range", _range("children", 0, 20, required=False)),
    ]


def _booking_rules() -> Rules:
    return [
        ("room_id_range", _range("room_id", 1)),
        *_stay_rules(),
        ("special_requests_length", _length("special_requests", 0, 500, required=False)),
        ("booking_status_domain", _domain("booking_status", schema.BOOKING_STATUSES)),
        ("payment_status_domain", _domain("payment_status", schema.PAYMENT_STATUSES)),
        ("source_domain", _domain("source", schema.BOOKING_SOURCES)),
    ]


def _request_rules() -> Rules:
    return [
        ("room_id_range", _range("room_id", 1)),
        *_stay_rules(),
        ("first_name_length", _length("first_name", 2, 100)),
        ("last_name_length", _length("last_name", 2, 100)),
        ("email_format", _pattern("email", EMAIL)),
        ("phone_format", _pattern("phone", PHONE, required=False)),
        ("special_requests_length", _length("special_requests", 0, 500, required=False)),
    ]


def _present(*names: str) -> Rules:
    return [(f"{n}_present", F.coalesce(F.trim(n) == "", F.lit(True))) for n in names]


def _channel_rules() -> Rules:
    return _present("ota_name", "endpoint_url")


def _coded_rules() -> Rules:
    return _present("code", "name")


def _customer_rules() -> Rules:
    return [
        ("first_name_length", _length("first_name", 2, 100)),
        ("last_name_length", _length("last_name", 2, 100)),
        ("email_format", _pattern("email", EMAIL)),
        ("phone_format", _pattern("phone", PHONE, required=False)),
        ("address_length", _length("address", 0, 500, required=False)),
        ("city_length", _length("city", 0, 100, required=False)),
        ("country_length", _length("country", 0, 100, required=False)),
        ("postal_code_length", _length("postal_code", 0, 20, required=False)),
    ]


def _log_rules() -> Rules:
    return [
        ("sync_type_domain", _domain("sync_type", schema.SYNC_TYPES)),
        ("status_domain", _domain("status", schema.SYNC_STATUSES)),
    ]


def _setting_rules() -> Rules:
    number = F.col("setting_value").rlike(r"^\s*[+-]?(\d|\.\d)")
    return [
        ("setting_key_present", _length("setting_key", 1, 100)),
        ("setting_value_present", F.col("setting_value").isNull()),
        ("data_type_domain", _domain("data_type", schema.SETTING_TYPES)),
        (
            "number_value",
            F.coalesce((F.col("data_type") == "number") & ~number, F.lit(False)),
        ),
    ]


_RULES = {
    "users": _user_rules,
    "rooms": _room_rules,
    "bookings": _booking_rules,
    "booking_requests": _request_rules,
    "customers": _customer_rules,
    "ota_sync_logs": _log_rules,
    "ota_configurations": _channel_rules,
    "currencies": _coded_rules,
    "languages": _coded_rules,
    "settings": _setting_rules,
}

CHECKED_TABLES = tuple(_RULES)


def quality_report(df: DataFrame, table: str) -> DataFrame:
    """Rows with the array ``violations`` of the rules they break."""
    broken = F.array(*[F.when(bad, F.lit(name)) for name, bad in _RULES[table]()])
    return df.withColumn("violations", F.array_compact(broken))


def quality_counts(df: DataFrame, table: str) -> DataFrame:
    """Rows that break each rule of a table, in one pass without exploding."""
    rules = _RULES[table]()
    counted = df.agg(*[F.count(F.when(bad, 1)).alias(name) for name, bad in rules])
    names = [name for name, _ in rules]
    long = counted.unpivot([], names, "rule", "row_count")
    return long.select(F.lit(table).alias("table_name"), "rule", "row_count")


def _union(parts: list[DataFrame]) -> DataFrame:
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total


def quality_overview(t: Tables, **extra: DataFrame) -> DataFrame:
    """``quality_counts`` of every checked table, extra inputs by name."""
    known = {**dict(t.items()), **extra}
    return _union([quality_counts(known[n], n) for n in CHECKED_TABLES if n in known])


def _coded(names: list[str]) -> Column:
    """The name a row's small ``code`` stands for."""
    return F.element_at(F.array(*[F.lit(name) for name in names]), F.col("code") + 1)


def uniqueness_violations(t: Tables) -> DataFrame:
    """Keys that occur more than once; text compares without case.

    Nearly all keys are unique, so folding them in the map tasks would only hold them in
    memory. The keys of all tables share one exchange in a given number of partitions:
    chosen by compressed bytes, a partition would hold millions of keys.
    """
    known = dict(t.items())
    keys = []
    for code, (table, key) in enumerate(schema.UNIQUE_KEYS):
        df = known[table].dropna(subset=list(key))
        text = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
        values = [(F.lower(c) if c in text else F.col(c)).cast("string") for c in key]
        keys.append(df.select(F.lit(code).alias("code"), F.array(*values).alias("key")))
    spread = _union(keys).repartition(parts_of(keys[0].sparkSession), "code", "key")
    counted = spread.groupBy("code", "key").agg(F.count(F.lit(1)).alias("row_count"))
    return counted.where("row_count > 1").select(
        _coded([table for table, _ in schema.UNIQUE_KEYS]).alias("table_name"),
        _coded(["+".join(key) for _, key in schema.UNIQUE_KEYS]).alias("key_name"),
        F.array_join("key", "+").alias("key_value"),
        "row_count",
    )


def orphan_rows(t: Tables) -> DataFrame:
    """References to missing parents; an unset reference is allowed.

    Children fold to one row per reference first, so a missing parent with
    many children is one row in the anti join. All references share that one
    join, told apart by a code.
    """
    known = dict(t.items())
    used, held = [], []
    for code, (child, column, parent) in enumerate(schema.REFERENCES):
        marked = F.lit(code).alias("code")
        reference = F.col(column).cast("bigint").alias("missing_id")
        used.append(known[child].where(F.col(column).isNotNull()).select(marked, reference))
        held.append(known[parent].select(marked, F.col("id").cast("bigint").alias("missing_id")))
    counted = _union(used).groupBy("code", "missing_id").agg(F.count(F.lit(1)).alias("row_count"))
    orphans = counted.join(_union(held), ["code", "missing_id"], "left_anti")
    return orphans.select(
        _coded([child for child, _, _ in schema.REFERENCES]).alias("table_name"),
        _coded([column for _, column, _ in schema.REFERENCES]).alias("column_name"),
        "missing_id",
        "row_count",
    )
