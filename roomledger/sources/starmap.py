"""Lodging tables derived from a star-schema parquet directory.

Parts become rooms, orders become bookings, customers become guests, and the
event table becomes channel logs, settings and job inputs. Every derived
table scans its source whole, so the work of a query grows with the data. The
derivations are SQL expressions, one per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomledger.sources.schema import schema_of
from roomledger.sources.seed import AMENITIES, CATEGORIES, LANGUAGES, SETTINGS
from roomledger.sources.tables import Tables

# Columns read from each file; declared, so that planning reads no footer.
_FILES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "documents": "lang string",
    "events": """event_id bigint, ts timestamp_ntz, user_id bigint, event_type string,
        value double, props string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_returnflag string, l_shipdate timestamp_ntz""",
    "nation": "n_nationkey int, n_name string",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string,
        o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string""",
    "part": """p_partkey bigint, p_name string, p_brand string, p_type string,
        p_size int, p_retailprice double""",
    "supplier": "s_suppkey bigint, s_name string",
}

CHANNELS = ("Booking.com", "Agoda", "Airbnb", "Expedia", "Direct")


def _list(values) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"array({quoted})"


def _pick(values, position: str) -> str:
    """``values[position]`` counted from 1; null outside the list."""
    return f"try_element_at({_list(values)}, CAST({position} AS INT))"


def _day_plus(start: str, days: str) -> str:
    return f"date_add(DATE '{start}', CAST({days} AS INT))"


def _shaped(df: DataFrame, table: str, **columns: str) -> DataFrame:
    """Declared columns in order and typed, by their expressions; the rest null."""
    return df.selectExpr(
        *[
            f"CAST({columns.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in schema_of(table).fields
        ]
    )


class StarSource:
    """Reads the star-schema files and derives the lodging tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(_FILES[name]).parquet(f"{self.path}/{name}.parquet")

    # Tables ---------------------------------------------------------------

    def rooms(self) -> DataFrame:
        return _shaped(
            self.raw("part"),
            "rooms",
            id="p_partkey",
            room_number="concat('R', p_partkey)",
            room_name="p_name",
            description="p_brand",
            # Any other kind leaves the room without a category.
            room_category_id="""CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'SMALL' THEN 2
                WHEN 'MEDIUM' THEN 3 WHEN 'LARGE' THEN 4 WHEN 'PROMO' THEN 5 END""",
            price_per_night="p_retailprice",
            max_occupancy="1 + p_size % 6",
            room_size="p_size",
            is_active="p_partkey % 10 <> 9",
            created_at=_day_plus("1995-01-01", "p_partkey % 97"),
            updated_at=_day_plus("2001-06-15", "-(p_partkey % 30)"),
        )

    def room_categories(self) -> DataFrame:
        found = self.rooms().where("room_category_id IS NOT NULL").select("room_category_id")
        return _shaped(
            found.distinct(),
            "room_categories",
            id="room_category_id",
            name=_pick([c[0] for c in CATEGORIES], "room_category_id"),
            description=_pick([c[1] for c in CATEGORIES], "room_category_id"),
        )

    def amenities(self) -> DataFrame:
        return _shaped(
            self.raw("supplier").selectExpr("s_suppkey % 10 + 1 AS k").distinct(),
            "amenities",
            id="k",
            name=_pick([a[0] for a in AMENITIES], "k"),
            icon=_pick([a[1] for a in AMENITIES], "k"),
            description=_pick([a[2] for a in AMENITIES], "k"),
        )

    def room_amenities(self) -> DataFrame:
        return _shaped(
            self.raw("lineitem"),
            "room_amenities",
            room_id="l_partkey",
            amenity_id="l_suppkey % 10 + 1",
        ).distinct()

    def room_images(self) -> DataFrame:
        numbers = "CASE WHEN p_partkey % 7 > 0 THEN sequence(1, least(p_partkey % 7, 3)) END"
        return _shaped(
            self.raw("part").selectExpr("p_partkey", f"explode({numbers}) AS i"),
            "room_images",
            id="p_partkey * 3 + i",
            room_id="p_partkey",
            image_path="concat_ws('-', 'room', p_partkey, i)",
            is_primary="i = p_partkey % 3 + 1",
            display_order="i",
        )

    def customers(self) -> DataFrame:
        seen = _day_plus("1995-01-01", "c_custkey * 37 % 2400")
        joined = self.raw("customer").join(
            self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        return _shaped(
            joined,
            "customers",
            id="c_custkey",
            first_name="c_mktsegment",
            last_name="substring(c_name, 10, 9)",
            email="concat('guest', c_custkey, '@example.com')",
            phone="concat('+1555', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))",
            country="CASE c_custkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE n_name END",
            created_at=seen,
            updated_at=seen,
        )

    def bookings(self) -> DataFrame:
        rooms = self.raw("part").agg(F.count(F.lit(1))).scalar()
        placed = "CAST(o_orderdate AS DATE)"
        arrival = f"date_add({placed}, CAST(o_orderkey % 60 AS INT))"
        return _shaped(
            self.raw("orders").withColumn("rooms", rooms),
            "bookings",
            id="o_orderkey",
            booking_reference="concat('BK', o_orderkey)",
            # Guests with a key divisible by 25 never book; a few bookings
            # lost their guest or their room.
            customer_id="""CASE WHEN o_orderkey % 97 <> 0
                THEN o_custkey + CASE WHEN o_custkey % 25 = 0 THEN 1 ELSE 0 END END""",
            room_id="CASE WHEN o_orderkey % 89 <> 0 THEN o_orderkey * 7919 % (rooms - 1) END",
            check_in_date=arrival,
            # A few stays end before they begin.
            check_out_date=f"""date_add({arrival}, CAST(CASE WHEN o_orderkey % 211 = 0 THEN -3
                ELSE o_orderkey * 31 % 11 END AS INT))""",
            adults="o_orderkey % 3 + 1",
            children="CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 4 END",
            total_amount="o_totalprice",
            booking_status="""CASE WHEN o_orderkey % 10 IN (3, 7) THEN 'cancelled'
                WHEN o_orderkey % 23 = 5 THEN 'no_show'
                WHEN o_orderstatus = 'F' THEN 'completed'
                WHEN o_orderstatus = 'O' THEN 'confirmed' ELSE 'pending' END""",
            source="""CASE left(o_orderpriority, 1) WHEN '1' THEN 'direct'
                WHEN '2' THEN 'booking_com' WHEN '3' THEN 'agoda'
                WHEN '4' THEN 'airbnb' ELSE 'expedia' END""",
            created_at="o_orderdate",
            updated_at=f"date_add({placed}, CAST(o_orderkey * 17 % 61 AS INT))",
        )

    def ota_configurations(self) -> DataFrame:
        return _shaped(
            self.raw("supplier").selectExpr("s_suppkey % 5 + 1 AS k").distinct(),
            "ota_configurations",
            id="k",
            ota_name=_pick(CHANNELS, "k"),
            api_username="concat('user', k)",
            endpoint_url="concat('https://channel', k, '.example.com')",
            hotel_id="concat('H', k)",
            is_active="k <> 4",
            sync_frequency="60",
            created_at=_day_plus("2024-01-01", "-k"),
        )

    def ota_sync_logs(self) -> DataFrame:
        kinds = ("availability", "rates", "inventory", "bookings")
        return _shaped(
            self.raw("events"),
            "ota_sync_logs",
            id="event_id",
            ota_configuration_id="user_id % 4 + 1",
            sync_type=_pick(kinds, "event_id % 4 + 1"),
            status="""CASE event_type WHEN 'error' THEN 'failed'
                WHEN 'signup' THEN 'partial' ELSE 'success' END""",
            sync_started_at="ts",
            sync_completed_at="ts + make_dt_interval(0, 0, CAST(event_id % 7 AS INT))",
            records_processed="floor(value)",
        )

    def settings(self) -> DataFrame:
        kind = _pick(("number", "boolean", "json", "string"), "event_id % 4 + 1")
        flag = _pick(("true", "TRUE", "false"), "event_id % 3 + 1")
        value = f"""CASE event_id % 4
            WHEN 0 THEN concat(CAST(CAST(value AS DECIMAL(10,2)) AS STRING),
                               CASE WHEN event_id % 3 = 0 THEN 'abc' ELSE '' END)
            WHEN 1 THEN {flag}
            WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN '{{broken' ELSE props END
            ELSE event_type END"""

        # The first rows are the nine default settings.
        def default(position: int) -> str:
            return _pick([row[position] for row in SETTINGS], "event_id + 1")

        return _shaped(
            self.raw("events"),
            "settings",
            id="event_id + 1",
            setting_key=f"coalesce({default(0)}, concat('pref_', event_id))",
            setting_value=f"coalesce({default(1)}, {value})",
            data_type=f"coalesce({default(2)}, {kind})",
            description=default(3),
        )

    def currencies(self) -> DataFrame:
        per_nation = (
            self.raw("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("guests"))
        )
        named = per_nation.join(
            self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        return _shaped(
            named,
            "currencies",
            id="n_nationkey + 1",
            code="upper(left(n_name, 3))",
            name="n_name",
            exchange_rate="guests",
            is_default="n_nationkey = 0",
            is_active="true",
        )

    def languages(self) -> DataFrame:
        number = f"array_position({_list([row[0] for row in LANGUAGES])}, lang)"
        return _shaped(
            self.raw("documents").select("lang").distinct().selectExpr("lang", f"{number} AS k"),
            "languages",
            id="k",
            code="lang",
            name=_pick([row[1] for row in LANGUAGES], "nullif(k, 0)"),
            native_name=_pick([row[2] for row in LANGUAGES], "nullif(k, 0)"),
            is_default="lang = 'en'",
            is_active="true",
        )

    def users(self) -> DataFrame:
        username = "lower(replace(s_name, '#', '_'))"
        roles = ("admin", "manager", "staff", "staff", "owner")
        return _shaped(
            self.raw("supplier"),
            "users",
            id="s_suppkey + 1",
            username=username,
            email=f"concat({username}, '@example.com')",
            first_name="'Staff'",
            last_name="substring(s_name, 10, 9)",
            role=_pick(roles, "s_suppkey % 5 + 1"),
            is_active="s_suppkey % 4 <> 3",
            created_at=_day_plus("1999-01-01", "s_suppkey % 97"),
        )

    def room_availability(self) -> DataFrame:
        return _shaped(
            self.raw("lineitem"),
            "room_availability",
            id="l_orderkey * 8 + l_linenumber",
            # Some nights belong to rooms that no longer exist.
            room_id="l_partkey + CASE WHEN l_orderkey % 101 = 0 THEN 1000000000 ELSE 0 END",
            date="l_shipdate",
            is_available="l_returnflag <> 'R'",
            min_stay="1",
            max_stay="30",
        )

    def tables(self) -> Tables:
        return Tables(lambda name: getattr(self, name)())

    # Job inputs -----------------------------------------------------------

    def booking_requests(self) -> DataFrame:
        """Every booking asked for again, on one room in ten; some fields are missing."""
        return self.bookings().selectExpr(
            "id AS request_id",
            "created_at AS requested_at",
            """CASE WHEN id % 101 = 0 THEN room_id + 1000000000
                    ELSE room_id - room_id % 10 END AS room_id""",
            "CASE WHEN id % 503 <> 0 THEN check_in_date END AS check_in_date",
            "CASE WHEN id % 509 <> 0 THEN check_out_date END AS check_out_date",
            "CASE WHEN id % 521 <> 0 THEN adults END AS adults",
            "children",
            "CASE WHEN id % 83 = 0 THEN 'G' ELSE 'Guest' END AS first_name",
            "CASE WHEN id % 79 <> 0 THEN concat('No ', id) END AS last_name",
            "concat('guest', id % 997, '@example.com') AS email",
            "CASE WHEN id % 73 = 0 THEN '12' ELSE '+15550100' END AS phone",
            "repeat('x', CAST(id % 506 AS INT)) AS special_requests",
        )

    def stays_asked(self) -> DataFrame:
        """For every day on which a booking begins, the longest stay that begins then."""
        held = self.bookings().where("check_in_date < check_out_date")
        return held.groupBy("check_in_date").agg(
            F.max("check_out_date").alias("check_out_date"), F.max("adults").alias("guests")
        ).selectExpr("CAST(date_diff(check_in_date, DATE '1970-01-01') AS BIGINT) AS request_id", "*")

    def cancel_requests(self) -> DataFrame:
        """Every order asks to cancel; neighbours ask for the same booking."""
        return self.raw("orders").selectExpr(
            "o_orderkey AS request_id",
            "o_orderdate AS requested_at",
            """CASE WHEN o_orderkey % 97 = 0 THEN concat('NONE', o_orderkey)
                    WHEN o_orderkey % 89 <> 0 THEN concat('BK', o_orderkey - o_orderkey % 2)
               END AS booking_reference""",
        )

    def status_changes(self) -> DataFrame:
        """A change feed with repeats, unknown bookings and a bad status."""
        return self.raw("events").selectExpr(
            "event_id AS change_id",
            """user_id * 7 + event_id % 5
               + CASE WHEN event_id % 97 = 0 THEN 1000000000 ELSE 0 END AS booking_id""",
            """CASE WHEN event_id % 50 = 49 THEN 'archived'
                    WHEN event_type = 'view' THEN 'pending'
                    WHEN event_type = 'click' THEN 'confirmed'
                    WHEN event_type = 'purchase' THEN 'completed'
                    WHEN event_type = 'error' THEN 'cancelled' ELSE 'no_show' END AS status""",
            "ts AS changed_at",
        )

    def incoming_customers(self) -> DataFrame:
        """Guest details as typed in: known e-mails in capitals, new ones too."""
        return self.raw("orders").selectExpr(
            "o_orderkey AS request_id",
            "o_orderdate AS received_at",
            """CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 67 = 0 THEN ' '
                    WHEN o_orderkey % 3 = 0 THEN concat('New', o_custkey, '@example.com')
                    ELSE concat('GUEST', o_custkey, '@EXAMPLE.COM') END AS email""",
            "o_orderpriority AS first_name",
            "concat('Guest ', o_custkey) AS last_name",
            "concat('+1444', lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')) AS phone",
            "CAST(NULL AS STRING) AS address",
            "CAST(NULL AS STRING) AS city",
            "'FRANCE' AS country",
            "CAST(NULL AS STRING) AS postal_code",
        )

    def new_images(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS id", "user_id AS room_id", "concat('new-', event_id) AS image_path"
        )

    def deliveries(self) -> DataFrame:
        """Outcome of every channel call: one per log row."""
        return self.ota_sync_logs().selectExpr(
            "id AS delivery_id",
            "ota_configuration_id",
            "status <> 'failed' AS delivered",
            "sync_started_at AS started_at",
            "sync_completed_at AS completed_at",
        )

    def access_log(self) -> DataFrame:
        return self.raw("events").selectExpr("user_id AS client_id", "ts")
