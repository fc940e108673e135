"""The lodging tables as common table expressions over the star schema."""

from __future__ import annotations

from roomledger.sources.seed import AMENITIES, CATEGORIES, LANGUAGES, SETTINGS
from roomledger.sources.starmap import CHANNELS


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _column(rows, position: int) -> str:
    return _list([row[position] for row in rows])


# Name -> (tables it reads, query).
_TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "rooms": (
        (),
        """
  SELECT p_partkey AS id, 'R' || p_partkey AS room_number, p_name AS room_name,
         p_brand AS description,
         CASE p_type WHEN 'STANDARD' THEN 1 WHEN 'SMALL' THEN 2 WHEN 'MEDIUM' THEN 3
                     WHEN 'LARGE' THEN 4 WHEN 'PROMO' THEN 5 END AS room_category_id,
         CAST(p_retailprice AS DECIMAL(10,2)) AS price_per_night,
         1 + p_size % 6 AS max_occupancy,
         CAST(p_size AS DECIMAL(8,2)) AS room_size,
         CAST(NULL AS VARCHAR) AS bed_type, CAST(NULL AS VARCHAR) AS cancellation_policy,
         p_partkey % 10 <> 9 AS is_active,
         CAST(DATE '1995-01-01' + CAST(p_partkey % 97 AS INTEGER) AS TIMESTAMP) AS created_at,
         CAST(DATE '2001-06-15' - CAST(p_partkey % 30 AS INTEGER) AS TIMESTAMP) AS updated_at
  FROM part""",
    ),
    "room_categories": (
        ("rooms",),
        f"""
  SELECT DISTINCT room_category_id AS id,
         ({_column(CATEGORIES, 0)})[room_category_id] AS name,
         ({_column(CATEGORIES, 1)})[room_category_id] AS description,
         CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS updated_at
  FROM rooms WHERE room_category_id IS NOT NULL""",
    ),
    "amenities": (
        (),
        f"""
  SELECT CAST(k AS INTEGER) AS id, ({_column(AMENITIES, 0)})[k] AS name,
         ({_column(AMENITIES, 1)})[k] AS icon, ({_column(AMENITIES, 2)})[k] AS description,
         CAST(NULL AS TIMESTAMP) AS created_at
  FROM (SELECT DISTINCT s_suppkey % 10 + 1 AS k FROM supplier)""",
    ),
    "room_amenities": (
        (),
        """
  SELECT DISTINCT l_partkey AS room_id, CAST(l_suppkey % 10 + 1 AS INTEGER) AS amenity_id
  FROM lineitem""",
    ),
    "room_images": (
        (),
        """
  SELECT p_partkey * 3 + i AS id, p_partkey AS room_id,
         'room-' || p_partkey || '-' || i AS image_path,
         i = p_partkey % 3 + 1 AS is_primary, CAST(i AS INTEGER) AS display_order
  FROM (SELECT p_partkey, unnest(range(1, least(p_partkey % 7, 3) + 1)) AS i FROM part)""",
    ),
    "customers": (
        (),
        """
  SELECT c_custkey AS id, c_mktsegment AS first_name, substring(c_name, 10, 9) AS last_name,
         'guest' || c_custkey || '@example.com' AS email,
         '+1555' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone,
         CAST(NULL AS VARCHAR) AS address, CAST(NULL AS VARCHAR) AS city,
         CASE c_custkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE n_name END AS country,
         CAST(NULL AS VARCHAR) AS postal_code, CAST(NULL AS DATE) AS date_of_birth,
         CAST(DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 AS INTEGER) AS TIMESTAMP) AS created_at,
         CAST(DATE '1995-01-01' + CAST(c_custkey * 37 % 2400 AS INTEGER) AS TIMESTAMP) AS updated_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "bookings": (
        (),
        """
  SELECT *, booking_status IN ('confirmed', 'completed') AS earned,
         booking_status IN ('pending', 'confirmed') AS is_open,
         CAST(check_out_date - check_in_date AS INTEGER) AS nights
  FROM (
    SELECT o_orderkey AS id, 'BK' || o_orderkey AS booking_reference,
           CASE WHEN o_orderkey % 97 <> 0
                THEN o_custkey + CASE WHEN o_custkey % 25 = 0 THEN 1 ELSE 0 END END AS customer_id,
           CASE WHEN o_orderkey % 89 <> 0
                THEN o_orderkey * 7919 % ((SELECT count(*) FROM part) - 1) END AS room_id,
           CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS check_in_date,
           CAST(o_orderdate AS DATE)
             + CAST(o_orderkey % 60 + CASE WHEN o_orderkey % 211 = 0 THEN -3
                                           ELSE o_orderkey * 31 % 11 END AS INTEGER) AS check_out_date,
           CAST(o_orderkey % 3 + 1 AS INTEGER) AS adults,
           CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 4 AS INTEGER) END AS children,
           CAST(o_totalprice AS DECIMAL(10,2)) AS total_amount,
           CASE WHEN o_orderkey % 10 IN (3, 7) THEN 'cancelled'
                WHEN o_orderkey % 23 = 5 THEN 'no_show'
                WHEN o_orderstatus = 'F' THEN 'completed'
                WHEN o_orderstatus = 'O' THEN 'confirmed' ELSE 'pending' END AS booking_status,
           CAST(NULL AS VARCHAR) AS payment_status, CAST(NULL AS VARCHAR) AS special_requests,
           CASE left(o_orderpriority, 1) WHEN '1' THEN 'direct' WHEN '2' THEN 'booking_com'
                WHEN '3' THEN 'agoda' WHEN '4' THEN 'airbnb' ELSE 'expedia' END AS source,
           o_orderdate AS created_at,
           CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey * 17 % 61 AS INTEGER)
                AS TIMESTAMP) AS updated_at
    FROM orders)""",
    ),
    "ota_configurations": (
        (),
        f"""
  SELECT k AS id, ({_list(CHANNELS)})[k] AS ota_name, 'user' || k AS api_username,
         'https://channel' || k || '.example.com' AS endpoint_url, 'H' || k AS hotel_id,
         k <> 4 AS is_active, CAST(NULL AS TIMESTAMP) AS last_sync_at,
         CAST(60 AS INTEGER) AS sync_frequency,
         CAST(DATE '2024-01-01' - CAST(k AS INTEGER) AS TIMESTAMP) AS created_at,
         CAST(NULL AS TIMESTAMP) AS updated_at
  FROM (SELECT DISTINCT s_suppkey % 5 + 1 AS k FROM supplier)""",
    ),
    "ota_sync_logs": (
        (),
        """
  SELECT event_id AS id, user_id % 4 + 1 AS ota_configuration_id,
         (['availability', 'rates', 'inventory', 'bookings'])[event_id % 4 + 1] AS sync_type,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial'
              ELSE 'success' END AS status,
         CAST(NULL AS VARCHAR) AS message, ts AS sync_started_at,
         ts + to_minutes(event_id % 7) AS sync_completed_at,
         CAST(floor(value) AS INTEGER) AS records_processed
  FROM events""",
    ),
    "settings": (
        (),
        f"""
  SELECT event_id + 1 AS id,
         coalesce(({_column(SETTINGS, 0)})[event_id + 1], 'pref_' || event_id) AS setting_key,
         coalesce(({_column(SETTINGS, 1)})[event_id + 1],
           CASE event_id % 4
             WHEN 0 THEN CAST(CAST(value AS DECIMAL(10,2)) AS VARCHAR)
                         || CASE WHEN event_id % 3 = 0 THEN 'abc' ELSE '' END
             WHEN 1 THEN (['true', 'TRUE', 'false'])[event_id % 3 + 1]
             WHEN 2 THEN CASE WHEN event_id % 3 = 0 THEN '{{broken' ELSE props END
             ELSE event_type END) AS setting_value,
         coalesce(({_column(SETTINGS, 2)})[event_id + 1],
                  (['number', 'boolean', 'json', 'string'])[event_id % 4 + 1]) AS data_type,
         ({_column(SETTINGS, 3)})[event_id + 1] AS description
  FROM events""",
    ),
    "currencies": (
        (),
        """
  SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, upper(left(n_name, 3)) AS code,
         n_name AS name, CAST(NULL AS VARCHAR) AS symbol,
         CAST(count(*) AS DOUBLE) AS exchange_rate, n_nationkey = 0 AS is_default,
         true AS is_active, CAST(NULL AS TIMESTAMP) AS created_at,
         CAST(NULL AS TIMESTAMP) AS updated_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name""",
    ),
    "languages": (
        (),
        f"""
  SELECT CAST(coalesce(list_position({_column(LANGUAGES, 0)}, lang), 0) AS BIGINT) AS id,
         lang AS code,
         ({_column(LANGUAGES, 1)})[list_position({_column(LANGUAGES, 0)}, lang)] AS name,
         ({_column(LANGUAGES, 2)})[list_position({_column(LANGUAGES, 0)}, lang)] AS native_name,
         lang = 'en' AS is_default, true AS is_active, CAST(NULL AS TIMESTAMP) AS created_at
  FROM (SELECT DISTINCT lang FROM documents)""",
    ),
    "users": (
        (),
        """
  SELECT s_suppkey + 1 AS id, lower(replace(s_name, '#', '_')) AS username,
         lower(replace(s_name, '#', '_')) || '@example.com' AS email,
         'Staff' AS first_name, substring(s_name, 10, 9) AS last_name,
         (['admin', 'manager', 'staff', 'staff', 'owner'])[s_suppkey % 5 + 1] AS role,
         CAST(NULL AS VARCHAR) AS phone, s_suppkey % 4 <> 3 AS is_active,
         CAST(DATE '1999-01-01' + CAST(s_suppkey % 97 AS INTEGER) AS TIMESTAMP) AS created_at
  FROM supplier""",
    ),
    "room_availability": (
        (),
        """
  SELECT l_orderkey * 8 + l_linenumber AS id,
         l_partkey + CASE WHEN l_orderkey % 101 = 0 THEN 1000000000 ELSE 0 END AS room_id,
         CAST(l_shipdate AS DATE) AS date, l_returnflag <> 'R' AS is_available
  FROM lineitem""",
    ),
    # Shapes many queries share -------------------------------------------
    "rooms_named": (
        ("rooms", "room_categories"),
        """
  SELECT r.*, k.name AS category_name, k.description AS category_description
  FROM rooms r LEFT JOIN room_categories k ON r.room_category_id = k.id""",
    ),
    "amenity_names": (
        ("room_amenities", "amenities"),
        """
  SELECT room_id, string_agg(name, ',' ORDER BY amenity_id) AS amenities
  FROM room_amenities JOIN amenities ON amenity_id = amenities.id GROUP BY room_id""",
    ),
    "image_facts": (
        ("room_images",),
        """
  SELECT room_id, count(*) AS image_count,
         min_by(image_path, id) FILTER (WHERE is_primary) AS primary_image
  FROM room_images GROUP BY room_id""",
    ),
    "room_status": (
        ("rooms_named", "bookings"),
        """
  SELECT *, id NOT IN (SELECT room_id FROM bookings
                       WHERE is_open AND room_id IS NOT NULL
                         AND check_in_date <= DATE '2001-06-15'
                         AND check_out_date > DATE '2001-06-15') AS is_available
  FROM rooms_named WHERE is_active""",
    ),
    "spend": (
        ("bookings",),
        """
  SELECT customer_id, count(*) AS n,
         coalesce(sum(total_amount) FILTER (WHERE earned), 0) AS earned_spend,
         coalesce(sum(total_amount) FILTER (WHERE booking_status = 'completed'), 0)
           AS completed_spend,
         max(created_at) AS last_booking
  FROM bookings WHERE customer_id IS NOT NULL GROUP BY customer_id""",
    ),
}


def _ordered(names, seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _ordered(_TABLES[name][0], seen)
            seen.append(name)
    return seen


def with_tables(needs: str, body: str) -> str:
    """``body`` after the expressions it needs; both use one WITH clause."""
    if not needs:
        return body.strip()
    names = _ordered(needs.split(), [])
    tables = ",\n".join(f"{n} AS ({_TABLES[n][1]}\n)" for n in names)
    recursive = body.lstrip().startswith("RECURSIVE")
    if recursive:
        body = body.lstrip()[len("RECURSIVE") :]
    more = body.lstrip().startswith(",")
    return f"WITH {'RECURSIVE ' if recursive else ''}{tables}{'' if more else chr(10)}{body.strip()}"


def mean(value: str, where: str | None = None) -> str:
    kept = f" FILTER (WHERE {where})" if where else ""
    return (
        f"CAST(sum({value}){kept} AS DOUBLE)"
        f" / nullif(CAST(count({value}){kept} AS DOUBLE), 0)"
    )


def money(where: str, amount: str = "total_amount") -> str:
    return f"CAST(coalesce(sum({amount}) FILTER (WHERE {where}), 0) AS DOUBLE)"


def statuses(*names: str, suffix: str = "") -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE booking_status = '{n}') AS {n}{suffix}" for n in names
    )


ROOM_COLUMNS = """id, room_number, room_name, description, room_category_id,
  CAST(price_per_night AS DOUBLE) AS price_per_night, max_occupancy,
  CAST(room_size AS DOUBLE) AS room_size, bed_type, cancellation_policy, is_active,
  created_at, updated_at"""

BOOKING_COLUMNS = """b.id, b.booking_reference, b.customer_id, b.room_id, b.check_in_date,
  b.check_out_date, b.adults, b.children, CAST(b.total_amount AS DOUBLE) AS total_amount,
  b.booking_status, b.payment_status, b.special_requests, b.source, b.created_at,
  b.updated_at"""
