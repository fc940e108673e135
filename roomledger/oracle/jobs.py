from roomledger.oracle.base import statuses
from roomledger.sources.schema import TABLE_NAMES

_STAY = "CAST({0}.check_out_date - {0}.check_in_date AS INTEGER)"

_CANCEL = """
, known AS (
  SELECT b.* FROM bookings b JOIN customers c ON b.customer_id = c.id
  JOIN rooms r ON b.room_id = r.id),
asked AS (
  SELECT o_orderkey AS request_id, o_orderdate AS requested_at,
    CASE WHEN o_orderkey % 97 = 0 THEN 'NONE' || o_orderkey
         WHEN o_orderkey % 89 <> 0 THEN 'BK' || (o_orderkey - o_orderkey % 2)
    END AS booking_reference
  FROM orders),
verdicts AS (
  SELECT a.*, CASE
      WHEN k.id IS NULL THEN 'booking_unknown'
      WHEN k.booking_status = 'cancelled' THEN 'already_cancelled'
      WHEN k.booking_status = 'completed' THEN 'booking_completed'
      WHEN trunc(date_diff('second', TIMESTAMP '1998-06-15 12:00:00',
                           CAST(k.check_in_date AS TIMESTAMP)) / 3600.0) < 24
        THEN 'too_close_to_check_in'
      WHEN row_number() OVER (PARTITION BY a.booking_reference
                              ORDER BY a.requested_at, a.request_id) > 1
        THEN 'already_cancelled' END AS reason
  FROM asked a LEFT JOIN known k ON k.booking_reference = a.booking_reference)"""

_REQUESTS = """
asked AS (
  SELECT id AS request_id, created_at AS requested_at,
    CASE WHEN id % 101 = 0 THEN room_id + 1000000000 ELSE room_id - room_id % 10 END AS room_id,
    CASE WHEN id % 503 <> 0 THEN check_in_date END AS check_in_date,
    CASE WHEN id % 509 <> 0 THEN check_out_date END AS check_out_date,
    CASE WHEN id % 521 <> 0 THEN adults END AS adults, children,
    CASE WHEN id % 83 = 0 THEN 'G' ELSE 'Guest' END AS first_name,
    CASE WHEN id % 79 <> 0 THEN 'No ' || id END AS last_name,
    'guest' || (id % 997) || '@example.com' AS email,
    CASE WHEN id % 73 = 0 THEN '12' ELSE '+15550100' END AS phone,
    repeat('x', CAST(id % 506 AS INTEGER)) AS special_requests
  FROM bookings)"""

# Table -> rule -> condition of a row that breaks it.
_RULES = {
    "users": {
        "username_length": "username IS NULL OR length(username) NOT BETWEEN 3 AND 50",
        "username_pattern": "NOT regexp_matches(username, '^[a-zA-Z0-9_]+$')",
        "email_format": "NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s.]{2,}$')",
        "first_name_length": "length(first_name) NOT BETWEEN 2 AND 100",
        "last_name_length": "length(last_name) NOT BETWEEN 2 AND 100",
        "role_domain": "role NOT IN ('admin', 'manager', 'staff')",
    },
    "rooms": {
        "room_number_length": "length(room_number) NOT BETWEEN 1 AND 20",
        "room_name_length": "length(room_name) NOT BETWEEN 1 AND 100",
        "description_length": "length(description) > 1000",
        "room_category_id_range": "room_category_id IS NULL OR room_category_id < 1",
        "price_per_night_range": "price_per_night < 0",
        "max_occupancy_range": "max_occupancy NOT BETWEEN 1 AND 20",
        "room_size_range": "room_size < 0",
        "bed_type_length": "length(bed_type) > 50",
        "cancellation_policy_length": "length(cancellation_policy) > 1000",
    },
    "bookings": {
        "room_id_range": "room_id IS NULL OR room_id < 1",
        "check_in_date_format": "check_in_date IS NULL",
        "check_out_date_format": "check_out_date IS NULL",
        "check_out_after_check_in": "check_out_date <= check_in_date",
        "adults_range": "adults NOT BETWEEN 1 AND 20",
        "children_range": "children NOT BETWEEN 0 AND 20",
        "special_requests_length": "length(special_requests) > 500",
        "booking_status_domain": "booking_status NOT IN "
        "('pending', 'confirmed', 'cancelled', 'completed', 'no_show')",
        "payment_status_domain": "payment_status NOT IN ('pending', 'paid', 'refunded')",
        "source_domain": "source NOT IN "
        "('direct', 'booking_com', 'agoda', 'airbnb', 'expedia', 'other')",
    },
    "booking_requests": {
        "room_id_range": "room_id IS NULL OR room_id < 1",
        "check_in_date_format": "check_in_date IS NULL",
        "check_out_date_format": "check_out_date IS NULL",
        "check_out_after_check_in": "check_out_date <= check_in_date",
        "adults_range": "adults IS NULL OR adults NOT BETWEEN 1 AND 20",
        "children_range": "children NOT BETWEEN 0 AND 20",
        "first_name_length": "first_name IS NULL OR length(first_name) NOT BETWEEN 2 AND 100",
        "last_name_length": "last_name IS NULL OR length(last_name) NOT BETWEEN 2 AND 100",
        "email_format": "NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s.]{2,}$')",
        "phone_format": "NOT regexp_matches(phone, '^\\+?[0-9]{7,15}$')",
        "special_requests_length": "length(special_requests) > 500",
    },
    "customers": {
        "first_name_length": "length(first_name) NOT BETWEEN 2 AND 100",
        "last_name_length": "length(last_name) NOT BETWEEN 2 AND 100",
        "email_format": "NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s.]{2,}$')",
        "phone_format": "NOT regexp_matches(phone, '^\\+?[0-9]{7,15}$')",
        "address_length": "length(address) > 500",
        "city_length": "length(city) > 100",
        "country_length": "length(country) > 100",
        "postal_code_length": "length(postal_code) > 20",
    },
    "ota_sync_logs": {
        "sync_type_domain": "sync_type NOT IN ('availability', 'rates', 'inventory', 'bookings')",
        "status_domain": "status NOT IN ('success', 'failed', 'partial')",
    },
    "ota_configurations": {
        "ota_name_present": "coalesce(trim(ota_name), '') = ''",
        "endpoint_url_present": "coalesce(trim(endpoint_url), '') = ''",
    },
    "currencies": {
        "code_present": "coalesce(trim(code), '') = ''",
        "name_present": "coalesce(trim(name), '') = ''",
    },
    "languages": {
        "code_present": "coalesce(trim(code), '') = ''",
        "name_present": "coalesce(trim(name), '') = ''",
    },
    "settings": {
        "setting_key_present": "setting_key IS NULL OR length(setting_key) NOT BETWEEN 1 AND 100",
        "setting_value_present": "setting_value IS NULL",
        "data_type_domain": "data_type NOT IN ('string', 'number', 'boolean', 'json')",
        "number_value": "data_type = 'number' "
        "AND NOT regexp_matches(setting_value, '^\\s*[+-]?(\\d|\\.\\d)')",
    },
}


def _rule_counts() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, '{rule}' AS rule, "
        f"count(*) FILTER (WHERE {bad}) AS row_count FROM {table}"
        for table, rules in _RULES.items()
        for rule, bad in rules.items()
    )


def _row_rules() -> str:
    marks = ", ".join(
        f"CASE WHEN {bad} THEN '{rule}' END" for rule, bad in _RULES["bookings"].items()
    )
    return f"""
SELECT * FROM (SELECT id, concat_ws(',', {marks}) AS violations FROM bookings)
WHERE violations <> ''"""


def _repeats() -> str:
    keys = {
        "users": ("username", "email"),
        "rooms": ("room_number",),
        "customers": ("email",),
        "bookings": ("booking_reference",),
        "ota_configurations": ("ota_name",),
        "settings": ("setting_key",),
        "currencies": ("code",),
        "languages": ("code",),
    }
    parts = [
        f"SELECT '{table}' AS table_name, '{key}' AS key_name, lower({key}) AS key_value, "
        f"count(*) AS row_count FROM {table} WHERE {key} IS NOT NULL "
        f"GROUP BY lower({key}) HAVING count(*) > 1"
        for table, names in keys.items()
        for key in names
    ]
    for table, a, b in (
        ("room_amenities", "room_id", "amenity_id"),
        ("room_availability", "room_id", "date"),
    ):
        parts.append(
            f"SELECT '{table}', '{a}+{b}', {a} || '+' || {b}, count(*) FROM {table} "
            f"GROUP BY {a}, {b} HAVING count(*) > 1"
        )
    return "\nUNION ALL\n".join(parts)


def _orphans() -> str:
    parts = [
        f"SELECT '{child}' AS table_name, '{column}' AS column_name, "
        f"CAST({column} AS BIGINT) AS missing_id, count(*) AS row_count FROM {child} "
        f"WHERE {column} NOT IN (SELECT id FROM {parent}) GROUP BY {column}"
        for child, column, parent in (
            ("rooms", "room_category_id", "room_categories"),
            ("room_images", "room_id", "rooms"),
            ("room_amenities", "room_id", "rooms"),
            ("room_amenities", "amenity_id", "amenities"),
            ("bookings", "customer_id", "customers"),
            ("bookings", "room_id", "rooms"),
            ("room_availability", "room_id", "rooms"),
            ("ota_sync_logs", "ota_configuration_id", "ota_configurations"),
        )
    ]
    return "\nUNION ALL\n".join(parts)


SQL = {
    "load_tables": (
        " ".join(TABLE_NAMES),
        "\nUNION ALL\n".join(
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name}"
            for name in TABLE_NAMES
        ),
    ),
    "admit_bookings": (
        "bookings rooms",
        f"""RECURSIVE
,{_REQUESTS},
screened AS (
  SELECT a.*, price_per_night, CASE
    WHEN room_id IS NULL OR check_in_date IS NULL OR check_out_date IS NULL
      OR coalesce(adults, 0) < 1 THEN 'missing_or_invalid_field'
    WHEN check_in_date >= check_out_date THEN 'check_out_not_after_check_in'
    WHEN check_in_date < DATE '1997-01-01' THEN 'check_in_in_past'
    WHEN r.id IS NULL THEN 'room_missing_or_inactive'
    WHEN adults + coalesce(children, 0) > max_occupancy THEN 'guests_exceed_capacity'
    WHEN EXISTS (SELECT 1 FROM bookings b
                 WHERE b.room_id = a.room_id AND b.is_open
                   AND a.check_in_date < b.check_out_date AND b.check_in_date < a.check_out_date)
      THEN 'room_not_available' END AS reason
  FROM asked a LEFT JOIN rooms r ON r.id = a.room_id AND r.is_active),
queue AS (
  SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY requested_at, request_id) AS turn
  FROM screened WHERE reason IS NULL),
walk AS (
  SELECT DISTINCT room_id, 0::BIGINT AS turn, NULL::BIGINT AS request_id, false AS ok,
         []::STRUCT(i DATE, o DATE)[] AS held FROM queue
  UNION ALL
  SELECT room_id, turn, request_id, ok,
         CASE WHEN ok THEN list_append(held, {{'i': check_in_date, 'o': check_out_date}})
              ELSE held END
  FROM (SELECT q.*, w.held,
               len(list_filter(w.held, lambda h: h.i < q.check_out_date
                                                 AND q.check_in_date < h.o)) = 0 AS ok
        FROM walk w JOIN queue q ON q.room_id = w.room_id AND q.turn = w.turn + 1)),
judged AS (
  SELECT s.*, coalesce(w.ok, false) AS accepted,
         {_STAY.format("s")} AS stay, s.price_per_night * {_STAY.format("s")} AS base
  FROM screened s LEFT JOIN walk w ON w.request_id = s.request_id)
SELECT request_id, requested_at, room_id, check_in_date, check_out_date, adults, children,
  first_name, last_name, phone, special_requests, accepted, CASE WHEN NOT accepted THEN coalesce(reason, 'room_not_available') END AS reason,
  CASE WHEN accepted THEN stay END AS nights,
  CASE WHEN accepted THEN CAST(base AS DOUBLE) END AS subtotal,
  CASE WHEN accepted THEN CAST(round(base * 0.10, 2) AS DOUBLE) END AS tax_amount,
  CASE WHEN accepted THEN CAST(round(base * 1.10, 2) AS DOUBLE) END AS total_amount
FROM judged""",
    ),
    "cancel_bookings": (
        "bookings customers rooms",
        f"""{_CANCEL}
SELECT request_id, requested_at, booking_reference, reason IS NULL AS cancelled, reason
FROM verdicts""",
    ),
    "cancel_bookings_applied": (
        "bookings customers rooms",
        f"""{_CANCEL}
SELECT b.id, CASE WHEN v.reference IS NULL THEN booking_status ELSE 'cancelled' END
    AS booking_status,
  CASE WHEN v.reference IS NULL THEN updated_at ELSE TIMESTAMP '1998-06-15 12:00:00' END
    AS updated_at
FROM bookings b LEFT JOIN (SELECT booking_reference AS reference FROM verdicts
                           WHERE reason IS NULL) v ON v.reference = b.booking_reference""",
    ),
    "apply_status_changes": (
        "bookings",
        """
, feed AS (
  SELECT event_id, ts,
    user_id * 7 + event_id % 5 + CASE WHEN event_id % 97 = 0 THEN 1000000000 ELSE 0 END
      AS booking_id,
    CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'confirmed'
      WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'cancelled' ELSE 'no_show' END AS status
  FROM events WHERE event_id % 50 <> 49),
final AS (
  SELECT * FROM feed
  QUALIFY row_number() OVER (PARTITION BY booking_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT b.id, b.booking_reference, coalesce(f.status, b.booking_status) AS booking_status,
  coalesce(f.ts, b.updated_at) AS updated_at
FROM bookings b LEFT JOIN final f ON f.booking_id = b.id""",
    ),
    "upsert_customers": (
        "customers",
        """
, typed AS (
  SELECT o_orderkey AS request_id, o_orderdate AS received_at, o_orderpriority AS first_name,
    'Guest ' || o_custkey AS last_name,
    '+1444' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS phone,
    CASE WHEN o_orderkey % 71 = 0 THEN NULL WHEN o_orderkey % 67 = 0 THEN ' '
         WHEN o_orderkey % 3 = 0 THEN 'New' || o_custkey || '@example.com'
         ELSE 'GUEST' || o_custkey || '@EXAMPLE.COM' END AS email
  FROM orders),
ranked AS (
  SELECT *, lower(email) AS match,
    row_number() OVER (PARTITION BY lower(email) ORDER BY received_at, request_id) AS turn,
    row_number() OVER (PARTITION BY lower(email)
                       ORDER BY received_at DESC, request_id DESC) AS back
  FROM typed WHERE trim(email) <> ''),
merged AS (
  SELECT f.match, f.email, f.request_id, l.first_name, l.last_name, l.phone
  FROM ranked f JOIN ranked l ON f.match = l.match AND f.turn = 1 AND l.back = 1)
SELECT c.id, coalesce(m.first_name, c.first_name) AS first_name,
  coalesce(m.last_name, c.last_name) AS last_name, c.email,
  coalesce(m.phone, c.phone) AS phone, c.country,
  CASE WHEN m.match IS NULL THEN c.updated_at ELSE TIMESTAMP '2001-06-15 12:00:00' END
    AS updated_at,
  CASE WHEN m.match IS NULL THEN 'keep' ELSE 'update' END AS action
FROM customers c LEFT JOIN merged m ON m.match = lower(c.email)
UNION ALL
SELECT (SELECT max(id) FROM customers) + row_number() OVER (ORDER BY request_id),
  first_name, last_name, email, phone, 'FRANCE', TIMESTAMP '2001-06-15 12:00:00', 'insert'
FROM merged WHERE match NOT IN (SELECT lower(email) FROM customers)""",
    ),
    "guests_without_email": (
        "",
        """
SELECT o_orderkey AS request_id, o_orderdate AS received_at,
  CASE WHEN o_orderkey % 71 <> 0 THEN ' ' END AS email
FROM orders WHERE o_orderkey % 71 = 0 OR o_orderkey % 67 = 0""",
    ),
    "deletable_customers": (
        "customers bookings",
        """
SELECT id, email FROM customers c
WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.customer_id = c.id AND b.is_open)""",
    ),
    "deletable_rooms": (
        "rooms bookings",
        """
SELECT id, room_number FROM rooms r
WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.room_id = r.id AND b.is_open)""",
    ),
    "deletable_rooms_cascade": (
        "rooms bookings room_images room_amenities room_availability",
        """
, gone AS (SELECT id FROM rooms r
           WHERE NOT EXISTS (SELECT 1 FROM bookings b WHERE b.room_id = r.id AND b.is_open))
"""
        + "\nUNION ALL\n".join(
            f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {name} "
            "WHERE room_id IN (SELECT id FROM gone)"
            for name in ("room_images", "room_amenities", "room_availability")
        ),
    ),
    "deletable_currencies": (
        "currencies",
        "SELECT id, code FROM currencies WHERE NOT is_default",
    ),
    "deletable_languages": ("languages", "SELECT id, code FROM languages WHERE NOT is_default"),
    "quality_report": (
        "users rooms bookings customers ota_sync_logs ota_configurations currencies languages "
        "settings",
        f""",{_REQUESTS.replace("asked AS", "booking_requests AS")}
{_rule_counts()}""",
    ),
    "quality_report_bookings": ("bookings", _row_rules()),
    "uniqueness_violations": (
        "users rooms customers bookings ota_configurations settings currencies languages "
        "room_amenities room_availability",
        _repeats(),
    ),
    "orphan_rows": (
        "rooms room_categories room_images room_amenities amenities bookings customers "
        "room_availability ota_sync_logs ota_configurations",
        _orphans(),
    ),
    "set_single_flag": (
        "room_images",
        """
SELECT id, room_id, image_path, id = min(id) OVER (PARTITION BY room_id) AS is_primary,
  display_order FROM room_images""",
    ),
    "set_single_flag_violations": (
        "room_images",
        """
SELECT room_id, count(*) FILTER (WHERE is_primary) AS flagged
FROM room_images GROUP BY room_id HAVING count(*) FILTER (WHERE is_primary) <> 1""",
    ),
    "append_room_images": (
        "rooms room_images",
        """
SELECT e.event_id AS id, e.user_id AS room_id, 'new-' || e.event_id AS image_path,
  false AS is_primary,
  CAST(coalesce((SELECT max(display_order) FROM room_images i WHERE i.room_id = e.user_id), 0)
    + row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS INTEGER) AS display_order
FROM events e JOIN rooms r ON r.id = e.user_id""",
    ),
}

# What was written and loaded again is what was given.
_SIZES = SQL["load_tables"]
SQL["load_tables_stored"] = (_SIZES[0], f"SELECT *, true AS same FROM ({_SIZES[1]})")

# The dashboard after the same changes.
_CHANGED = SQL["apply_status_changes"][1]
SQL["dashboard_bookings_changed"] = (
    "bookings",
    _CHANGED[: _CHANGED.index("final AS (")]
    + """last_change AS (
  SELECT booking_id, arg_max(status, (ts, event_id)) AS status FROM feed GROUP BY booking_id),
now AS (SELECT created_at, coalesce(c.status, booking_status) AS booking_status
        FROM bookings LEFT JOIN last_change c ON booking_id = id)
SELECT count(*) AS total_bookings,
"""
    + f"""  {statuses("pending", "confirmed", "cancelled", "completed", suffix="_bookings")},
  count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2001-06-15') AS today_bookings,
  count(*) FILTER (WHERE strftime(created_at, '%Y-%m') = '2001-06') AS month_bookings
FROM now""",
)
