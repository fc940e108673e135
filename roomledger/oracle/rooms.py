from roomledger.oracle.base import ROOM_COLUMNS, money, mean

_XML = "'<{0}>' || CAST({1} AS VARCHAR) || '</{0}>'"


def _element(tag: str, value: str, indent: int = 4) -> str:
    """The element and its line break; an unset value has no element."""
    pad = " " * indent
    return f"coalesce(chr(10) || '{pad}' || {_XML.format(tag, value)}, '')"


_EXPORT = " || ".join(
    [
        "'<room id=\"' || id || '\">'",
        _element("name", "room_name"),
        _element("category", "category_name"),
        _element("capacity", "max_occupancy"),
        _element("rate", "price_per_night"),
        _element(
            "availability", "CASE WHEN is_available THEN 'available' ELSE 'unavailable' END"
        ),
        _element("description", "description"),
        "chr(10) || '    <amenities></amenities>' || chr(10) || '</room>'",
    ]
)

_ARI = " || ".join(
    [
        "'<rooms>'",
        _element("room_id", "id"),
        _element("room_name", "room_name"),
        _element("rate", "price_per_night"),
        _element("availability", "CAST(is_available AS INTEGER)"),
        _element("inventory", "1"),
        "chr(10) || '    <restrictions>'",
        _element("min_stay", "1", 8),
        _element("max_stay", "30", 8),
        _element("closed_to_arrival", "0", 8),
        _element("closed_to_departure", "0", 8),
        "chr(10) || '    </restrictions>' || chr(10) || '</rooms>'",
    ]
)

SQL = {
    "rooms_list": (
        "rooms_named amenity_names image_facts",
        f"""
SELECT {ROOM_COLUMNS}, category_name, category_description,
  coalesce(image_count, 0) AS image_count, primary_image, amenities
FROM rooms_named LEFT JOIN image_facts i ON id = i.room_id
  LEFT JOIN amenity_names a ON id = a.room_id
WHERE is_active""",
    ),
    "room_detail": (
        "rooms_named amenity_names room_images",
        f"""
, pictures AS (
  SELECT room_id, count(*) AS n,
    string_agg(image_path, ',' ORDER BY is_primary DESC, display_order, id) AS paths
  FROM room_images GROUP BY room_id)
SELECT {ROOM_COLUMNS}, category_name, category_description, amenities,
  paths AS images, coalesce(n, 0) AS image_count
FROM rooms_named LEFT JOIN amenity_names a ON id = a.room_id
  LEFT JOIN pictures p ON id = p.room_id""",
    ),
    "room_gallery": (
        "room_images",
        """
SELECT id, room_id, image_path, is_primary, display_order, CAST(row_number() OVER (
  PARTITION BY room_id ORDER BY is_primary DESC, display_order, id) AS INTEGER) AS position
FROM room_images""",
    ),
    "room_search": (
        "rooms_named amenity_names image_facts bookings",
        f"""
SELECT {ROOM_COLUMNS}, category_name, category_description, primary_image, amenities,
  CAST(3 AS INTEGER) AS nights, CAST(price_per_night * 3 AS DOUBLE) AS total_price
FROM rooms_named r LEFT JOIN image_facts i ON id = i.room_id
  LEFT JOIN amenity_names a ON id = a.room_id
WHERE is_active AND max_occupancy >= 3
  AND NOT EXISTS (SELECT 1 FROM bookings b WHERE b.room_id = r.id AND is_open
    AND check_in_date < DATE '2001-06-23' AND check_out_date > DATE '2001-06-20')""",
    ),
    "categories_list": ("room_categories", "SELECT * FROM room_categories"),
    "amenities_list": ("amenities", "SELECT * FROM amenities"),
    "availability_calendar": (
        "rooms_named bookings",
        """
, days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2001-06-15', TIMESTAMP '2001-07-15',
                                              INTERVAL 1 DAY)) AS DATE) AS day),
held AS (
  SELECT day, room_id, min_by(booking_status, id) AS booking_status
  FROM days JOIN bookings ON check_in_date <= day AND day < check_out_date
  WHERE booking_status IN ('pending', 'confirmed', 'completed')
    AND check_in_date < DATE '2001-07-15' AND check_out_date > DATE '2001-06-15'
  GROUP BY day, room_id)
SELECT d.day AS date, r.id AS room_id, r.room_number, r.room_name, r.category_name,
  h.booking_status, h.booking_status IS NULL AS is_available
FROM rooms_named r CROSS JOIN days d
  LEFT JOIN held h ON h.day = d.day AND h.room_id = r.id
WHERE r.is_active""",
    ),
    "channel_room_status": (
        "room_status",
        """
SELECT id, room_number, room_name, category_name,
  CAST(price_per_night AS DOUBLE) AS price_per_night, is_available FROM room_status""",
    ),
    "channel_export_xml": (
        "room_status",
        f"SELECT id AS room_id, {_EXPORT} AS element FROM room_status",
    ),
    "channel_payload_xml": (
        "room_status",
        f"SELECT id AS room_id, {_ARI} AS payload FROM room_status",
    ),
    "channel_payload_rates_json": (
        "room_status",
        """
SELECT id // 500 AS document,
  '{"HotelId":"H2","RequestId":"agoda_992606400000_' || (id // 500) || '","Rooms":['
  || string_agg('{"RoomId":' || id || ',"RoomType":"' || room_name
       || '","Rates":[{"RatePlan":"Standard","Rate":' || price_per_night
       || ',"Date":"2001-06-15","Availability":' || CAST(is_available AS INTEGER)
       || ',"Inventory":1}]}', ',' ORDER BY id) || ']}' AS payload
FROM room_status GROUP BY id // 500""",
    ),
    "channel_payload_ops_json": (
        "room_status",
        """
SELECT id // 500 AS document,
  '{"listing_id":"H3","operations":['
  || string_agg('{"room_id":"' || id || '","availability":' || is_available
       || ',"price":{"amount":' || price_per_night
       || ',"currency":"USD"},"date":"2001-06-15","minimum_nights":1}', ',' ORDER BY id)
  || ']}' AS payload
FROM room_status GROUP BY id // 500""",
    ),
    "rooms_without_images": (
        "rooms room_images",
        """
SELECT r.id, room_number, room_name
FROM rooms r LEFT JOIN room_images i ON i.room_id = r.id
WHERE is_active AND i.id IS NULL""",
    ),
    **{
        name: (
            "rooms_named bookings",
            f"""
SELECT r.id, r.room_number, r.room_name, r.category_name, count(b.id) AS total_bookings,
  {money("earned")} AS total_revenue, {mean("total_amount", "earned")} AS avg_revenue,
  count(*) FILTER (WHERE booking_status = 'cancelled') AS cancelled_bookings,
  CAST(count(b.id) - count(*) FILTER (WHERE booking_status = 'cancelled') AS DOUBLE)
    / nullif(CAST(count(b.id) AS DOUBLE), 0) * 100 AS success_rate
FROM rooms_named r LEFT JOIN bookings b ON b.room_id = r.id {window}
WHERE r.is_active
GROUP BY r.id, r.room_number, r.room_name, r.category_name""",
        )
        for name, window in (
            ("room_performance", ""),
            ("room_performance_year", "AND b.created_at >= TIMESTAMP '2000-06-15 12:00:00'"),
        )
    },
    "currencies_list": ("currencies", "SELECT * FROM currencies"),
    "languages_list": ("languages", "SELECT * FROM languages"),
    "hotel_info": (
        "settings",
        "SELECT "
        + ", ".join(
            f"(SELECT setting_value FROM settings WHERE setting_key = '{key}') AS {key}"
            for key in (
                "hotel_name",
                "hotel_email",
                "hotel_phone",
                "hotel_address",
                "check_in_time",
                "check_out_time",
            )
        ),
    ),
    "settings_typed": (
        "settings",
        r"""
SELECT setting_key, data_type, description,
  CASE WHEN data_type = 'number' THEN TRY_CAST(regexp_extract(setting_value,
    '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) AS DOUBLE) END AS number_value,
  CASE WHEN data_type = 'boolean' THEN setting_value = 'true' END AS boolean_value,
  CASE WHEN data_type = 'json' AND json_valid(setting_value)
       THEN CAST(json_extract_string(setting_value, '$.k') AS INTEGER) END AS json_k,
  CASE WHEN data_type = 'string' OR (data_type = 'json' AND NOT json_valid(setting_value))
       THEN setting_value END AS string_value
FROM settings""",
    ),
    "staff_directory": (
        "users",
        """
SELECT id, username, email, first_name, last_name, role, phone, is_active, created_at
FROM users""",
    ),
}

SQL["free_room_counts"] = (
    "rooms bookings",
    """
, asked AS (
  SELECT CAST(check_in_date - DATE '1970-01-01' AS BIGINT) AS request_id, check_in_date,
    max(check_out_date) AS check_out_date, max(adults) AS guests
  FROM bookings WHERE check_in_date < check_out_date GROUP BY check_in_date),
taken AS (
  SELECT DISTINCT request_id, b.room_id AS id
  FROM asked a JOIN bookings b ON b.check_in_date < a.check_out_date AND b.check_out_date > a.check_in_date
  WHERE is_open AND b.room_id IS NOT NULL),
fits AS (
  SELECT request_id, r.id, price_per_night * (check_out_date - check_in_date) AS price
  FROM asked JOIN rooms r ON is_active AND max_occupancy >= guests),
found AS (
  SELECT request_id, count(*) AS n, min(price) AS lowest FROM fits ANTI JOIN taken USING (request_id, id)
  GROUP BY request_id)
SELECT request_id, check_in_date, check_out_date, coalesce(n, 0) AS free_rooms,
  CAST(lowest AS DOUBLE) AS lowest_price
FROM asked LEFT JOIN found USING (request_id)""",
)
