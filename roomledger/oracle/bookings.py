from roomledger.oracle.base import BOOKING_COLUMNS, mean, money, statuses

_JOINED = """FROM bookings b JOIN customers c ON b.customer_id = c.id
  JOIN rooms r ON b.room_id = r.id"""
_NAMED = """FROM bookings b JOIN customers c ON b.customer_id = c.id
  JOIN rooms_named r ON b.room_id = r.id"""
_GUEST = "c.first_name, c.last_name, c.email, r.room_name, r.room_number"
_PAGE_FILTER = """b.booking_status = 'confirmed'
  AND b.check_in_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"""
_OCCUPANCY = """
, house AS (
  SELECT (SELECT count(DISTINCT room_id) FROM bookings WHERE earned
            AND check_in_date <= DATE '2001-06-15' AND check_out_date > DATE '2001-06-15')
         AS occupied_rooms,
         (SELECT count(*) FROM rooms WHERE is_active) AS total_rooms)"""

SQL = {
    "booking_lookup": (
        "bookings customers rooms_named",
        f"""
SELECT {BOOKING_COLUMNS}, c.first_name, c.last_name, c.email, c.phone, r.room_name,
  r.room_number, r.category_name, CAST(r.price_per_night AS DOUBLE) AS price_per_night,
  r.description, r.cancellation_policy, b.nights, b.is_open AS can_cancel
{_NAMED}""",
    ),
    "bookings_page": (
        "bookings customers rooms_named",
        f"""
SELECT {BOOKING_COLUMNS}, c.first_name, c.last_name, c.email, c.phone, r.room_name,
  r.room_number, r.category_name
{_NAMED} WHERE {_PAGE_FILTER}
ORDER BY b.created_at DESC, b.id DESC LIMIT 50 OFFSET 50""",
    ),
    "bookings_page_count": (
        "bookings customers rooms",
        f"""
SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages
{_JOINED} WHERE {_PAGE_FILTER}""",
    ),
    "status_breakdown": (
        "bookings",
        "SELECT booking_status, count(*) AS count FROM bookings GROUP BY booking_status",
    ),
    "booking_revenue_stats": (
        "bookings",
        f"""
SELECT count(*) AS total_bookings,
  {money("booking_status = 'confirmed'")} AS confirmed_revenue,
  {money("booking_status = 'completed'")} AS completed_revenue,
  {mean("total_amount", "earned")} AS avg_booking_value
FROM bookings WHERE created_at >= TIMESTAMP '2000-06-15 12:00:00'""",
    ),
    "current_occupancy": (
        "bookings rooms",
        f"""{_OCCUPANCY}
SELECT occupied_rooms, total_rooms,
  CASE WHEN total_rooms = 0 THEN 0.0::DOUBLE ELSE
    CAST((occupied_rooms * 20000 + total_rooms) // (2 * total_rooms) AS DOUBLE) / 100
  END AS occupancy_rate
FROM house""",
    ),
    "recent_bookings": (
        "bookings customers rooms",
        f"""
SELECT {BOOKING_COLUMNS}, {_GUEST} {_JOINED}
ORDER BY b.created_at DESC, b.id DESC LIMIT 10""",
    ),
    "upcoming_check_ins": (
        "bookings customers rooms",
        f"""
SELECT {BOOKING_COLUMNS}, {_GUEST} {_JOINED}
WHERE b.booking_status = 'confirmed'
  AND b.check_in_date BETWEEN DATE '2001-06-15' AND DATE '2001-06-22'""",
    ),
    "upcoming_check_outs": (
        "bookings customers rooms",
        f"""
SELECT {BOOKING_COLUMNS}, {_GUEST} {_JOINED}
WHERE b.earned AND b.check_out_date BETWEEN DATE '2001-06-15' AND DATE '2001-06-22'""",
    ),
    "stale_pending": (
        "bookings customers rooms",
        f"""
SELECT {BOOKING_COLUMNS}, {_GUEST} {_JOINED}
WHERE b.booking_status = 'pending' AND b.created_at <= TIMESTAMP '2001-06-14 12:00:00'""",
    ),
    "booking_trends": (
        "bookings",
        """
SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS value
FROM bookings WHERE created_at >= TIMESTAMP '2001-05-15 12:00:00' GROUP BY 1""",
    ),
    "booking_trends_revenue": (
        "bookings",
        f"""
SELECT strftime(created_at, '%Y-%m') AS date, {money("earned")} AS value
FROM bookings WHERE created_at >= TIMESTAMP '2000-06-15 12:00:00' GROUP BY 1""",
    ),
    "booking_conflicts": (
        "bookings",
        """
SELECT a.id, a.room_id, a.check_in_date, a.check_out_date, count(*) AS conflict_count
FROM bookings a JOIN bookings b ON a.room_id = b.room_id AND a.id <> b.id
  AND b.check_in_date < a.check_out_date AND b.check_out_date > a.check_in_date
WHERE a.is_open AND b.is_open GROUP BY ALL""",
    ),
    "price_quotes": (
        "bookings rooms",
        """
SELECT b.id, b.room_id, b.check_in_date, b.check_out_date,
  CAST(price_per_night AS DOUBLE) AS price_per_night, b.nights,
  CAST(price_per_night * b.nights AS DOUBLE) AS subtotal,
  CAST(round(price_per_night * b.nights * 0.10, 2) AS DOUBLE) AS tax_amount,
  CAST(round(price_per_night * b.nights * 1.10, 2) AS DOUBLE) AS quote_total
FROM bookings b JOIN rooms r ON b.room_id = r.id""",
    ),
    "dashboard_bookings": (
        "bookings",
        f"""
SELECT count(*) AS total_bookings,
  {statuses("pending", "confirmed", "cancelled", "completed", suffix="_bookings")},
  count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2001-06-15') AS today_bookings,
  count(*) FILTER (WHERE strftime(created_at, '%Y-%m') = '2001-06') AS month_bookings
FROM bookings""",
    ),
    "dashboard_revenue": (
        "bookings",
        f"""
SELECT {money("earned")} AS total_revenue,
  {money("earned AND CAST(created_at AS DATE) = DATE '2001-06-15'")} AS today_revenue,
  {money("earned AND strftime(created_at, '%Y-%m') = '2001-06'")} AS month_revenue,
  {mean("total_amount", "earned")} AS avg_booking_value
FROM bookings""",
    ),
    "dashboard_rooms": (
        "rooms",
        """
SELECT count(*) AS total_rooms, count(*) FILTER (WHERE is_active) AS active_rooms,
  count(*) FILTER (WHERE NOT is_active) AS inactive_rooms FROM rooms""",
    ),
    "dashboard_customers": (
        "customers",
        """
SELECT count(*) AS total_customers,
  count(*) FILTER (WHERE CAST(created_at AS DATE) = DATE '2001-06-15') AS new_customers_today,
  count(*) FILTER (WHERE strftime(created_at, '%Y-%m') = '2001-06') AS new_customers_month
FROM customers""",
    ),
    "system_alerts": (
        "bookings rooms customers room_images ota_sync_logs ota_configurations",
        f"""{_OCCUPANCY},
tenths AS (SELECT *, (occupied_rooms * 2000 + total_rooms) // (2 * total_rooms) AS t FROM house),
bare AS (SELECT count(*) AS n FROM rooms
         WHERE is_active AND id NOT IN (SELECT room_id FROM room_images)),
stale AS (SELECT count(*) AS n {_JOINED} WHERE b.booking_status = 'pending'
          AND b.created_at <= TIMESTAMP '2001-06-14 12:00:00'),
failing AS (SELECT count(DISTINCT c.id) AS n
            FROM ota_sync_logs l JOIN ota_configurations c ON l.ota_configuration_id = c.id
            WHERE l.status = 'failed' AND l.sync_started_at >= TIMESTAMP '2024-01-30')
SELECT 'warning' AS type, 'rooms' AS category,
       n || ' active rooms have no images' AS message, n AS affected,
       'Upload images for these rooms' AS action FROM bare WHERE n > 0
UNION ALL
SELECT 'warning', 'bookings', n || ' pending bookings are over 24 hours old', n,
       'Follow up on pending bookings'
FROM stale WHERE n > 0
UNION ALL
SELECT 'info', 'occupancy', 'Current occupancy is ' || t // 10 || '.' || t % 10 || '%',
       occupied_rooms, 'Consider promotional campaigns'
FROM tenths WHERE occupied_rooms * 100 < 30 * total_rooms
UNION ALL
SELECT 'error', 'ota', 'OTA sync failures detected', n,
       'Check OTA configurations and retry sync' FROM failing WHERE n > 0""",
    ),
    "activity_log": (
        "bookings customers rooms",
        """
, lines AS (
  SELECT 'booking' AS type, 'New booking #' || booking_reference || ' by ' || c.first_name
         || ' ' || c.last_name AS description, b.created_at AS "timestamp", b.id
  FROM bookings b JOIN customers c ON b.customer_id = c.id
  UNION ALL
  SELECT 'room', 'Room ' || room_number || ' updated', updated_at, id
  FROM rooms WHERE updated_at >= TIMESTAMP '2001-06-08 12:00:00')
SELECT type, description, "timestamp", CAST(NULL AS VARCHAR) AS user_name, id
FROM lines ORDER BY "timestamp" DESC, type, id DESC LIMIT 50""",
    ),
    "export_bookings": (
        "bookings customers rooms",
        f"""
SELECT booking_reference, b.created_at, check_in_date, check_out_date, adults, children,
  CAST(total_amount AS DOUBLE) AS total_amount, booking_status, source,
  c.first_name || ' ' || c.last_name AS customer_name, c.email AS customer_email,
  room_number, room_name
{_JOINED}""",
    ),
    "write_csv": (
        "bookings customers rooms",
        f"""
SELECT 'booking_reference,created_at,check_in_date,check_out_date,adults,children,total_amount,'
  || 'booking_status,source,customer_name,customer_email,room_number,room_name' AS line
UNION ALL
SELECT booking_reference || ',' || strftime(b.created_at, '%Y-%m-%d %H:%M:%S') || ','
  || check_in_date || ',' || check_out_date || ',' || adults || ','
  || coalesce(CAST(children AS VARCHAR), '') || ',' || total_amount || ','
  || booking_status || ',' || source || ',' || c.first_name || ' ' || c.last_name || ','
  || c.email || ',' || room_number || ',' || room_name AS line
{_JOINED}""",
    ),
    "export_revenue": (
        "bookings",
        f"""
SELECT CAST(created_at AS DATE) AS date, count(*) AS total_bookings,
  {money("earned")} AS revenue, {mean("total_amount", "earned")} AS avg_booking_value
FROM bookings GROUP BY 1""",
    ),
}

# The same rows, from stored bitmaps.
SQL["current_occupancy_stored"] = SQL["current_occupancy"]

# The same rows, from totals per day.
SQL["dashboard_bookings_days"] = SQL["dashboard_bookings"]
SQL["dashboard_revenue_days"] = SQL["dashboard_revenue"]
SQL["dashboard_customers_days"] = SQL["dashboard_customers"]
