from roomledger.oracle.base import mean, money, statuses

# Both ends of the whole history; the end is the midnight that begins its day.
_ALL = "created_at BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '2001-12-31'"
_ALL_STAYS = "check_in_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'"
_YEAR = "created_at >= TIMESTAMP '2000-06-15 12:00:00'"
_MONTH = "created_at >= TIMESTAMP '2001-05-15 12:00:00'"
_YEAR_STAYS = "CAST(check_in_date AS TIMESTAMP) >= TIMESTAMP '2000-06-15 12:00:00'"
_MONTH_STAYS = "CAST(check_in_date AS TIMESTAMP) >= TIMESTAMP '2001-05-15 12:00:00'"

_VALUE = f"""{money("earned")} AS revenue, count(*) FILTER (WHERE earned) AS bookings,
  {mean("total_amount", "earned")} AS avg_value"""
_OVERALL = f"""
SELECT {money("earned")} AS total_revenue, count(*) FILTER (WHERE earned) AS successful_bookings,
  {mean("total_amount", "earned")} AS avg_booking_value,
  count(*) FILTER (WHERE booking_status = 'cancelled') AS cancelled_bookings,
  count(*) AS total_bookings FROM bookings WHERE """
_PART = f"""{money("earned")} AS revenue, count(*) FILTER (WHERE earned) AS bookings,
  count(*) FILTER (WHERE booking_status = 'cancelled') AS cancelled, count(*) AS total,
  {mean("total_amount", "earned")} AS avg_value"""
_COUNTS = f"""count(*) AS total_bookings,
  {statuses("pending", "confirmed", "cancelled", "completed", "no_show")},
  {money("earned")} AS total_revenue"""
_MEANS = f"""{mean("nights")} AS avg_nights,
  {mean("(adults + children)")} AS avg_party"""
_SUMMARY = f"""
SELECT count(*) AS total_bookings,
  {statuses("pending", "confirmed", "cancelled", "completed", "no_show")},
  {mean("nights")} AS avg_length_of_stay, {mean("(adults + children)")} AS avg_guests
FROM bookings WHERE """
_DAILY = """
, daily AS (SELECT check_in_date AS date, count(DISTINCT room_id) AS occupied_rooms
            FROM bookings WHERE earned AND {} GROUP BY 1),
house AS (SELECT count(*) AS total FROM rooms WHERE is_active)"""
_DAILY_RATE = """
SELECT date, occupied_rooms,
  CAST(occupied_rooms AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0) * 100 AS occupancy_rate
FROM daily, house"""

# The labels in the statements below are fixed values: lengths of stays and lead times.
SQL = {
    "revenue_overall": ("bookings", _OVERALL + _ALL),
    "revenue_overall_month": ("bookings", _OVERALL + _MONTH),
    "revenue_by_date": (
        "bookings",
        f"SELECT CAST(created_at AS DATE) AS date, {_VALUE} FROM bookings WHERE {_ALL} GROUP BY 1",
    ),
    "revenue_by_date_year": (
        "bookings",
        f"""SELECT strftime(created_at, '%Y-%m') AS date, {_VALUE}
FROM bookings WHERE {_YEAR} GROUP BY 1""",
    ),
    "revenue_by_category": (
        "bookings rooms room_categories",
        f"""
SELECT k.name AS category_name, {_VALUE}
FROM bookings b JOIN rooms r ON b.room_id = r.id
  JOIN room_categories k ON r.room_category_id = k.id
WHERE b.{_ALL} GROUP BY k.id, k.name""",
    ),
    "revenue_by_source": (
        "bookings",
        f"SELECT source, {_VALUE} FROM bookings WHERE {_ALL} GROUP BY source",
    ),
    "revenue_report": (
        "bookings rooms room_categories",
        f"""
SELECT 'overall' AS section, CAST(NULL AS VARCHAR) AS label, {_PART}
FROM bookings WHERE {_ALL}
UNION ALL SELECT 'date', CAST(CAST(created_at AS DATE) AS VARCHAR), {_PART}
FROM bookings WHERE {_ALL} GROUP BY 2
UNION ALL SELECT 'source', source, {_PART} FROM bookings WHERE {_ALL} GROUP BY source
UNION ALL SELECT 'category', k.name, {_PART}
FROM bookings b JOIN rooms r ON b.room_id = r.id
  JOIN room_categories k ON r.room_category_id = k.id
WHERE b.{_ALL} GROUP BY k.id, k.name""",
    ),
    "bookings_report": (
        "bookings",
        f"""
SELECT 'summary' AS section, CAST(NULL AS VARCHAR) AS label, {_COUNTS}, {_MEANS}
FROM bookings WHERE {_ALL}
UNION ALL SELECT 'date', CAST(CAST(created_at AS DATE) AS VARCHAR), {_COUNTS}, {_MEANS}
FROM bookings WHERE {_ALL} GROUP BY 2
UNION ALL SELECT 'source', source, {_COUNTS}, {_MEANS}
FROM bookings WHERE {_ALL} GROUP BY source
UNION ALL SELECT 'cancellation',
  CASE WHEN check_in_date - CAST(updated_at AS DATE) >= 7 THEN '7+ days before'
       WHEN check_in_date - CAST(updated_at AS DATE) >= 1 THEN '1-6 days before'
       WHEN check_in_date = CAST(updated_at AS DATE) THEN 'Same day'
       ELSE 'After check-in' END, {_COUNTS}, {_MEANS}
FROM bookings WHERE {_ALL} AND booking_status = 'cancelled' GROUP BY 2""",
    ),
    "occupancy_total_rooms": (
        "rooms",
        "SELECT count(*) AS total_rooms FROM rooms WHERE is_active",
    ),
    "occupancy_average": (
        "bookings rooms",
        _DAILY.format(_ALL_STAYS)
        + """
SELECT coalesce(CAST(sum(occupied_rooms) AS DOUBLE)
  / nullif(CAST(count(*) * (SELECT total FROM house) AS DOUBLE), 0) * 100, 0)
  AS avg_occupancy_rate FROM daily""",
    ),
    "occupancy_by_date": ("bookings rooms", _DAILY.format(_ALL_STAYS) + _DAILY_RATE),
    "occupancy_by_date_month": ("bookings rooms", _DAILY.format(_MONTH_STAYS) + _DAILY_RATE),
    "occupancy_by_category": (
        "bookings rooms_named",
        f"""
SELECT category_name, count(DISTINCT r.id) AS category_rooms,
  count(DISTINCT b.room_id) FILTER (WHERE earned) AS occupied_rooms,
  CAST(count(DISTINCT b.room_id) FILTER (WHERE earned) AS DOUBLE)
    / CAST(count(DISTINCT r.id) AS DOUBLE) * 100 AS occupancy_rate
FROM rooms_named r LEFT JOIN bookings b ON r.id = b.room_id AND {_YEAR_STAYS}
WHERE r.is_active GROUP BY category_name""",
    ),
    "length_of_stay": (
        "bookings",
        f"""
SELECT CASE WHEN nights = 1 THEN '1 night' WHEN nights IN (2, 3) THEN '2-3 nights'
            WHEN nights BETWEEN 4 AND 7 THEN '4-7 nights' WHEN nights > 7 THEN '7+ nights'
            ELSE 'Other' END AS stay_length,
  count(*) AS bookings, {mean("total_amount")} AS avg_revenue
FROM bookings WHERE earned AND {_ALL_STAYS} GROUP BY 1""",
    ),
    "booking_summary": ("bookings", _SUMMARY + _ALL),
    "booking_summary_direct": ("bookings", _SUMMARY + _YEAR + " AND source = 'direct'"),
    "bookings_by_date": (
        "bookings",
        f"""
SELECT CAST(created_at AS DATE) AS date, count(*) AS total_bookings,
  {statuses("pending", "confirmed", "cancelled", "completed")}
FROM bookings WHERE {_ALL} GROUP BY 1""",
    ),
    "bookings_by_source": (
        "bookings",
        f"""
SELECT source, count(*) AS total_bookings,
  count(*) FILTER (WHERE earned) AS successful_bookings,
  count(*) FILTER (WHERE booking_status = 'cancelled') AS cancelled_bookings,
  {money("earned")} AS total_revenue
FROM bookings WHERE {_ALL} GROUP BY source""",
    ),
    "cancellation_timing": (
        "bookings",
        f"""
, late AS (SELECT check_in_date - CAST(updated_at AS DATE) AS d FROM bookings
           WHERE booking_status = 'cancelled' AND {_ALL})
SELECT CASE WHEN d >= 7 THEN '7+ days before' WHEN d BETWEEN 1 AND 6 THEN '1-6 days before'
            WHEN d = 0 THEN 'Same day' ELSE 'After check-in' END AS cancellation_timing,
  count(*) AS count FROM late GROUP BY 1""",
    ),
    "customer_summary": (
        "customers spend",
        f"""
SELECT count(*) AS total_customers,
  count(*) FILTER (WHERE {_MONTH}) AS new_customers_month,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-06-08 12:00:00') AS new_customers_week,
  {mean("n")} AS avg_bookings_per_customer, {mean("earned_spend")} AS avg_spent_per_customer
FROM customers LEFT JOIN spend ON id = customer_id WHERE {_ALL}""",
    ),
    "customers_by_country": (
        "customers spend",
        f"""
SELECT country, count(*) AS customer_count, {mean("earned_spend")} AS avg_spent
FROM customers LEFT JOIN spend ON id = customer_id
WHERE {_ALL} AND country IS NOT NULL AND country <> ''
GROUP BY country ORDER BY customer_count DESC, country LIMIT 10""",
    ),
    "top_customers": (
        "customers spend",
        f"""
SELECT id, first_name, last_name, email, country, coalesce(n, 0) AS total_bookings,
  CAST(coalesce(earned_spend, 0) AS DOUBLE) AS total_spent, last_booking AS last_booking_date
FROM customers LEFT JOIN spend ON id = customer_id WHERE {_ALL}
ORDER BY coalesce(earned_spend, 0) DESC, id LIMIT 20""",
    ),
    "customer_acquisition": (
        "customers",
        f"""
SELECT CAST(created_at AS DATE) AS date, count(*) AS new_customers
FROM customers WHERE {_ALL} GROUP BY 1""",
    ),
    "repeat_customers": (
        "customers spend",
        f"""
, held AS (SELECT coalesce(n, 0) AS k, coalesce(earned_spend, 0) AS spent
           FROM customers LEFT JOIN spend ON id = customer_id WHERE {_ALL})
SELECT CASE WHEN k = 1 THEN 'One-time' WHEN k IN (2, 3) THEN '2-3 bookings'
            WHEN k BETWEEN 4 AND 10 THEN '4-10 bookings' WHEN k > 10 THEN '10+ bookings'
       END AS customer_type,
  count(*) AS customer_count, {mean("spent")} AS avg_spent
FROM held GROUP BY 1""",
    ),
    "export_customers": (
        "customers spend",
        """
SELECT first_name, last_name, email, phone, country, created_at,
  coalesce(n, 0) AS total_bookings, CAST(coalesce(earned_spend, 0) AS DOUBLE) AS total_spent
FROM customers LEFT JOIN spend ON id = customer_id""",
    ),
}

# The same rows, from stored bitmaps.
SQL["occupancy_average_stored"] = SQL["occupancy_average"]
SQL["occupancy_by_date_stored"] = SQL["occupancy_by_date"]
SQL["occupancy_by_category_stored"] = SQL["occupancy_by_category"]

# The same rows, from totals per day.
SQL["revenue_overall_days"] = SQL["revenue_overall_month"]
SQL["revenue_by_date_days"] = SQL["revenue_by_date_year"]
SQL["revenue_by_source_days"] = SQL["revenue_by_source"]
