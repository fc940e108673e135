from roomledger.oracle.base import BOOKING_COLUMNS, mean, statuses

_FOUND = "(first_name ILIKE '%UILD%' OR last_name ILIKE '%UILD%' OR email ILIKE '%UILD%')"
_TOTALS = """coalesce(n, 0) AS total_bookings,
  CAST(coalesce(completed_spend, 0) AS DOUBLE) AS total_spent"""

SQL = {
    "customers_page": (
        "customers spend",
        f"""
SELECT c.*, {_TOTALS}, last_booking AS last_booking_date
FROM customers c LEFT JOIN spend ON id = customer_id WHERE {_FOUND}
ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20""",
    ),
    "customers_page_count": (
        "customers",
        f"""
SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
FROM customers WHERE {_FOUND}""",
    ),
    "customer_history": (
        "bookings rooms_named",
        f"""
SELECT {BOOKING_COLUMNS}, r.room_name, r.room_number, r.category_name
FROM bookings b JOIN rooms_named r ON b.room_id = r.id WHERE b.customer_id IS NOT NULL""",
    ),
    "customer_stats": (
        "customers bookings rooms",
        f"""
SELECT g.id AS customer_id, count(b.id) AS total_bookings,
  CAST(coalesce(sum(total_amount) FILTER (WHERE booking_status = 'completed'), 0) AS DOUBLE)
    AS total_spent,
  {statuses("pending", "confirmed", "cancelled", "completed", suffix="_bookings")}
FROM customers g LEFT JOIN (SELECT * FROM bookings WHERE room_id IN (SELECT id FROM rooms)) b
  ON b.customer_id = g.id GROUP BY g.id""",
    ),
    "customers_overview": (
        "customers",
        """
SELECT count(*) AS total_customers,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-05-15 12:00:00') AS new_customers_month,
  count(*) FILTER (WHERE created_at >= TIMESTAMP '2001-06-08 12:00:00') AS new_customers_week
FROM customers WHERE created_at >= TIMESTAMP '2000-06-15 12:00:00'""",
    ),
    "top_customers_completed": (
        "customers spend",
        f"""
SELECT c.*, {_TOTALS} FROM customers c LEFT JOIN spend ON id = customer_id
ORDER BY coalesce(completed_spend, 0) DESC, id LIMIT 10""",
    ),
    "customer_countries": (
        "customers",
        """
SELECT country, count(*) AS count FROM customers
WHERE country IS NOT NULL AND country <> ''
GROUP BY country ORDER BY count DESC, country LIMIT 10""",
    ),
    "customer_search": (
        "customers spend",
        """
SELECT c.*, coalesce(n, 0) AS total_bookings, last_booking AS last_booking_date
FROM customers c LEFT JOIN spend ON id = customer_id
WHERE first_name ILIKE '%55500%' OR last_name ILIKE '%55500%'
   OR email ILIKE '%55500%' OR phone ILIKE '%55500%'
ORDER BY created_at DESC, id DESC LIMIT 10""",
    ),
    "customer_category_prefs": (
        "bookings rooms_named",
        f"""
SELECT customer_id, category_name AS preferred_category, count(*) AS total_bookings,
  {mean("adults")} AS avg_adults, {mean("children")} AS avg_children,
  {mean("total_amount")} AS avg_spending, {mean("nights")} AS avg_stay_length,
  count(category_name) AS category_bookings
FROM bookings b JOIN rooms_named r ON b.room_id = r.id
WHERE earned AND customer_id IS NOT NULL GROUP BY customer_id, category_name""",
    ),
    "customer_amenity_prefs": (
        "bookings rooms room_amenities amenities",
        """
SELECT customer_id, amenity_id, a.name, a.icon, count(*) AS usage_count
FROM bookings b JOIN rooms r ON b.room_id = r.id JOIN room_amenities x ON x.room_id = r.id
  JOIN amenities a ON x.amenity_id = a.id
WHERE earned AND customer_id IS NOT NULL
GROUP BY customer_id, amenity_id, a.name, a.icon
QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, amenity_id) <= 5""",
    ),
    "customer_seasonality": (
        "bookings",
        f"""
SELECT customer_id, CAST(month(check_in_date) AS INTEGER) AS month, count(*) AS bookings,
  {mean("total_amount")} AS avg_amount
FROM bookings WHERE earned AND customer_id IS NOT NULL GROUP BY 1, 2""",
    ),
}

# The same rows, found through an index.
SQL["customer_search_indexed"] = SQL["customer_search"]
SQL["customers_page_indexed"] = SQL["customers_page"]
