"""Literal fixtures, one per rule that is easy to get wrong."""

from __future__ import annotations

import datetime as dt

import pytest

from roomledger.functions.clock import in_report_window
from roomledger.operators import bookings, channels, customers, dashboard, reports, rooms, settings
from roomledger.operators.reports import ReportWindow
from tests.conftest import rows_of

AS_OF = dt.datetime(2024, 6, 15, 12)
TODAY = AS_OF.date()


def room(id, **more):
    base = dict(
        id=id,
        room_number=f"R{id}",
        room_name=f"Room {id}",
        price_per_night="100.00",
        max_occupancy=2,
        is_active=True,
        created_at="2024-01-01 00:00:00",
        updated_at="2024-01-01 00:00:00",
    )
    return {**base, **more}


def guest(id, **more):
    base = dict(
        id=id,
        first_name=f"First{id}",
        last_name=f"Last{id}",
        email=f"g{id}@example.com",
        created_at="2024-01-01 00:00:00",
    )
    return {**base, **more}


def stay(id, room_id, check_in, check_out, status="confirmed", **more):
    base = dict(
        id=id,
        booking_reference=f"BK{id}",
        customer_id=1,
        room_id=room_id,
        check_in_date=check_in,
        check_out_date=check_out,
        adults=1,
        children=0,
        total_amount="100.00",
        booking_status=status,
        source="direct",
        created_at="2024-06-01 00:00:00",
        updated_at="2024-06-01 00:00:00",
    )
    return {**base, **more}


def test_rooms_without_bookings_stay_in_performance(make_tables):
    t = make_tables(
        rooms=[room(1), room(2)],
        bookings=[
            stay(1, 1, "2024-06-10", "2024-06-12"),
            stay(2, 1, "2024-06-10", "2024-06-12", "cancelled"),
            stay(3, 2, "2020-06-10", "2020-06-12", created_at="2020-01-01 00:00:00"),
        ],
    )
    got = rows_of(
        rooms.room_performance(t, AS_OF, "month"),
        "id",
        "total_bookings",
        "cancelled_bookings",
        "success_rate",
    )
    assert got == [(1, 2, 1, 50.0), (2, 0, 0, None)]


def test_channels_without_logs_leave_with_a_period_and_stay_without(make_tables):
    t = make_tables(
        ota_configurations=[
            dict(id=1, ota_name="A", is_active=True),
            dict(id=2, ota_name="B", is_active=True),
            dict(id=3, ota_name="C", is_active=False),
        ],
        ota_sync_logs=[
            dict(
                id=1,
                ota_configuration_id=1,
                status="success",
                sync_started_at="2024-06-14 00:00:00",
                records_processed=5,
            )
        ],
    )
    names = ("ota_name", "total_syncs", "failed_syncs", "total_records_processed")
    assert rows_of(channels.sync_stats(t, AS_OF, "week"), *names) == [("A", 1, 0, 5)]
    assert rows_of(channels.sync_stats(t, AS_OF, None), *names) == [
        ("A", 1, 0, 5),
        ("B", 0, 0, None),
    ]


def test_last_day_of_a_range(make_tables):
    t = make_tables(
        bookings=[
            stay(1, 1, "2024-06-10", "2024-06-12", created_at="2024-06-10 10:00:00"),
            stay(2, 1, "2024-06-10", "2024-06-12", created_at="2024-06-10 00:00:00"),
        ]
    )
    start, end = dt.date(2024, 6, 1), dt.date(2024, 6, 10)
    created = t.bookings.where(in_report_window("created_at", AS_OF, "month", start, end))
    arriving = t.bookings.where(
        in_report_window("check_in_date", AS_OF, "month", start, end, is_date=True)
    )
    assert rows_of(created, "id") == [(2,)]
    assert arriving.count() == 2


def test_trailing_window_on_a_date_column_drops_the_cut_day(make_tables):
    t = make_tables(
        bookings=[stay(1, 1, "2024-05-15", "2024-05-16"), stay(2, 1, "2024-05-16", "2024-05-17")]
    )
    kept = t.bookings.where(in_report_window("check_in_date", AS_OF, "month", is_date=True))
    assert rows_of(kept, "id") == [(2,)]


def test_no_active_rooms_gives_no_rate(make_tables):
    t = make_tables(
        rooms=[room(1, is_active=False)], bookings=[stay(1, 1, "2024-06-14", "2024-06-20")]
    )
    window = ReportWindow(AS_OF)
    assert rows_of(reports.occupancy_by_date(t, window), "occupancy_rate") == [(None,)]
    assert rows_of(reports.occupancy_average(t, window)) == [(0.0,)]
    assert float(bookings.current_occupancy(t, TODAY).first()["occupancy_rate"]) == 0.0


def test_inactive_rooms_count_as_occupied(make_tables):
    t = make_tables(
        rooms=[room(1), room(2, is_active=False)],
        bookings=[
            stay(1, 1, "2024-06-14", "2024-06-20"),
            stay(2, 2, "2024-06-14", "2024-06-20", "completed"),
            stay(3, 1, "2024-06-01", "2024-06-15"),
        ],
    )
    got = bookings.current_occupancy(t, TODAY).first()
    assert (got["occupied_rooms"], got["total_rooms"]) == (2, 1)
    assert float(got["occupancy_rate"]) == 200.0


def test_occupancy_skips_days_without_arrivals(make_tables):
    t = make_tables(
        rooms=[room(1), room(2)],
        bookings=[
            stay(1, 1, "2024-06-01", "2024-06-09"),
            stay(2, 2, "2024-06-01", "2024-06-02"),
            stay(3, 1, "2024-06-10", "2024-06-12"),
        ],
    )
    assert rows_of(reports.occupancy_average(t, ReportWindow(AS_OF))) == [(75.0,)]


@pytest.mark.parametrize(
    "check_in, check_out, free",
    [
        ("2024-06-18", "2024-06-20", True),  # ends on the first day
        ("2024-06-23", "2024-06-25", True),  # starts on the last day
        ("2024-06-21", "2024-06-22", False),  # inside
        ("2024-06-01", "2024-07-01", False),  # spans
        ("2024-06-21", "2024-06-21", False),  # no night, strictly inside
        ("2024-06-20", "2024-06-20", True),  # no night, on the first day
    ],
)
def test_search_boundaries(make_tables, check_in, check_out, free):
    t = make_tables(rooms=[room(1)], bookings=[stay(1, 1, check_in, check_out)])
    found = rooms.room_search(t, dt.date(2024, 6, 20), dt.date(2024, 6, 23), adults=2)
    assert found.count() == int(free)


def test_search_ignores_bookings_without_a_room_and_prices_without_tax(make_tables):
    t = make_tables(
        rooms=[room(1), room(2, max_occupancy=1), room(3, price_per_night="80.00")],
        bookings=[stay(1, None, "2024-06-20", "2024-06-23", "pending")],
        room_amenities=[dict(room_id=1, amenity_id=2), dict(room_id=1, amenity_id=1)],
        amenities=[dict(id=1, name="TV"), dict(id=2, name="Safe")],
        room_images=[
            dict(id=5, room_id=1, image_path="b.jpg", is_primary=True),
            dict(id=4, room_id=1, image_path="a.jpg", is_primary=False),
        ],
    )
    found = rooms.room_search(t, dt.date(2024, 6, 20), dt.date(2024, 6, 23), adults=2)
    got = [
        (r["id"], float(r["total_price"]), r["nights"], r["primary_image"],
         [a["name"] for a in r["amenities"] or []])
        for r in found.collect()
    ]
    assert got == [(3, 240.0, 3, None, []), (1, 300.0, 3, "b.jpg", ["TV", "Safe"])]


def test_search_refuses_bad_dates(make_tables):
    t = make_tables()
    with pytest.raises(ValueError):
        rooms.room_search(t, dt.date(2024, 6, 20), dt.date(2024, 6, 20), adults=1)
    with pytest.raises(ValueError):
        rooms.room_search(t, dt.date(2024, 6, 1), dt.date(2024, 6, 3), 1, today=TODAY)


def test_calendar_end_day_and_first_booking(make_tables):
    t = make_tables(
        rooms=[room(1)],
        bookings=[
            stay(2, 1, "2024-06-15", "2024-06-17", "pending"),
            stay(1, 1, "2024-06-16", "2024-06-17", "completed"),
            stay(3, 1, "2024-06-18", "2024-06-20"),  # begins on the end day
            stay(4, 1, "2024-06-15", "2024-06-18", "cancelled"),
        ],
    )
    got = rows_of(
        rooms.availability_calendar(t, dt.date(2024, 6, 15), dt.date(2024, 6, 18)),
        "date",
        "is_available",
        "booking_status",
    )
    day = lambda n: dt.date(2024, 6, n)
    assert got == [
        (day(15), False, "pending"),
        (day(16), False, "completed"),
        (day(17), True, None),
        (day(18), True, None),
    ]


def test_calendar_shows_a_stay_across_the_end_day(make_tables):
    t = make_tables(rooms=[room(1)], bookings=[stay(1, 1, "2024-06-10", "2024-06-30")])
    grid = rooms.availability_calendar(t, dt.date(2024, 6, 15), dt.date(2024, 6, 18))
    assert rows_of(grid, "is_available") == [(False,)] * 4
    month = rooms.availability_calendar(t, dt.date(2024, 6, 15))
    assert month.count() == 31


def test_loyalty_groups(make_tables):
    counts = {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 10, 7: 11}
    number = iter(range(1, 1000))
    held = [
        stay(next(number), 1, "2024-06-01", "2024-06-02", customer_id=c)
        for c, n in counts.items()
        for _ in range(n)
    ]
    t = make_tables(customers=[guest(c) for c in counts], bookings=held)
    window = ReportWindow(AS_OF, period="year")
    got = {r[0]: r[1:] for r in rows_of(reports.repeat_customers(t, window))}
    assert got == {
        None: (1, 0.0),
        "One-time": (1, 100.0),
        "2-3 bookings": (2, 250.0),
        "4-10 bookings": (2, 700.0),
        "10+ bookings": (1, 1100.0),
    }


def test_spend_means_completed_on_guest_pages_and_earned_in_reports(make_tables):
    t = make_tables(
        customers=[guest(1), guest(2)],
        bookings=[
            stay(1, 1, "2024-06-01", "2024-06-02", "confirmed", total_amount="70.00"),
            stay(2, 1, "2024-06-03", "2024-06-04", "completed", total_amount="30.00"),
        ],
    )
    page = customers.customers_page(t)
    assert [(r["id"], float(r["total_spent"])) for r in page.collect()] == [(2, 0.0), (1, 30.0)]
    best = reports.top_customers(t, ReportWindow(AS_OF, period="year"))
    assert [(r["id"], float(r["total_spent"])) for r in best.collect()] == [(1, 100.0), (2, 0.0)]


def test_averages_leave_out_guests_without_bookings_and_unknown_children(make_tables):
    t = make_tables(
        customers=[guest(1), guest(2)],
        bookings=[
            stay(1, 1, "2024-06-01", "2024-06-02", children=None),
            stay(2, 1, "2024-06-01", "2024-06-05", adults=2, children=1),
        ],
    )
    summary = reports.customer_summary(t, ReportWindow(AS_OF, period="year")).first()
    assert (summary["total_customers"], summary["avg_bookings_per_customer"]) == (2, 2.0)
    booked = reports.booking_summary(t, ReportWindow(AS_OF)).first()
    assert (booked["avg_guests"], booked["avg_length_of_stay"]) == (3.0, 2.5)


def test_cancellation_lead_times(make_tables):
    changed = ["2024-06-03", "2024-06-04", "2024-06-09", "2024-06-10", "2024-06-11"]
    t = make_tables(
        bookings=[
            stay(i, 1, "2024-06-10", "2024-06-12", "cancelled", updated_at=f"{d} 23:00:00")
            for i, d in enumerate(changed)
        ]
    )
    got = dict(rows_of(reports.cancellation_timing(t, ReportWindow(AS_OF))))
    assert got == {
        "7+ days before": 1,
        "1-6 days before": 2,
        "Same day": 1,
        "After check-in": 1,
    }


def test_stay_of_no_night_is_other(make_tables):
    t = make_tables(
        bookings=[
            stay(1, 1, "2024-06-01", "2024-06-01"),
            stay(2, 1, "2024-06-01", "2024-06-02"),
            stay(3, 1, "2024-06-01", "2024-06-09"),
        ]
    )
    got = {r[0] for r in rows_of(reports.length_of_stay(t, ReportWindow(AS_OF)))}
    assert got == {"Other", "1 night", "7+ nights"}


def test_category_reports_differ_on_rooms_without_category(make_tables):
    t = make_tables(
        room_categories=[dict(id=1, name="Suite")],
        rooms=[room(1, room_category_id=1), room(2)],
        bookings=[stay(1, 1, "2024-06-01", "2024-06-02"), stay(2, 2, "2024-06-01", "2024-06-02")],
    )
    window = ReportWindow(AS_OF)
    assert rows_of(reports.revenue_by_category(t, window), "category_name") == [("Suite",)]
    got = set(rows_of(reports.occupancy_by_category(t, window), "category_name"))
    assert got == {("Suite",), (None,)}


def test_lookup_allows_cancel_for_open_bookings_only(make_tables):
    states = ("pending", "confirmed", "cancelled", "completed", "no_show")
    t = make_tables(
        customers=[guest(1)],
        rooms=[room(1)],
        bookings=[stay(i, 1, "2024-06-20", "2024-06-22", s) for i, s in enumerate(states)],
    )
    got = dict(rows_of(bookings.booking_lookup(t), "booking_status", "can_cancel"))
    assert got == {s: s in ("pending", "confirmed") for s in states}
    assert bookings.booking_lookup(t, "BK3").count() == 1
    assert bookings.booking_lookup(t, "none").count() == 0


def test_search_text_ignores_case_and_keeps_wildcards(make_tables):
    t = make_tables(
        customers=[guest(1, first_name="ANNA"), guest(2, first_name="Bob", phone="+15550100")]
    )
    assert rows_of(customers.customers_page(t, "anna"), "id") == [(1,)]
    assert customers.customers_page(t, "a_na").count() == 1
    assert rows_of(customers.customer_search(t, "0100"), "id") == [(2,)]


def test_ties_are_cut_by_id(make_tables):
    t = make_tables(customers=[guest(i) for i in range(1, 31)])
    best = reports.top_customers(t, ReportWindow(AS_OF, period="year"))
    assert [r[0] for r in rows_of(best, "id")] == list(range(1, 21))


def test_pages_cover_the_filtered_bookings(make_tables):
    t = make_tables(
        customers=[guest(1)],
        rooms=[room(1)],
        bookings=[
            *[stay(i, 1, "2024-06-01", "2024-06-02") for i in range(1, 8)],
            stay(90, None, "2024-06-01", "2024-06-02"),
            stay(91, 1, "2024-06-01", "2024-06-02", customer_id=None),
        ],
    )
    pages = [rows_of(bookings.bookings_page(t, page=p, limit=3), "id") for p in (1, 2, 3, 4)]
    assert pages == [[(7,), (6,), (5,)], [(4,), (3,), (2,)], [(1,)], []]
    assert rows_of(bookings.bookings_page_count(t, limit=3)) == [(7, 3)]


def test_activity_has_no_user_and_only_recent_rooms(make_tables):
    t = make_tables(
        customers=[guest(1)],
        rooms=[room(1, updated_at="2024-06-14 00:00:00"), room(2)],
        bookings=[stay(1, 1, "2024-06-20", "2024-06-22")],
    )
    got = rows_of(dashboard.activity_log(t, AS_OF), "type", "description", "user_name")
    assert got == [
        ("room", "Room R1 updated", None),
        ("booking", "New booking #BK1 by First1 Last1", None),
    ]


def test_alerts_only_fire_when_something_is_wrong(make_tables):
    calm = make_tables(
        rooms=[room(1)],
        room_images=[dict(id=1, room_id=1)],
        bookings=[stay(1, 1, "2024-06-14", "2024-06-20")],
    )
    assert dashboard.system_alerts(calm, AS_OF).count() == 0
    busy = make_tables(
        customers=[guest(1)],
        rooms=[room(1), room(2), room(3)],
        bookings=[stay(1, 1, "2024-06-20", "2024-06-22", "pending")],
        ota_configurations=[dict(id=1, ota_name="A", is_active=True)],
        ota_sync_logs=[
            dict(
                id=1,
                ota_configuration_id=1,
                status="failed",
                sync_started_at="2024-06-15 01:00:00",
            )
        ],
    )
    got = {r["category"]: (r["message"], r["affected"])
           for r in dashboard.system_alerts(busy, AS_OF).collect()}
    assert got == {
        "rooms": ("3 active rooms have no images", 3),
        "bookings": ("1 pending bookings are over 24 hours old", 1),
        "occupancy": ("Current occupancy is 0.0%", 0),
        "ota": ("OTA sync failures detected", 1),
    }


def test_settings_take_the_type_they_declare(make_tables):
    given = [
        ("a", "0.10", "number"),
        ("b", "12abc", "number"),
        ("c", "abc", "number"),
        ("d", "true", "boolean"),
        ("e", "TRUE", "boolean"),
        ("f", '{"k": 1}', "json"),
        ("g", "{broken", "json"),
        ("h", "text", "string"),
    ]
    t = make_tables(
        settings=[dict(setting_key=k, setting_value=v, data_type=d) for k, v, d in given]
    )
    typed = settings.settings_typed(t).selectExpr(
        "number_value", "boolean_value", "to_json(json_value) AS j", "string_value"
    )
    assert rows_of(typed) == [
        (0.1, None, None, None),
        (12.0, None, None, None),
        (None, None, None, None),
        (None, True, None, None),
        (None, False, None, None),
        (None, None, '{"k":1}', None),
        (None, None, None, "{broken"),
        (None, None, None, "text"),
    ]


def test_quote_rounds_tax_and_total(make_tables):
    t = make_tables(
        rooms=[room(1, price_per_night="33.33")],
        bookings=[stay(1, 1, "2024-06-01", "2024-06-04")],
    )
    got = bookings.price_quotes(t).first()
    money = [str(got[n]) for n in ("subtotal", "tax_amount", "quote_total")]
    assert money == ["99.99", "10.00", "109.99"]
    assert got["nights"] == 3
