"""No row vanishes or slips in: missing fields, inverted stays, idle guests, deep pages."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from roomledger.operators import admission, bookings, changes, channels, customers, quality, reports, rooms
from roomledger.operators.reports import ReportWindow
from roomledger.plans.numbering import number_rows, number_within
from roomledger.sources.schema import TABLE_NAMES, schema_of
from roomledger.sources.tables import load_tables
from tests.conftest import rows_of
from pyspark.sql import functions as F

AS_OF = dt.datetime(2024, 6, 15, 12)


def stay(i, room_id, check_in, check_out, status="confirmed", **more):
    return dict(
        id=i, booking_reference=f"BK{i}", customer_id=1, room_id=room_id, check_in_date=check_in,
        check_out_date=check_out, adults=1, total_amount=10, booking_status=status,
        created_at="2024-06-01T00:00:00", **more,
    )


def test_every_cancel_request_has_an_outcome(spark, make_tables):
    t = make_tables(
        customers=[dict(id=1)], rooms=[dict(id=1)], bookings=[stay(1, 1, "2024-07-01", "2024-07-02")]
    )
    requests = spark.createDataFrame(
        [(1, dt.datetime(2024, 6, 1), None), (2, dt.datetime(2024, 6, 2), None), (3, dt.datetime(2024, 6, 3), "BK1")],
        "request_id bigint, requested_at timestamp_ntz, booking_reference string",
    )
    got = rows_of(changes.cancel_bookings(requests, t, AS_OF), "request_id", "cancelled", "reason")
    assert sorted(got) == [(1, False, "booking_unknown"), (2, False, "booking_unknown"), (3, True, None)]


def test_guests_without_email_are_told_apart(spark, make_tables):
    t = make_tables(customers=[dict(id=4, email=None), dict(id=7, email="a@x.org", first_name="A")])
    when = dt.datetime(2024, 6, 1)
    incoming = spark.createDataFrame(
        [(i, when, e, "N", "L", None, None, None, None, None) for i, e in enumerate([None, "", " ", "A@X.org", "b@x.org"])],
        """request_id bigint, received_at timestamp_ntz, email string, first_name string,
        last_name string, phone string, address string, city string, country string,
        postal_code string""",
    )
    after = rows_of(changes.upsert_customers(incoming, t.customers, AS_OF), "id", "email", "action")
    assert sorted(after) == [(4, None, "keep"), (7, "a@x.org", "update"), (8, "b@x.org", "insert")]
    assert sorted(rows_of(changes.guests_without_email(incoming), "request_id")) == [(0,), (1,), (2,)]


def test_inverted_stays_conflict_as_in_the_lookup(make_tables):
    rng = random.Random(2)
    day = dt.date(2024, 6, 1)
    rows = []
    for i in range(60):
        start = rng.randrange(12)
        end = start + rng.choice([-3, -1, 0, 1, 2, 5])
        rows.append(stay(i, i % 2, str(day + dt.timedelta(start)), str(day + dt.timedelta(end))))
    t = make_tables(bookings=rows)
    wanted = {}
    for a in rows:
        n = sum(
            a is not b
            and a["room_id"] == b["room_id"]
            and b["check_in_date"] < a["check_out_date"]
            and b["check_out_date"] > a["check_in_date"]
            for b in rows
        )
        if n:
            wanted[a["id"]] = n
    assert dict(rows_of(bookings.booking_conflicts(t), "id", "conflict_count")) == wanted


def test_idle_guests_have_zeros(make_tables):
    t = make_tables(customers=[dict(id=1), dict(id=2)], rooms=[dict(id=1)],
                    bookings=[stay(1, 1, "2024-07-01", "2024-07-02", "completed")])
    got = rows_of(customers.customer_stats(t), "customer_id", "total_bookings", "completed_bookings")
    assert sorted(got) == [(1, 1, 1), (2, 0, 0)]
    assert rows_of(customers.customer_stats(t, 2), "total_bookings", "pending_bookings") == [(0, 0)]


def test_categories_of_one_name_stay_apart(make_tables):
    t = make_tables(
        room_categories=[dict(id=1, name="Suite"), dict(id=2, name="Suite")],
        rooms=[dict(id=1, room_category_id=1), dict(id=2, room_category_id=2)],
        bookings=[stay(1, 1, "2024-06-02", "2024-06-03"), stay(2, 2, "2024-06-02", "2024-06-03")],
    )
    window = ReportWindow(AS_OF, start=dt.date(2024, 5, 1), end=dt.date(2024, 7, 1))
    found = reports.revenue_report(t, window).where("section = 'category'")
    assert rows_of(found, "label", "bookings") == [("Suite", 1), ("Suite", 1)]


REQUEST = """request_id bigint, requested_at timestamp_ntz, room_id bigint, check_in_date date,
             check_out_date date, adults int, children int"""


def _asked(spark, rows):
    at = dt.datetime(2024, 6, 1)
    return spark.createDataFrame([(i, at + dt.timedelta(minutes=i), *r) for i, r in enumerate(rows)], REQUEST)


def test_requests_with_missing_fields_are_refused(spark, make_tables):
    t = make_tables(rooms=[dict(id=1, is_active=True, max_occupancy=2, price_per_night=10)])
    a, b = dt.date(2024, 7, 1), dt.date(2024, 7, 3)
    rows = [(1, None, b, 1, 0), (1, a, None, 1, 0), (1, a, b, None, 0), (1, a, b, 0, 0), (None, a, b, 1, 0), (1, a, b, 1, None)]
    got = rows_of(
        admission.admit_bookings(_asked(spark, rows), t.bookings, t.rooms, AS_OF), "request_id", "accepted", "reason"
    )
    refused = [(i, False, "missing_or_invalid_field") for i in range(5)]
    assert sorted(got) == [*refused, (5, True, None)]


def test_a_stay_without_end_and_a_hot_room(spark, make_tables):
    day = dt.date(2024, 7, 1)
    t = make_tables(
        rooms=[dict(id=i, is_active=True, max_occupancy=2, price_per_night=10) for i in (1, 2)],
        bookings=[stay(1, 1, "2024-07-10", "9999-12-31"), stay(2, 1, "2024-07-05", "2024-07-05"),
                  stay(3, 1, "2024-07-03", "2024-07-02", "pending"), stay(4, 2, "2001-01-01", "2024-07-04")],
    )
    rng = random.Random(6)
    rows = []
    for i in range(300):
        start = day + dt.timedelta(rng.randrange(14))
        end = start + dt.timedelta(rng.choice([1, 2, 6]))
        if i % 50 == 0:
            end = dt.date(9999, 12, 31)
        rows.append((1 if i % 10 else 2, start, end, 1, 0))
    got = dict(rows_of(admission.admit_bookings(_asked(spark, rows), t.bookings, t.rooms, AS_OF), "request_id", "accepted"))
    held = [(r, a, b) for _, r, a, b in rows_of(t.bookings, "id", "room_id", "check_in_date", "check_out_date")]
    for i, (room, a, b, _, _) in enumerate(rows):
        free = not any(r == room and x < b and y > a for r, x, y in held)
        assert got[i] == free
        if free:
            held.append((room, a, b))


def test_numbering_of_sparse_ids(spark):
    rng = random.Random(1)
    ids = sorted({rng.randrange(1 << 60) for _ in range(800)} | set(range(50)))
    df = spark.createDataFrame([(i, i % 3) for i in ids], "id bigint, g int")
    numbered = number_rows(df.withColumn("k", F.when(F.col("id") % 7 != 0, F.col("id"))), F.col("k"), "n")
    got = {r["id"]: r["n"] for r in numbered.collect()}
    assert got == {i: None for i in ids if i % 7 == 0} | {i: n for n, i in enumerate([i for i in ids if i % 7], 1)}
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    within = {r["id"]: r["n"] for r in number_within(df, "g", "id", "n").collect()}
    for g in range(3):
        assert [within[i] for i in ids if i % 3 == g] == list(range(1, 1 + sum(i % 3 == g for i in ids)))


def test_all_tables_round_trip(spark, tmp_path):
    for n, name in enumerate(TABLE_NAMES):
        rows = [tuple(None for _ in schema_of(name).fields)] * n
        spark.createDataFrame(rows, schema_of(name)).write.parquet(str(tmp_path / name))
    t = load_tables(spark, str(tmp_path))
    for n, name in enumerate(TABLE_NAMES):
        assert getattr(t, name).schema == schema_of(name) and getattr(t, name).count() == n


def test_pages_can_be_sought(make_tables):
    many = [stay(i, 1, "2024-07-01", "2024-07-02") | dict(created_at=f"2024-06-{1 + i // 3:02d}T00:00:00") for i in range(30)]
    t = make_tables(customers=[dict(id=1, created_at="2024-01-01T00:00:00")], rooms=[dict(id=1)], bookings=many)
    second = rows_of(bookings.bookings_page(t, page=2, limit=7), "id")
    last = bookings.bookings_page(t, page=1, limit=7).collect()[-1]
    sought = bookings.bookings_page(t, limit=7, after=(last["created_at"], last["id"]))
    assert rows_of(sought, "id") == second
    assert rows_of(customers.customers_page(t, after=(dt.datetime(2024, 1, 1), 1)), "id") == []
    assert rows_of(channels.sync_logs(t, after=(AS_OF, 5))) == []


def test_room_detail_lists_images_in_order(make_tables):
    images = [dict(id=i, room_id=1, image_path=f"p{i}", is_primary=i == 3, display_order=9 - i) for i in range(6)]
    t = make_tables(rooms=[dict(id=1), dict(id=2)], room_images=images)
    got = {r["id"]: r for r in rooms.room_detail(t).collect()}
    assert [i["image_path"] for i in got[1]["images"]] == ["p3", "p5", "p4", "p2", "p1", "p0"]
    assert (got[1]["image_count"], got[2]["image_count"], got[2]["images"]) == (6, 0, None)
    first = rows_of(rooms.room_gallery(t, most=2), "image_path", "position")
    assert sorted(first) == [("p3", 1), ("p5", 2)]


@pytest.mark.parametrize("table", ["ota_configurations", "currencies", "languages"])
def test_required_fields_of_settings(make_tables, table):
    names = ("ota_name", "endpoint_url") if table == "ota_configurations" else ("code", "name")
    rows = [{names[0]: "x", names[1]: "y"}, {names[0]: " "}, {}]
    t = make_tables(**{table: [dict(id=i) | r for i, r in enumerate(rows)]})
    found = quality.quality_report(getattr(t, table), table)
    both = [f"{n}_present" for n in names]
    assert [r[0] for r in rows_of(found, "violations")] == [[], both, both]
