from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from roomledger.operators import changes, quality
from roomledger.operators.bookings import booking_conflicts, conflicts_with
from roomledger.plans.numbering import number_within
from tests.conftest import rows_of
from tests.test_traps import guest, room, stay

AS_OF = dt.datetime(2024, 6, 15, 12)


def test_cancel_edges(spark, make_tables):
    t = make_tables(
        customers=[guest(1)],
        rooms=[room(1)],
        bookings=[
            stay(1, 1, "2024-06-17", "2024-06-18"),
            stay(2, 1, "2024-06-16", "2024-06-18"),
            stay(3, 1, "2024-06-20", "2024-06-21", "no_show"),
            stay(4, 1, "2024-06-20", "2024-06-21", "completed"),
            stay(5, 1, "2024-06-20", "2024-06-21", "cancelled"),
            stay(6, None, "2024-06-20", "2024-06-21"),
        ],
    )
    asked = [(i, dt.datetime(2024, 6, 15, 9, i), f"BK{i}") for i in range(1, 8)]
    asked.append((8, dt.datetime(2024, 6, 15, 10), "BK1"))
    requests = spark.createDataFrame(
        asked, "request_id bigint, requested_at timestamp_ntz, booking_reference string"
    )
    verdicts = changes.cancel_bookings(requests, t, AS_OF)
    assert dict(rows_of(verdicts, "request_id", "reason")) == {
        1: None,
        2: "too_close_to_check_in",
        3: None,
        4: "booking_completed",
        5: "already_cancelled",
        6: "booking_unknown",
        7: "booking_unknown",
        8: "already_cancelled",
    }
    after = changes.apply_cancellations(t.bookings, verdicts, AS_OF)
    gone = after.where("booking_status = 'cancelled'")
    assert sorted(rows_of(gone, "id")) == [(1,), (3,), (5,)]
    assert after.count() == 6


def test_notice_is_counted_to_midnight(spark, make_tables):
    t = make_tables(
        customers=[guest(1)], rooms=[room(1)], bookings=[stay(1, 1, "2024-06-17", "2024-06-18")]
    )
    requests = spark.createDataFrame(
        [(1, AS_OF, "BK1")],
        "request_id bigint, requested_at timestamp_ntz, booking_reference string",
    )
    exact = dt.datetime(2024, 6, 16, 0, 0)
    late = dt.datetime(2024, 6, 16, 0, 1)
    assert rows_of(changes.cancel_bookings(requests, t, exact), "cancelled") == [(True,)]
    assert rows_of(changes.cancel_bookings(requests, t, late), "cancelled") == [(False,)]


def test_last_valid_status_wins_and_repeats_do_nothing(spark, make_tables):
    t = make_tables(bookings=[stay(1, 1, "2024-06-17", "2024-06-18"),
                              stay(2, 1, "2024-06-17", "2024-06-18")])
    feed = spark.createDataFrame(
        [
            (1, 1, "completed", dt.datetime(2024, 6, 2)),
            (2, 1, "pending", dt.datetime(2024, 6, 1)),
            (3, 1, "gone", dt.datetime(2024, 6, 3)),
            (4, 9, "completed", dt.datetime(2024, 6, 3)),
            (5, 1, "no_show", dt.datetime(2024, 6, 2)),
        ],
        "change_id bigint, booking_id bigint, status string, changed_at timestamp_ntz",
    )
    once = changes.apply_status_changes(t.bookings, feed)
    twice = changes.apply_status_changes(once, feed)
    for after in (once, twice):
        assert sorted(rows_of(after, "id", "booking_status")) == [(1, "no_show"), (2, "confirmed")]
    assert rows_of(changes.rejected_changes(feed), "change_id") == [(3,)]


def test_closed_bookings_keep_their_special_requests(spark, make_tables):
    t = make_tables(
        bookings=[
            stay(1, 1, "2024-06-17", "2024-06-18"),
            stay(2, 1, "2024-06-17", "2024-06-18", "completed", special_requests="old"),
        ]
    )
    edits = spark.createDataFrame(
        [("BK1", "crib"), ("BK2", "new")], "booking_reference string, special_requests string"
    )
    after = changes.apply_special_requests(t.bookings, edits, AS_OF)
    assert sorted(rows_of(after, "id", "special_requests")) == [(1, "crib"), (2, "old")]


def test_upsert_matches_email_without_case(spark, make_tables):
    t = make_tables(customers=[guest(1, country="PERU"), guest(5)])
    incoming = spark.createDataFrame(
        [
            (1, dt.datetime(2024, 6, 1), "G1@EXAMPLE.COM", "Ann", "Lee", "+1", None, "X", "CHAD", None),
            (2, dt.datetime(2024, 6, 2), "g1@example.com", "Anna", "Lee", "+2", None, "X", "CHAD", None),
            (3, dt.datetime(2024, 6, 1), "New@x.org", "Cy", "Doe", "+3", "A1", "X", "FIJI", "9"),
            (4, dt.datetime(2024, 6, 2), "new@X.org", "Cyd", "Doe", "+4", "A2", "Y", "MALI", "8"),
            (5, dt.datetime(2024, 6, 2), "late@x.org", "Di", "Roe", "+5", None, None, None, None),
        ],
        """request_id bigint, received_at timestamp_ntz, email string, first_name string,
        last_name string, phone string, address string, city string, country string,
        postal_code string""",
    )
    after = changes.upsert_customers(incoming, t.customers, AS_OF)
    names = ("id", "first_name", "email", "phone", "address", "country", "action")
    assert sorted(rows_of(after, *names)) == [
        (1, "Anna", "g1@example.com", "+2", None, "PERU", "update"),
        (5, "First5", "g5@example.com", None, None, None, "keep"),
        (6, "Cyd", "New@x.org", "+4", "A1", "FIJI", "insert"),
        (7, "Di", "late@x.org", "+5", None, None, "insert"),
    ]


def test_only_idle_parents_may_go(make_tables):
    t = make_tables(
        customers=[guest(1), guest(2)],
        rooms=[room(1), room(2)],
        bookings=[
            stay(1, 1, "2024-06-17", "2024-06-18", "pending"),
            stay(2, 2, "2024-06-17", "2024-06-18", "completed", customer_id=2),
            stay(3, None, "2024-06-17", "2024-06-18", "pending", customer_id=None),
        ],
        room_images=[dict(id=1, room_id=1), dict(id=2, room_id=2)],
        currencies=[dict(id=1, code="USD", is_default=True), dict(id=2, code="EUR", is_default=False)],
    )
    assert rows_of(changes.deletable_customers(t), "id") == [(2,)]
    idle = changes.deletable_rooms(t)
    assert rows_of(idle, "id") == [(2,)]
    assert rows_of(changes.room_cascade(t, idle)["room_images"], "id") == [(2,)]
    assert rows_of(changes.deletable_currencies(t), "code") == [("EUR",)]


def test_one_flag_per_group(spark, make_tables):
    images = [
        dict(id=1, room_id=1, is_primary=True),
        dict(id=2, room_id=1, is_primary=True),
        dict(id=3, room_id=2, is_primary=False),
        dict(id=4, room_id=3, is_primary=True),
    ]
    t = make_tables(
        room_images=images,
        currencies=[dict(id=1, is_default=True), dict(id=2, is_default=True)],
    )
    bad = changes.flag_violations(t.room_images, "is_primary", "room_id")
    assert sorted(rows_of(bad)) == [(1, 2), (2, 0)]
    targets = spark.createDataFrame([(1, 2), (2, 3)], "room_id bigint, id bigint")
    after = changes.set_single_flag(t.room_images, "is_primary", targets, "room_id")
    assert changes.flag_violations(after, "is_primary", "room_id").count() == 0
    assert sorted(rows_of(after.where("is_primary"), "id")) == [(2,), (3,), (4,)]
    assert rows_of(changes.flag_violations(t.currencies, "is_default")) == [(2,)]
    one = changes.set_single_flag(t.currencies, "is_default", 2)
    assert rows_of(one.where("is_default"), "id") == [(2,)]


def test_images_follow_the_highest_order(spark, make_tables):
    t = make_tables(
        rooms=[room(1), room(2)],
        room_images=[dict(id=1, room_id=1, display_order=4), dict(id=2, room_id=1, display_order=2)],
    )
    new = spark.createDataFrame(
        [(10, 1, "a"), (11, 1, "b"), (12, 2, "c"), (13, 9, "d")],
        "id bigint, room_id bigint, image_path string",
    )
    got = rows_of(changes.append_room_images(t, new), "id", "display_order")
    assert sorted(got) == [(10, 5), (11, 6), (12, 1)]


def test_numbering_by_ranges_equals_a_plain_window(spark):
    rows = [(i % 3 if i % 2 else 0, i * 7 % 1009) for i in range(1000)]
    df = spark.createDataFrame(rows, "g bigint, id bigint")
    got = {(g, i): n for g, i, n in rows_of(number_within(df, "g", "id", "n", ranges=20))}
    seen: dict[int, int] = {}
    for g, i in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        assert got[(g, i)] == seen[g]


def test_conflict_counts_equal_pairs(make_tables):
    pick = random.Random(5)
    held = []
    for i in range(120):
        first = dt.date(2024, 6, 1) + dt.timedelta(days=pick.randint(0, 40))
        last = first + dt.timedelta(days=pick.choice([0, 0, 1, 2, 3, 6]))
        status = pick.choice(["pending", "confirmed", "cancelled"])
        held.append(stay(i, pick.choice([1, 1, 1, 2, 3, None]), str(first), str(last), status))
    t = make_tables(bookings=held)
    open_now = [b for b in held if b["booking_status"] != "cancelled" and b["room_id"]]
    expected = {}
    for a in open_now:
        for b in open_now:
            if (
                a["id"] != b["id"]
                and a["room_id"] == b["room_id"]
                and b["check_in_date"] < a["check_out_date"]
                and b["check_out_date"] > a["check_in_date"]
            ):
                expected[a["id"]] = expected.get(a["id"], 0) + 1
    assert dict(rows_of(booking_conflicts(t), "id", "conflict_count")) == expected
    found = conflicts_with(t, 1, dt.date(2024, 6, 10), dt.date(2024, 6, 12))
    assert {r[0] for r in rows_of(found, "id")} == {
        b["id"]
        for b in open_now
        if b["room_id"] == 1
        and b["check_out_date"] > "2024-06-10"
        and b["check_in_date"] < "2024-06-12"
    }


def test_rows_name_the_rules_they_break(make_tables):
    t = make_tables(
        customers=[
            guest(1),
            guest(2, first_name="A", email="nobody", phone="12"),
            guest(3, last_name=None, phone="+15550100", postal_code="9" * 21),
        ]
    )
    got = dict(rows_of(quality.quality_report(t.customers, "customers"), "id", "violations"))
    assert got == {
        1: [],
        2: ["first_name_length", "email_format", "phone_format"],
        3: ["last_name_length", "postal_code_length"],
    }
    counts = quality.quality_counts(t.customers, "customers").where("row_count > 0")
    assert dict(rows_of(counts, "rule", "row_count")) == {
        "first_name_length": 1,
        "last_name_length": 1,
        "email_format": 1,
        "phone_format": 1,
        "postal_code_length": 1,
    }


def test_raw_dates_are_checked_as_text(spark):
    raw = spark.createDataFrame(
        [(1, "2024-06-20", "2024-06-22"), (1, "20/06/2024", "2024-06-22")],
        "room_id bigint, check_in_date string, check_out_date string",
    ).withColumns({"adults": F.lit(1), "children": F.lit(0), "email": F.lit("a@b.org"),
        "first_name": F.lit("Ann"), "last_name": F.lit("Lee"), "phone": F.lit(None).cast("string"),
        "special_requests": F.lit("")})
    got = [r[0] for r in rows_of(quality.quality_report(raw, "booking_requests"), "violations")]
    assert got == [[], ["check_in_date_format"]]


def test_repeated_keys_and_missing_parents(make_tables):
    t = make_tables(
        customers=[guest(1, email="A@x.org"), guest(2, email="a@X.org")],
        rooms=[room(1), room(2, room_number="R1", room_category_id=7)],
        bookings=[
            stay(1, 9, "2024-06-17", "2024-06-18"),
            stay(2, 9, "2024-06-17", "2024-06-18", customer_id=None),
        ],
    )
    repeats = rows_of(quality.uniqueness_violations(t), "table_name", "key_value", "row_count")
    assert sorted(repeats) == [("customers", "a@x.org", 2), ("rooms", "r1", 2)]
    assert sorted(rows_of(quality.orphan_rows(t))) == [
        ("bookings", "room_id", 9, 2),
        ("rooms", "room_category_id", 7, 1),
    ]


def test_unique_keys_are_not_held_by_the_tasks_that_read_them(make_tables):
    """All keys meet in one exchange of a given number of partitions, and no fold comes before it."""
    t = make_tables()
    plan = quality.uniqueness_violations(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("REPARTITION_BY_NUM") == 1
    assert "Aggregate" not in plan[plan.index("Exchange") :]
