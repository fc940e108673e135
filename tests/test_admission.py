"""Batch admission against a plain one-by-one model."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from roomledger.operators.admission import admit_bookings, admitted_bookings
from tests.conftest import rows_of
from tests.test_traps import guest, room, stay

AS_OF = dt.datetime(2024, 6, 15, 12)
REQUEST = (
    "request_id bigint, requested_at timestamp_ntz, room_id bigint, check_in_date date, "
    "check_out_date date, adults int, children int, email string"
)


def day(n: int) -> dt.date:
    return dt.date(2024, 6, 1) + dt.timedelta(days=n - 1)


def request(id, room_id, first, last, adults=1, children=0, at=0, email="g1@example.com"):
    stamp = dt.datetime(2024, 6, 1) + dt.timedelta(minutes=at)
    return (id, stamp, room_id, day(first), day(last), adults, children, email)


def outcome(spark, t, asked, **more):
    df = admit_bookings(spark.createDataFrame(asked, REQUEST), t.bookings, t.rooms, AS_OF, **more)
    return {r["request_id"]: r["reason"] or "accepted" for r in df.collect()}


def one_by_one(asked, held, rooms):
    """The rules applied to one request after the other."""
    taken = {}
    for room_id, first, last in held:
        taken.setdefault(room_id, []).append((first, last))
    verdicts = {}
    for id, _, room_id, first, last, adults, children, _ in sorted(
        asked, key=lambda r: (r[1], r[0])
    ):
        if first >= last:
            verdicts[id] = "check_out_not_after_check_in"
        elif first < AS_OF.date():
            verdicts[id] = "check_in_in_past"
        elif room_id not in rooms:
            verdicts[id] = "room_missing_or_inactive"
        elif adults + (children or 0) > rooms[room_id]:
            verdicts[id] = "guests_exceed_capacity"
        elif any(not (o <= first or i >= last) for i, o in taken.get(room_id, [])):
            verdicts[id] = "room_not_available"
        else:
            verdicts[id] = "accepted"
            taken.setdefault(room_id, []).append((first, last))
    return verdicts


def test_reasons_in_order(spark, make_tables):
    t = make_tables(
        rooms=[room(1), room(2, is_active=False)], bookings=[stay(1, 1, "2024-06-20", "2024-06-22")]
    )
    asked = [
        request(1, 1, 25, 25),
        request(2, 1, 10, 12),
        request(3, 2, 20, 22),
        request(4, 1, 20, 22, adults=2, children=1),
        request(5, 1, 21, 24),
        request(6, 1, 22, 24),
        request(7, 9, 22, 24),
        request(8, 1, 15, 16, children=None),
        request(9, None, 15, 16),
    ]
    assert outcome(spark, t, asked) == {
        1: "check_out_not_after_check_in",
        2: "check_in_in_past",
        3: "room_missing_or_inactive",
        4: "guests_exceed_capacity",
        5: "room_not_available",
        6: "accepted",
        7: "room_missing_or_inactive",
        8: "accepted",
        9: "missing_or_invalid_field",
    }


def test_earlier_requests_block_later_ones(spark, make_tables):
    t = make_tables(rooms=[room(1)])
    asked = [
        request(1, 1, 20, 23, at=5),
        request(2, 1, 22, 25, at=6),  # collides with 1
        request(3, 1, 23, 26, at=7),  # touches 1 only
        request(4, 1, 24, 27, at=4),  # earliest of all, so 3 loses
        request(5, 1, 20, 23, at=9),  # the same stay as 1
    ]
    assert outcome(spark, t, asked) == {
        1: "accepted",
        2: "room_not_available",
        3: "room_not_available",
        4: "accepted",
        5: "room_not_available",
    }


def test_advance_limit_is_off_until_given(spark, make_tables):
    t = make_tables(rooms=[room(1)])
    asked = [request(1, 1, 500, 502)]
    assert outcome(spark, t, asked) == {1: "accepted"}
    assert outcome(spark, t, asked, max_advance_days=365) == {1: "check_in_too_far_ahead"}


@pytest.mark.parametrize("seed, rooms, count", [(1, 3, 150), (2, 1, 200), (3, 8, 200)])
def test_equals_the_one_by_one_model(spark, make_tables, seed, rooms, count):
    pick = random.Random(seed)
    capacity = {i: pick.randint(1, 4) for i in range(1, rooms + 1)}
    held = []
    for _ in range(rooms * 4):
        first = pick.randint(10, 70)
        held.append((pick.randint(1, rooms), first, first + pick.choice([-1, 0, 0, 1, 2, 3])))
    asked = []
    for i in range(count):
        first = pick.randint(12, 70)
        asked.append(
            request(
                i,
                pick.randint(1, rooms),
                first,
                first + pick.choice([0, 1, 1, 2, 3, 5, 9]),
                adults=pick.randint(1, 2),
                children=pick.choice([None, 0, 1]),
                at=pick.randint(0, 50),
            )
        )
    t = make_tables(
        rooms=[room(i, max_occupancy=c) for i, c in capacity.items()],
        bookings=[
            stay(n, r, str(day(i)), str(day(o)), pick.choice(["pending", "confirmed"]))
            for n, (r, i, o) in enumerate(held)
        ],
    )
    expected = one_by_one(asked, [(r, day(i), day(o)) for r, i, o in held], capacity)
    assert outcome(spark, t, asked) == expected


def test_a_room_wanted_by_most(spark, make_tables):
    """One room takes nearly all requests; they fold to its distinct stays."""
    pick = random.Random(7)
    asked = []
    for i in range(20_000):
        first = pick.randint(15, 45)
        wanted = 1 if i % 10 else 2
        asked.append(request(i, wanted, first, first + pick.randint(1, 4), at=pick.randint(0, 999)))
    t = make_tables(rooms=[room(1), room(2)])
    expected = one_by_one(asked, [], {1: 2, 2: 2})
    assert outcome(spark, t, asked) == expected


def test_accepted_requests_become_bookings(spark, make_tables):
    t = make_tables(rooms=[room(1)], customers=[guest(1, email="G1@Example.com")])
    asked = spark.createDataFrame(
        [request(7, 1, 20, 22, children=None), request(8, 1, 21, 22, at=1)], REQUEST
    )
    outcomes = admit_bookings(asked, t.bookings, t.rooms, AS_OF)
    new = admitted_bookings(outcomes, t.customers, AS_OF)
    assert new.schema.names == t.bookings.schema.names
    got = rows_of(
        new, "booking_reference", "customer_id", "children", "total_amount", "booking_status"
    )
    assert [(*r[:3], float(r[3]), r[4]) for r in got] == [("RQ7", 1, 0, 220.0, "pending")]
