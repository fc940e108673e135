"""Rooms for many asked stays against one search per stay."""

from __future__ import annotations

import datetime as dt
import random

from roomledger.operators import gaps, rooms
from tests.conftest import rows_of
from tests.test_dominance import join_rows
from tests.test_traps import room, stay

DAY = dt.date(2024, 6, 1)
ASKED = "request_id bigint, check_in_date date, check_out_date date, guests int, category_id bigint"


def bookings_of(rng, n):
    held = []
    for i in range(n):
        first = DAY + dt.timedelta(rng.randrange(60))
        last = first + dt.timedelta(rng.choice([-6, -1, 0, 1, 2, 3, 8]))
        status = rng.choice(["pending", "confirmed", "cancelled", "completed"])
        held.append(stay(i, rng.choice([1, 1, 2, 3, 4, 77, None]), str(first), str(last), status))
    return held + [stay(900, 5, "0001-01-01", "9999-12-31"), stay(901, 6, "2024-06-10", None)]


def test_equals_one_search_per_stay(spark, make_tables):
    rng = random.Random(5)
    listed = [room(i) | {"max_occupancy": 1 + i % 4, "room_category_id": i % 2, "price_per_night": f"{10 + i}.50"} for i in range(1, 9)]
    listed[7]["is_active"] = False
    t = make_tables(rooms=listed, bookings=bookings_of(rng, 25))
    asked = []
    for i in range(1000):
        first = DAY + dt.timedelta(rng.randrange(-3, 66))
        asked.append((i, first, first + dt.timedelta(rng.randrange(0, 12)), rng.randrange(1, 5), rng.choice([None, None, 0, 1])))
    asked += [(2000, dt.date(1, 1, 1), dt.date(1, 1, 2), 1, None), (2001, dt.date(9999, 12, 30), dt.date(9999, 12, 31), 1, None)]
    got: dict = {}
    for r in gaps.rooms_for_stays(t, spark.createDataFrame(asked, ASKED)).collect():
        assert r["room_id"] not in got.setdefault(r["request_id"], {})
        got[r["request_id"]][r["room_id"]] = (r["nights"], r["total_price"])
    # the search itself for some, its rule for all
    for i, first, last, guests, category in asked[:12]:
        if first < last:
            found = rooms.room_search(t, first, last, guests, category_id=category)
            assert got.get(i, {}) == {r["id"]: (r["nights"], r["total_price"]) for r in found.collect()}
    held = [b for b in t.bookings.collect() if b["booking_status"] in ("pending", "confirmed") and b["check_out_date"] and b["room_id"]]
    for i, first, last, guests, category in asked:
        free = {
            r["id"] for r in listed
            if r.get("is_active", True) and r["max_occupancy"] >= guests and (category is None or r["room_category_id"] == category)
            and first < last and not any(b["room_id"] == r["id"] and b["check_in_date"] < last and b["check_out_date"] > first for b in held)
        }
        assert set(got.get(i, {})) == free
    counts = {r["request_id"]: r["free_rooms"] for r in gaps.free_room_counts(t, spark.createDataFrame(asked, ASKED)).collect()}
    assert counts == {i: len(got.get(i, {})) for i, *_ in asked}


def test_a_busy_room_makes_no_pairs(spark, make_tables):
    rng = random.Random(6)
    held = [stay(i, 1, str(DAY + dt.timedelta(2 * (i % 700))), str(DAY + dt.timedelta(2 * (i % 700) + 1))) for i in range(6000)]
    t = make_tables(rooms=[room(1), room(2)], bookings=held)
    asked = [(i, DAY + dt.timedelta(rng.randrange(1400)), None, 1, None) for i in range(800)]
    asked = [(i, a, a + dt.timedelta(rng.randrange(1, 3)), g, c) for i, a, _, g, c in asked]
    df = gaps.rooms_for_stays(t, spark.createDataFrame(asked, ASKED))
    rows = rows_of(df, "request_id", "room_id")
    assert {i for i, r in rows if r == 2} == set(range(800))
    assert max(join_rows(df)) < 5000
    assert gaps.free_gaps(t).where("room_id = 1").count() == 701


def test_counts_list_no_rooms(spark, make_tables):
    """300 rooms alike and 200 asked stays: what meets is days, not rooms; stays of negative
    length cut the gaps around them."""
    rng = random.Random(8)
    listed = [room(i) | {"max_occupancy": 2 + i % 2, "room_category_id": [None, 1, 2][i % 3], "price_per_night": f"{10 + i}.50"} for i in range(1, 301)]
    held = [stay(1000 + i, 1 + i % 300, str(DAY + dt.timedelta(i % 50)), str(DAY + dt.timedelta(i % 50 + i % 4)), "pending") for i in range(150)]
    for i in range(400):
        first = DAY + dt.timedelta(rng.randrange(60))
        held.append(stay(i, rng.randrange(1, 40), str(first), str(first - dt.timedelta(rng.randrange(1, 9))), "confirmed"))
    t = make_tables(rooms=listed, bookings=held)
    asked = []
    for i in range(200):
        first = DAY + dt.timedelta(rng.randrange(-9, 62))
        asked.append((i // 2 * 2, first, first + dt.timedelta(rng.randrange(1, 20)), rng.choice([1, 3, 4, None]), rng.choice([None, 1, 2])))
    df = spark.createDataFrame(asked, ASKED)
    for given in (df, df.drop("category_id")):
        rows: dict = {}
        for r in gaps.rooms_for_stays(t, given).collect():
            rows.setdefault(r["request_id"], []).append(r["total_price"])
        counted = gaps.free_room_counts(t, given)
        got = counted.collect()
        assert 4 * max(join_rows(counted)) < sum(map(len, rows.values()))
        for r in got:
            found = rows.get(r["request_id"], [])
            assert (r["free_rooms"], r["lowest_price"]) == (len(found), min(found, default=None))
