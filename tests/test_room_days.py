"""Reports from stored bitmaps against the reports over bookings."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from roomledger.operators import bookings, reports, room_days
from tests.conftest import rows_of
from tests.test_traps import room, stay

DAY = dt.date(2024, 6, 1)
AS_OF = dt.datetime(2024, 6, 20, 12)
WINDOWS = [
    reports.ReportWindow(AS_OF, period="month"),
    reports.ReportWindow(AS_OF, period="year"),
    reports.ReportWindow(AS_OF, start=dt.date(2024, 6, 5), end=dt.date(2024, 6, 9)),
]


@pytest.fixture(scope="module")
def held():
    rng = random.Random(12)
    rooms = [1, 2, 3, 40_000, 40_001, 70_000, 9, None]
    rows = []
    for i in range(400):
        first = DAY + dt.timedelta(rng.randrange(-40, 40))
        last = first + dt.timedelta(rng.choice([-1, 0, 1, 2, 3, 7, 33, 365, 5000]))
        status = rng.choice(["pending", "confirmed", "completed", "cancelled"])
        rows.append(stay(i, rng.choice(rooms), str(first), str(last), status))
    # a day on which only bookings without a room arrive
    rows.append(stay(900, None, "2024-06-30", "2024-07-02", "confirmed"))
    return rows


@pytest.mark.parametrize("split", [1, 3])
def test_stored_reports_equal_the_scans(spark, make_tables, held, tmp_path, split):
    listed = [room(i) | {"room_category_id": i % 2 + 1} for i in (1, 2, 3, 40_000, 40_001, 70_000)] + [room(9) | {"is_active": False}]
    categories = [dict(id=1, name="A"), dict(id=2, name="A")]
    t = make_tables(rooms=listed, bookings=held, room_categories=categories)
    path = str(tmp_path / "days")
    # increments in any order, one of them twice, are the whole
    parts = [make_tables(bookings=held[k::split]).bookings for k in reversed(range(split))]
    room_days.write_room_days(parts[0], path, files=3)
    for part in [*parts[1:], parts[0]]:
        room_days.append_room_days(part, path)
    stored = spark.read.parquet(path)
    for window in WINDOWS:
        for name in ("occupancy_average", "occupancy_by_date", "occupancy_by_category"):
            whole = rows_of(getattr(reports, name)(t, window))
            assert rows_of(getattr(room_days, name)(t, stored, window)) == whole
    for n in (-60, -1, 0, 1, 17, 31, 400, 4990):
        today = DAY + dt.timedelta(n)
        whole = rows_of(bookings.current_occupancy(t, today))
        assert rows_of(room_days.current_occupancy(t, stored, today)) == whole


def test_no_bookings(spark, make_tables, tmp_path):
    t = make_tables(rooms=[room(1)])
    room_days.write_room_days(t.bookings, str(tmp_path / "days"))
    stored = spark.read.schema("size int, day date, block int, bucket bigint, rooms binary").parquet(str(tmp_path / "days"))
    assert rows_of(room_days.occupancy_average(t, stored, WINDOWS[0])) == rows_of(reports.occupancy_average(t, WINDOWS[0]))
    assert rows_of(room_days.current_occupancy(t, stored, DAY)) == rows_of(bookings.current_occupancy(t, DAY))


def test_bitmaps_are_neither_exchanged_nor_sorted(make_tables, held, tmp_path):
    made = room_days.room_days(make_tables(bookings=held).bookings, 4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("rangepartitioning") == 1
    assert plan.count("Sort [") == 1 and "bitmap" not in plan[plan.index("Sort [") :].splitlines()[0]
