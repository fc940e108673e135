"""Counts over two days at once against plain comparison, also in a room with very many stays."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest

from roomledger.operators import bookings, rooms
from roomledger.plans.dominance import count_before_and_beyond
from roomledger.sources.schema import schema_of
from roomledger.sources.tables import Tables
from tests.conftest import rows_of
from tests.test_traps import room, stay

DAY = dt.date(2024, 1, 1)


def test_counts_equal_pairs(spark):
    rng = random.Random(6)
    far = [dt.date(1, 1, 1), dt.date(9999, 12, 31)]

    def date():
        return rng.choice(far) if rng.random() < 0.1 else DAY + dt.timedelta(rng.randrange(40))

    points = [(rng.randrange(3), date(), date(), rng.randrange(1, 4)) for _ in range(200)]
    asked = sorted({(rng.randrange(4), date(), date()) for _ in range(150)})
    df = count_before_and_beyond(
        spark.createDataFrame(points, "g int, x date, y date, n bigint"), spark.createDataFrame(asked, "g int, x date, y date"), "g", "n"
    )
    got = {tuple(r)[:3]: r["n"] for r in df.collect()}
    for g, x, y in asked:
        want = sum(n for a, px, py, n in points if a == g and px < x and py > y)
        assert got.get((g, x, y), 0) == want


def join_rows(df) -> list[int]:
    """Rows out of each join of the plan that ran."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_a_room_with_very_many_stays_and_inverted_ones(spark):
    rng = np.random.default_rng(8)
    begin = rng.integers(0, 2000, 101_000)
    length = rng.integers(0, 30, 101_000)
    length[100_000:] = -rng.integers(1, 25, 1000)
    end = begin + length
    ids = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(begin, end))], "id bigint, a int, b int")
    held = ids.selectExpr(
        *[
            {"id": "id", "room_id": "1L AS room_id", "booking_status": "'confirmed' AS booking_status",
             "check_in_date": "date_add(DATE '2024-01-01', a) AS check_in_date",
             "check_out_date": "date_add(DATE '2024-01-01', b) AS check_out_date"}.get(
                f.name, f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}")
            for f in schema_of("bookings").fields
        ]
    )
    df = bookings.booking_conflicts(Tables(lambda name: held))
    rows = df.collect()
    got = {r["id"]: r["conflict_count"] for r in rows}
    for i in [*range(0, 100_000, 997), *range(100_000, 101_000, 7)]:
        hits = (begin < end[i]) & (end > begin[i])
        hits[i] = False
        assert got.get(i, 0) == hits.sum()
    assert max(join_rows(df)) < 12 * 101_000


@pytest.mark.parametrize("ordered", [True, False])
def test_calendar_equals_a_walk_over_the_days(make_tables, ordered):
    rng = random.Random(9)
    held = []
    for i in range(300):
        first = DAY + dt.timedelta(rng.randrange(-10, 30))
        last = first + dt.timedelta(rng.choice([-2, 0, 1, 2, 9, 60]))
        status = rng.choice(["pending", "confirmed", "completed", "cancelled", "no_show"])
        held.append(stay(rng.randrange(1 << 60), rng.choice([1, 1, 2, 3, None]), str(first), str(last), status))
    t = make_tables(rooms=[room(1), room(2), room(3) | {"is_active": False}, room(4)], bookings=held)
    end = DAY + dt.timedelta(12)
    got = {(r["room_id"], r["date"]): (r["booking_status"], r["is_available"]) for r in rooms.availability_calendar(t, DAY, end, ordered).collect()}
    wanted = {}
    for n in range(13):
        d = DAY + dt.timedelta(n)
        for r in (1, 2, 4):
            # a stay that begins on the last day is outside the range
            over = [
                (b["id"], b["booking_status"]) for b in held
                if b["room_id"] == r and b["booking_status"] in ("pending", "confirmed", "completed")
                and str(b["check_in_date"]) <= str(d) < str(b["check_out_date"]) and str(b["check_in_date"]) < str(end)
            ]
            status = min(over)[1] if over else None
            wanted[r, d] = (status, status is None)
    assert got == wanted
    assert rows_of(rooms.availability_calendar(t, DAY, DAY, ordered), "room_id")
