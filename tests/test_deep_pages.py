"""Deep pages against the sorted whole: same rows, and no task that sorts all rows before them."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from roomledger.operators import bookings, customers, dashboard
from roomledger.plans.paging import BROADCAST_ROWS, page_at
from roomledger.sources.schema import schema_of
from roomledger.sources.tables import Tables
from tests.conftest import rows_of

AS_OF = dt.datetime(2024, 6, 15)


def filled(spark, table, n, **given):
    """``n`` rows of a table, null but for the given SQL expressions of ``id``."""
    held = {"id": "id"} | given
    return spark.range(n).selectExpr(
        *[f"CAST({held.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema_of(table).fields]
    )


@pytest.fixture(scope="module")
def many(spark):
    # a third of all rows on one day, some without a time
    at = """CASE WHEN id % 997 = 1 THEN NULL WHEN id % 3 = 0 THEN TIMESTAMP_NTZ '2024-02-02 00:00:00'
            ELSE TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(CAST(pmod(xxhash64(id), 60) AS INT)) END"""
    made = {
        "bookings": filled(spark, "bookings", 60_000, created_at=at, customer_id="id % 50", room_id="id % 40",
                           booking_reference="concat('B', id)").cache(),
        "customers": filled(spark, "customers", 50, first_name="'A'", last_name="'B'"),
        "rooms": filled(spark, "rooms", 40, updated_at="TIMESTAMP_NTZ '2024-06-14 00:00:00'", room_number="id"),
        "room_categories": filled(spark, "room_categories", 0),
    }
    return Tables(lambda name: made[name])


def newest(rows):
    least = dt.datetime.min
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or least, r[1]), reverse=True)


@pytest.mark.parametrize("page", [1, 300, 600, 901, 1199, 1200, 1201, 5000])
def test_deep_pages_equal_the_sorted_whole(spark, many, page):
    everything = newest(rows_of(many.bookings, "created_at", "id"))
    want = [i for _, i in everything[(page - 1) * 50 : page * 50]]
    assert rows_of(bookings.bookings_page(many, page=page, trusted=True), "id") == [(i,) for i in want]


def test_no_task_sorts_what_lies_before_the_page(many):
    """Few days are read again; the hot day is numbered by ranges and only the page is left."""
    keys = many.bookings.select("id", "created_at")
    order = [F.desc("created_at"), F.desc("id")]
    assert 299 * 50 > BROADCAST_ROWS
    few = page_at(keys, "created_at", order, 300, 50)
    assert "created_at" in few._jdf.queryExecution().optimizedPlan().toString().split("Filter")[1]
    hot = page_at(keys, "created_at", order, 700, 50)
    plan = hot._jdf.queryExecution().optimizedPlan().toString()
    assert "_place" in plan and "Offset" not in plan.replace("Offset 0", "")


def test_deep_guest_and_activity_pages(spark, many):
    made = {"bookings": many.bookings.limit(0), "customers": many.bookings.selectExpr(
        *[c if c in ("id", "created_at") else f"CAST(NULL AS {f.dataType.simpleString()}) AS {c}"
          for c, f in ((f.name, f) for f in schema_of("customers").fields)])}
    t = Tables(lambda name: made[name])
    everything = newest(rows_of(many.bookings, "created_at", "id"))
    got = rows_of(customers.customers_page(t, page=501, limit=50), "id", "total_bookings")
    assert got == [(i, 0) for _, i in everything[25_000:25_050]]
    lines = [(at, "booking", i) for at, i in everything] + [(dt.datetime(2024, 6, 14), "room", i) for i in range(40)]
    least = dt.datetime.min
    lines.sort(key=lambda r: (r[0] is None, -((r[0] or least) - least).total_seconds(), r[1], -r[2]))
    for page in (1, 401):
        shown = rows_of(dashboard.activity_log(many, AS_OF, page=page), "type", "id")
        assert shown == [(k, i) for _, k, i in lines[(page - 1) * 50 : page * 50]]
    at, kind, last = lines[19_999]
    sought = rows_of(dashboard.activity_log(many, AS_OF, after=(at, kind, last)), "type", "id")
    assert sought == [(k, i) for _, k, i in lines[20_000:20_050]]
