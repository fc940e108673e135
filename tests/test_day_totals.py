"""Reports from daily totals against the scans, after increments in any order."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from roomledger.operators import dashboard, day_totals, reports
from roomledger.operators.changes import apply_status_changes
from tests.conftest import rows_of
from tests.test_traps import stay

AS_OF = dt.datetime(2024, 6, 15, 12)
CHANGE = "change_id bigint, booking_id bigint, status string, changed_at timestamp"
WINDOWS = [
    reports.ReportWindow(AS_OF),
    reports.ReportWindow(AS_OF, period="year"),
    reports.ReportWindow(dt.datetime(2024, 6, 15), period="week"),
    reports.ReportWindow(AS_OF, start=dt.date(2024, 5, 1), end=dt.date(2024, 6, 3)),
    reports.ReportWindow(AS_OF, start=dt.date(2024, 6, 3), end=dt.date(2024, 6, 3)),
    reports.ReportWindow(AS_OF, start=dt.date(2024, 6, 3), end=dt.date(2024, 6, 1)),
]


def bookings_of(rng, ids):
    rows = []
    for i in ids:
        at = dt.datetime(2024, 6, 16) - dt.timedelta(hours=rng.randrange(24 * 420))
        row = stay(i, 1, "2024-07-01", "2024-07-03", rng.choice(["pending", "confirmed", "completed", "cancelled", "no_show"]))
        row |= dict(created_at=rng.choice([None, *[at.isoformat()] * 20]), source=rng.choice(["direct", "agoda", None]),
                    total_amount=rng.choice([None, "10.50", "0.00", f"{rng.randrange(500)}.25"]))
        rows.append(row)
    rows[0]["created_at"] = "2024-06-03T00:00:00"
    rows[1]["created_at"] = "2024-05-15T11:59:59"
    rows[2]["created_at"] = "2024-05-15T12:00:00"
    return rows


def same_as_scans(t, days):
    for window in WINDOWS:
        for name in ("revenue_overall", "revenue_by_date", "revenue_by_source"):
            whole = sorted(rows_of(getattr(reports, name)(t, window)), key=repr)
            assert sorted(rows_of(getattr(day_totals, name)(t, days, window)), key=repr) == whole
    for name in ("dashboard_bookings", "dashboard_revenue"):
        df = getattr(day_totals, name)(days, AS_OF)
        assert df.dtypes == getattr(dashboard, name)(t, AS_OF).dtypes
        assert rows_of(df) == rows_of(getattr(dashboard, name)(t, AS_OF))


@pytest.mark.parametrize("seed", [1, 2])
def test_increments_in_any_order_equal_the_scans(spark, make_tables, tmp_path, seed):
    rng = random.Random(seed)
    first, second = bookings_of(rng, range(300)), bookings_of(rng, range(300, 400))
    # late changes, some of bookings a year old, some of unknown ones or to unknown states
    feeds = []
    for n in range(2):
        feeds.append([(n * 1000 + k, rng.randrange(420), rng.choice(["cancelled", "completed", "pending", "odd"]),
                       dt.datetime(2024, 6, 15, n) + dt.timedelta(seconds=k)) for k in range(80)])
    start = make_tables(bookings=first).bookings
    grown = make_tables(bookings=first + second).bookings
    one = spark.createDataFrame(feeds[0], CHANGE)
    two = spark.createDataFrame(feeds[1], CHANGE)
    after_one = apply_status_changes(grown, one)
    increments = [
        day_totals.booking_days(start),
        day_totals.booking_days(make_tables(bookings=second).bookings),
        day_totals.status_day_changes(grown, one),
        day_totals.status_day_changes(after_one, two),
        # a feed that is applied already adds nothing
        day_totals.status_day_changes(apply_status_changes(after_one, two), two),
    ]
    assert increments[4].count() == 0
    rng.shuffle(increments)
    path = str(tmp_path / "days")
    for increment in increments:
        increment.write.mode("append").parquet(path)
    final = apply_status_changes(after_one, two).collect()
    now = make_tables(bookings=[r.asDict() for r in final])
    days = spark.read.parquet(path)
    same_as_scans(now, days)
    day_totals.compact_days(days, str(tmp_path / "compact"))
    compact = spark.read.parquet(str(tmp_path / "compact"))
    assert compact.count() < days.count()
    assert rows_of(day_totals.dashboard_revenue(compact, AS_OF)) == rows_of(dashboard.dashboard_revenue(now, AS_OF))


def test_no_bookings_and_customers(spark, make_tables):
    t = make_tables(customers=[dict(id=i, created_at=at) for i, at in enumerate(["2024-06-15T03:00:00", "2024-06-01T00:00:00", "2024-05-31T23:59:59", None])])
    same_as_scans(t, day_totals.booking_days(t.bookings))
    days = day_totals.customer_days(t.customers)
    assert rows_of(day_totals.dashboard_customers(days, AS_OF)) == rows_of(dashboard.dashboard_customers(t, AS_OF))
    none = make_tables()
    assert rows_of(day_totals.dashboard_customers(day_totals.customer_days(none.customers), AS_OF)) == rows_of(dashboard.dashboard_customers(none, AS_OF))
