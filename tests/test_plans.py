"""Shapes of the physical plans that must survive changes."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from roomledger import catalog
from tests.conftest import STAR

NAMES = sorted(catalog.queries())


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", NAMES)
def test_no_query_pairs_everything_or_leaves_the_jvm(spark, name):
    plan = plan_of(catalog.run(name, spark, STAR))
    for shape in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval", "MapIn"):
        assert shape not in plan


def _filters(plan: str) -> str:
    return " ".join(re.findall(r"PushedFilters: \[.*\]", plan))


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("revenue_overall_month", "GreaterThanOrEqual(o_orderdate,2001-05-15T12:00)"),
        ("revenue_by_date", "LessThanOrEqual(o_orderdate,2001-12-31T00:00)"),
        ("stale_pending", "LessThanOrEqual(o_orderdate,2001-06-14T12:00)"),
        ("failed_syncs", "GreaterThanOrEqual(ts,2024-01-30T00:00)"),
        ("sync_stats", "GreaterThanOrEqual(ts,2024-01-24T00:00)"),
    ],
)
def test_time_windows_reach_the_scan(spark, name, pushed):
    assert pushed in _filters(plan_of(catalog.run(name, spark, STAR)))


def test_scans_read_only_the_columns_in_use(spark):
    plan = plan_of(catalog.run("revenue_by_source", spark, STAR))
    (schema,) = [s for s in re.findall(r"ReadSchema: struct<(.*)>", plan) if "o_orderdate" in s]
    assert "o_custkey" not in schema


@pytest.mark.parametrize(
    "name",
    [
        "bookings_page",
        "recent_bookings",
        "customers_page",
        "customer_search",
        "sync_logs",
        "top_customers",
        "top_customers_completed",
        "activity_log",
    ],
)
def test_pages_are_cut_without_a_full_sort(spark, name):
    assert "TakeOrderedAndProject" in plan_of(catalog.run(name, spark, STAR))


def test_stays_meet_on_room_and_day(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(catalog.run("booking_conflicts", spark, STAR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = re.findall(r"Left keys \[(\d+)\]", plan)
    assert "2" in keys
    assert "SortMergeJoin" in plan


def test_the_calendar_is_exploded_after_its_last_exchange(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = catalog.run("availability_calendar", spark, STAR)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Exchange")
    rooms, days = df.select("room_id").distinct().count(), df.select("date").distinct().count()
    assert df.count() == rooms * days
