"""Hot keys, deep pages and stored layouts."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from roomledger.operators import bookings, changes, customers, reports
from roomledger.operators.reports import ReportWindow
from roomledger.sources.layout import save_bucketed, write_clustered
from roomledger.sources.schema import schema_of
from roomledger.sources.starmap import StarSource
from roomledger.sources.tables import Tables
from tests.conftest import STAR, rows_of
from tests.test_plans import plan_of

WINDOW = ReportWindow(dt.datetime(2001, 6, 15), start=dt.date(1995, 1, 1), end=dt.date(2001, 12, 31))


@pytest.fixture(scope="module")
def skewed(spark):
    """The star tables with a third of all bookings on one guest and one room."""
    src = StarSource(spark, STAR)
    hot = F.col("id") % 3 == 0
    held = src.bookings().withColumns(
        {
            "customer_id": F.when(hot, F.lit(7)).otherwise(F.col("customer_id")),
            "room_id": F.when(hot, F.lit(11)).otherwise(F.col("room_id")),
        }
    )
    held = spark.createDataFrame(held.collect(), schema_of("bookings"))
    return Tables(lambda name: held if name == "bookings" else getattr(src, name)())


def test_conflicts_of_a_hot_room(skewed):
    stays = [
        r
        for r in skewed.bookings.where("room_id = 11").collect()
        if r["booking_status"] in ("pending", "confirmed")
    ]
    expected = {}
    for a in stays:
        hits = sum(
            b["id"] != a["id"]
            and b["check_in_date"] < a["check_out_date"]
            and b["check_out_date"] > a["check_in_date"]
            for b in stays
        )
        if hits:
            expected[a["id"]] = hits
    got = bookings.booking_conflicts(skewed).where("room_id = 11")
    assert len(expected) > 100
    assert dict(rows_of(got, "id", "conflict_count")) == expected


def test_totals_of_a_hot_guest(skewed):
    held = [r for r in skewed.bookings.collect() if r["customer_id"] == 7]
    earned = sum(
        r["total_amount"] for r in held if r["booking_status"] in ("confirmed", "completed")
    )
    best = reports.top_customers(skewed, WINDOW, n=1).first()
    assert (best["id"], best["total_bookings"], best["total_spent"]) == (7, len(held), earned)
    stats = customers.customer_stats(skewed, 7).first()
    assert stats["total_bookings"] == sum(r["room_id"] is not None for r in held)


@pytest.mark.parametrize(
    "build, group",
    [
        (lambda t: reports.revenue_by_source(t, WINDOW), "source"),
        (lambda t: reports.top_customers(t, WINDOW), "customer_id"),
        (lambda t: reports.revenue_by_category(t, WINDOW), "room_id"),
        (lambda t: customers.customer_amenity_prefs(t), "customer_id"),
    ],
)
def test_bookings_are_folded_before_they_are_shuffled(skewed, build, group):
    plan = plan_of(build(skewed))
    partial = re.search(rf"Keys \[\d+\]: \[.*{group}.*\]\nFunctions \[\d+\]: \[partial_", plan)
    assert partial


def test_trusted_references_give_the_same_page(skewed):
    t = skewed
    exact = bookings.bookings_page(t, page=3, limit=20)
    trusted = bookings.bookings_page(t, page=3, limit=20, trusted=True)
    assert rows_of(exact, "id") == rows_of(trusted, "id")
    assert rows_of(bookings.bookings_page_count(t)) == rows_of(
        bookings.bookings_page_count(t, trusted=True)
    )
    assert rows_of(bookings.recent_bookings(t), "id") == rows_of(
        bookings.recent_bookings(t, trusted=True), "id"
    )


def test_a_deep_page_is_sorted_on_the_executors(spark, skewed):
    spark.conf.set("spark.sql.execution.topKSortFallbackThreshold", "500")
    try:
        deep = bookings.bookings_page(skewed, page=30, limit=20)
        assert "TakeOrderedAndProject" not in plan_of(deep)
        found = rows_of(deep, "id")
    finally:
        spark.conf.set("spark.sql.execution.topKSortFallbackThreshold", "100000")
    assert found == rows_of(bookings.bookings_page(skewed, page=30, limit=20), "id")


def test_one_scan_reports_agree_with_their_sections(skewed):
    whole = reports.revenue_report(skewed, WINDOW)
    source = {r["label"]: r["revenue"] for r in whole.where("section = 'source'").collect()}
    assert source == dict(rows_of(reports.revenue_by_source(skewed, WINDOW), "source", "revenue"))
    category = {r["label"]: r["revenue"] for r in whole.where("section = 'category'").collect()}
    names = ("category_name", "revenue")
    assert category == dict(rows_of(reports.revenue_by_category(skewed, WINDOW), *names))
    booked = reports.bookings_report(skewed, WINDOW, source="direct")
    summary = reports.booking_summary(skewed, WINDOW, source="direct").first()
    total = booked.where("section = 'summary'").first()
    assert total["total_bookings"] == summary["total_bookings"]


def test_clustered_files_hold_narrow_ranges(spark, tmp_path):
    df = StarSource(spark, STAR).bookings()
    path = str(tmp_path / "bookings")
    write_clustered(df, path, "created_at", files=4)
    back = spark.read.schema(schema_of("bookings")).parquet(path)
    ranges = (
        back.groupBy(F.input_file_name().alias("f"))
        .agg(F.min("created_at").alias("low"), F.max("created_at").alias("high"))
        .orderBy("low")
        .collect()
    )
    assert len(ranges) == 4
    assert all(a["high"] <= b["low"] for a, b in zip(ranges, ranges[1:]))
    assert back.count() == df.count()


def test_bucketed_bookings_join_without_a_shuffle_of_them(spark, tmp_path):
    src = StarSource(spark, STAR)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        save_bucketed(src.bookings(), "held", str(tmp_path / "held"), "customer_id", 8)
        save_bucketed(src.customers(), "guests", str(tmp_path / "guests"), "id", 8)
        given = {"bookings": "held", "customers": "guests"}
        t = Tables(lambda name: spark.table(given[name]))
        plan = plan_of(reports.customer_summary(t, WINDOW))
        assert "hashpartitioning" not in plan
        assert reports.customer_summary(t, WINDOW).first() == reports.customer_summary(
            src.tables(), WINDOW
        ).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS held")
        spark.sql("DROP TABLE IF EXISTS guests")


@pytest.mark.parametrize("join", ["export", "history", "quotes", "cancel"])
def test_a_hot_key_is_split_by_the_join(spark, join):
    """With partition sizes scaled down, the hot side of the join is cut up."""
    held = spark.range(60_000).selectExpr(
        "id",
        "concat('BK', id) AS booking_reference",
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 5000 END AS customer_id",
        "CASE WHEN id % 3 = 0 THEN 11 ELSE id % 700 END AS room_id",
        "DATE'2024-01-01' AS check_in_date",
        "DATE'2024-01-03' AS check_out_date",
        "'confirmed' AS booking_status",
        "timestamp_ntz'2024-01-01 00:00:00' AS created_at",
        "repeat('x', 20) AS special_requests",
    )
    people = spark.range(5000).selectExpr(
        "id", "'a' AS first_name", "'b' AS last_name", "'c' AS email"
    )
    rooms = spark.range(700).selectExpr(
        "id",
        "concat('R', id) AS room_number",
        "'r' AS room_name",
        "CAST(90 AS DECIMAL(10,2)) AS price_per_night",
        "1 AS room_category_id",
    )
    kinds = spark.range(3).selectExpr(
        "CAST(id AS INT) AS id", "'k' AS name", "'d' AS description"
    )
    given = {"bookings": held, "customers": people, "rooms": rooms, "room_categories": kinds}
    t = Tables(lambda name: given[name])
    asked = spark.range(60_000).selectExpr(
        "id AS request_id",
        "timestamp_ntz'2024-01-01 00:00:00' AS requested_at",
        "CASE WHEN id % 3 = 0 THEN 'BK5' ELSE concat('BK', id) END AS booking_reference",
    )
    scaled = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    for key, value in scaled.items():
        spark.conf.set(key, value)
    try:
        df = {
            "export": lambda: bookings.with_guest_and_room(t.bookings, t),
            "history": lambda: customers.customer_history(t),
            "quotes": lambda: bookings.price_quotes(t),
            "cancel": lambda: changes.cancel_bookings(asked, t, dt.datetime(2023, 1, 1)),
        }[join]()
        assert len(df.collect()) == 60_000
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in scaled:
            spark.conf.unset(key)
    assert "skewed" in plan


def test_both_booking_reports_agree_on_the_means(skewed):
    """A booking with an unknown number of children has no party size."""
    held = skewed.bookings.withColumn("children", F.when(F.col("id") % 3 != 0, F.col("children")))
    t = Tables(lambda name: held if name == "bookings" else getattr(skewed, name))
    for source in (None, "direct"):
        whole = reports.bookings_report(t, WINDOW, source=source).where("section = 'summary'").first()
        summary = reports.booking_summary(t, WINDOW, source=source).first()
        assert whole["total_bookings"] == summary["total_bookings"] > 0
        assert whole["avg_party"] == summary["avg_guests"] and whole["avg_nights"] == summary["avg_length_of_stay"]
        timing = reports.bookings_report(t, WINDOW, source=source).where("section = 'cancellation'")
        apart = reports.cancellation_timing(t, WINDOW, source=source)
        assert sum(r["total_bookings"] for r in timing.collect()) == sum(r["count"] for r in apart.collect())
