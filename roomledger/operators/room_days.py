"""Occupancy from stored bitmaps of rooms instead of distinct counts over bookings.

One table holds, for every arrival day and for every block of nights, which rooms had an
earned stay: a bitmap of 32,768 rooms per row. Any window is the or of its rows, so four
reports and the occupancy of a day read days times rooms / 32,768 rows whatever the number
of bookings. Rows of the same day may be there more than once, so new earned
bookings are appended; where bookings are cancelled, their days are written anew.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.functions.measures import earned, percent
from roomledger.functions.stays import CHECK_IN, CHECK_OUT
from roomledger.operators.bookings import active_room_count, occupancy_of
from roomledger.operators.reports import ReportWindow, category_occupancy
from roomledger.sources.layout import parts_of
from roomledger.sources.tables import Tables

ARRIVAL = -1
#: Nights since year 1 fit so many bits, whatever the dates.
LEVELS = 22
KEY = ("size", "day", "block", "bucket")
#: Bitmaps per file, 8 MB.
FILE_ROWS = 2048


def _day_number(value: Column) -> Column:
    return F.date_diff(value, F.expr("DATE '0001-01-01'"))


def room_days(bookings: DataFrame, parts: int | None = None) -> DataFrame:
    """``(size, day, block, bucket, rooms)`` of the earned bookings given, in their order by
    partitions, ``parts`` if given.

    ``size`` is -1 for arrivals, which have a ``day``. Stays are blocks of 2^size nights, few
    per stay however long it is: block b of size k holds the nights from b * 2^k. Room numbers
    are exchanged and sorted, and become bitmaps one after the other in the tasks that write
    them: most bitmaps hold few rooms, and sorting 4 KB for each would fill the memory.
    """
    held = bookings.where(earned()).select("room_id", CHECK_IN, CHECK_OUT)
    arrivals = held.select(
        "room_id", F.lit(ARRIVAL).alias("size"), F.col(CHECK_IN).alias("day"), F.lit(0).alias("block")
    )
    # the blocks that begin or end a stay at each size, and lie wholly within it
    nights = held.where(F.col(CHECK_IN) < F.col(CHECK_OUT)).select(
        "room_id", _day_number(F.col(CHECK_IN)).alias("a"), _day_number(F.col(CHECK_OUT)).alias("z")
    )
    up = "((a + shiftleft(1, k) - 1) div shiftleft(1, k))"
    down = "(z div shiftleft(1, k))"
    blocks = F.expr(
        f"""inline(flatten(transform(sequence(0, {LEVELS - 1}), k -> filter(array(
            CASE WHEN {up} < {down} AND {up} % 2 = 1 THEN (k AS size, CAST({up} AS INT) AS block) END,
            CASE WHEN {up} < {down} AND {down} % 2 = 1 THEN (k AS size, CAST({down} - 1 AS INT) AS block) END
        ), b -> b IS NOT NULL))))"""
    )
    stays = nights.select("room_id", blocks).select(
        "room_id", "size", F.lit(None).cast("date").alias("day"), "block"
    )
    held = arrivals.unionByName(stays).select(
        "size", "day", "block", F.bitmap_bucket_number("room_id").alias("bucket"), F.bitmap_bit_position("room_id").alias("_at")
    )
    ranged = held.repartitionByRange(parts, *KEY) if parts else held.repartitionByRange(*KEY)
    # ranges and order are those of the groups, so nothing is exchanged or sorted again
    return ranged.sortWithinPartitions(*KEY).groupBy(*KEY).agg(F.bitmap_construct_agg("_at").alias("rooms"))


def write_room_days(bookings: DataFrame, path: str, files: int | None = None) -> None:
    """Files of few bitmaps each: compressed they are small, and a task reads many bytes."""
    rows = room_days(bookings, files or parts_of(bookings.sparkSession))
    rows.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def append_room_days(bookings: DataFrame, path: str) -> None:
    """Adds the rooms of new earned bookings; a booking given twice changes nothing."""
    room_days(bookings).write.mode("append").option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def _rooms_per_day(stored: DataFrame, window: ReportWindow) -> DataFrame:
    arrivals = stored.where(F.col("size") == ARRIVAL).withColumnRenamed("day", CHECK_IN)
    # a number of partitions that bitmaps fit however well they compress
    spread = arrivals.where(window.arriving()).repartition(parts_of(stored.sparkSession), CHECK_IN, "bucket")
    merged = spread.groupBy(CHECK_IN, "bucket").agg(F.bitmap_or_agg("rooms").alias("rooms"))
    return merged.groupBy(F.col(CHECK_IN).alias("date")).agg(
        F.sum(F.bitmap_count("rooms")).alias("occupied_rooms")
    )


def occupancy_average(t: Tables, stored: DataFrame, window: ReportWindow) -> DataFrame:
    """As the report of the same name."""
    days = _rooms_per_day(stored, window).agg(
        F.sum("occupied_rooms").alias("rooms"), F.count(F.lit(1)).alias("days")
    )
    rate = percent(F.col("rooms"), F.col("days") * active_room_count(t))
    return days.select(F.coalesce(rate, F.lit(0.0)).alias("avg_occupancy_rate"))


def occupancy_by_date(t: Tables, stored: DataFrame, window: ReportWindow) -> DataFrame:
    rate = percent(F.col("occupied_rooms"), active_room_count(t))
    return _rooms_per_day(stored, window).withColumn("occupancy_rate", rate).orderBy("date")


def occupancy_by_category(t: Tables, stored: DataFrame, window: ReportWindow) -> DataFrame:
    arrivals = stored.where(F.col("size") == ARRIVAL).withColumnRenamed("day", CHECK_IN)
    merged = arrivals.where(window.arriving()).groupBy("bucket").agg(F.bitmap_or_agg("rooms").alias("rooms"))
    # active rooms meet the bitmap of their bucket: one row for 32,768 of them
    ids = t.rooms.where("is_active").select(F.col("id").alias("_booked"))
    at = F.bitmap_bit_position("_booked")
    byte = F.conv(F.hex(F.substring("rooms", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")
    met = F.pmod(byte, bit * 2) >= bit
    booked = ids.withColumn("bucket", F.bitmap_bucket_number("_booked")).join(merged, "bucket").where(met)
    return category_occupancy(t, booked.select("_booked"))


def current_occupancy(t: Tables, stored: DataFrame, today: dt.date) -> DataFrame:
    """As the query of the same name: of each size, the one block that holds the day."""
    number = today.toordinal() - 1
    blocks = [(F.col("size") == k) & (F.col("block") == number >> k) for k in range(LEVELS)]
    held = blocks[0]
    for one in blocks[1:]:
        held = held | one
    merged = stored.where(held).groupBy("bucket").agg(F.bitmap_or_agg("rooms").alias("rooms"))
    return occupancy_of(
        merged.agg(F.coalesce(F.sum(F.bitmap_count("rooms")), F.lit(0)).alias("occupied_rooms")), t
    )
