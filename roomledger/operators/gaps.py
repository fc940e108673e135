"""Free time of rooms as gaps between stays, for many asked stays at once.

``room_search`` reads the bookings once per asked stay. Here they are folded to the gaps of
each room once, and any number of asked stays meet these: a stay fits a room if one gap
holds it. Gaps are cut into blocks of 2^k nights, and a stay looks for its first night in
the one block of each size; blocks of a room do not overlap, so a stay meets a room at most
once, however busy the room is and however long its gaps are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions.measures import BLOCKING, status_in
from roomledger.functions.stays import CHECK_IN, CHECK_OUT
from roomledger.plans.dominance import LEVELS, count_before_and_beyond
from roomledger.plans.keyed import key_set, renamed
from roomledger.sources.tables import Tables

FIRST, LAST = "DATE '0001-01-01'", "DATE '9999-12-31'"


def _blocking(t: Tables) -> DataFrame:
    known = F.col("room_id").isNotNull() & F.col(CHECK_IN).isNotNull() & F.col(CHECK_OUT).isNotNull()
    return t.bookings.where(status_in(BLOCKING) & known).select("room_id", CHECK_IN, CHECK_OUT)


def free_gaps(t: Tables) -> DataFrame:
    """``(room_id, free_from, free_to)``: the longest times without a blocking stay, of every
    room that exists. A stay of no night ends a gap and begins one.

    Stays fold to the latest end per room and first day before the shuffle, so a room has at
    most one row per calendar day. Stays that end before they begin are no part of it.
    """
    stays = _blocking(t).where(F.col(CHECK_IN) <= F.col(CHECK_OUT))
    folded = stays.groupBy("room_id", F.col(CHECK_IN).alias("begin")).agg(F.max(CHECK_OUT).alias("end"))
    edge = t.rooms.select(F.col("id").alias("room_id"), F.expr(LAST).alias("begin"), F.lit(None).cast("date").alias("end"))
    before = Window.partitionBy("room_id").orderBy("begin", F.asc_nulls_last("end")).rowsBetween(Window.unboundedPreceding, -1)
    since = F.coalesce(F.max("end").over(before), F.expr(FIRST))
    rooms = t.rooms.select(F.col("id").alias("room_id"))
    held = folded.join(rooms, "room_id", "left_semi").unionByName(edge)
    gaps = held.select("room_id", since.alias("free_from"), F.col("begin").alias("free_to"))
    return gaps.where("free_from < free_to")


def _day_number(value: Column) -> Column:
    return F.date_diff(value, F.expr(FIRST))


def _blocks(begin: str, end: str, levels: int = LEVELS) -> Column:
    """The blocks that make up the days from ``begin`` up to ``end``, numbers of days."""
    up = f"(({begin} + shiftleft(1, k) - 1) div shiftleft(1, k))"
    down = f"({end} div shiftleft(1, k))"
    return F.expr(
        f"""inline(flatten(transform(sequence(0, {levels - 1}), k -> filter(array(
            CASE WHEN {up} < {down} AND {up} % 2 = 1 THEN (k AS size, CAST({up} AS INT) AS block) END,
            CASE WHEN {up} < {down} AND {down} % 2 = 1 THEN (k AS size, CAST({down} - 1 AS INT) AS block) END
        ), b -> b IS NOT NULL))))"""
    )


def rooms_for_stays(t: Tables, asked: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """``(request_id, room_id, nights, total_price)`` of the active rooms that ``room_search`` finds.

    ``asked`` holds request_id, check_in_date, check_out_date, guests and optionally category_id;
    stays without a night find nothing. ``gaps`` are stored ``free_gaps``. The price is
    nights times the rate, without tax.
    """
    gaps = free_gaps(t) if gaps is None else gaps
    numbered = gaps.select("room_id", _day_number(F.col("free_from")).alias("a"), _day_number(F.col("free_to")).alias("z"))
    cut = numbered.select("room_id", "z", _blocks("a", "z"))
    stays = asked.where(F.col(CHECK_IN) < F.col(CHECK_OUT))
    if "category_id" not in asked.columns:
        stays = stays.withColumn("category_id", F.lit(None).cast("bigint"))
    stays = stays.select(
        "request_id", CHECK_IN, CHECK_OUT, "guests", "category_id",
        _day_number(F.col(CHECK_IN)).alias("first"), _day_number(F.col(CHECK_OUT)).alias("until"),
    )
    # stays on the same days meet the gaps once
    days = stays.select(CHECK_IN, CHECK_OUT, "first", "until").distinct()
    looked = days.select("*", F.expr(f"inline(transform(sequence(0, {LEVELS - 1}), k -> (k AS size, shiftright(first, k) AS block)))"))
    free = looked.join(cut, ["size", "block"]).where("until <= z").select(CHECK_IN, CHECK_OUT, "room_id")
    free = free.join(_held_back(t, free), ["room_id", CHECK_IN, CHECK_OUT], "left_anti")
    rooms = t.rooms.where("is_active").select(
        F.col("id").alias("room_id"), "max_occupancy", "room_category_id", "price_per_night"
    )
    fits = (F.col("max_occupancy") >= F.col("guests")) & (
        F.col("category_id").isNull() | (F.col("category_id") == F.col("room_category_id"))
    )
    nights = F.date_diff(F.col(CHECK_OUT), F.col(CHECK_IN))
    return (
        free.join(rooms, "room_id")
        .join(stays.drop("first", "until"), [CHECK_IN, CHECK_OUT])
        .where(fits)
        .select("request_id", "room_id", nights.alias("nights"),
                (F.col("price_per_night") * nights).cast("decimal(14,2)").alias("total_price"))
    )


def _held_back(t: Tables, free: DataFrame) -> DataFrame:
    """The (room, days) of ``free`` that hold a stay of negative length, which blocks them."""
    back = _blocking(t).where(F.col(CHECK_IN) > F.col(CHECK_OUT))
    suspects = free.join(key_set(back, "room_id"), "room_id", "left_semi")
    counted = count_before_and_beyond(
        renamed(back.withColumn("n", F.lit(1).cast("bigint")), room_id="room_id", x=CHECK_IN, y=CHECK_OUT, n="n"),
        renamed(suspects, room_id="room_id", x=CHECK_OUT, y=CHECK_IN), "room_id", "_n",
    )
    return counted.where("_n > 0").select("room_id", F.col("y").alias(CHECK_IN), F.col("x").alias(CHECK_OUT))


def _free_starts(t: Tables, gaps: DataFrame) -> DataFrame:
    """``(room_id, a, b, z)``, numbers of days: a stay that begins from ``a`` to before ``b`` is
    free if it ends by ``z``, and is so by one row only of a gap.

    Stays of negative length cut the gap around them: who begins before such an end must
    leave by its begin. After the last of them ``z`` alone decides, so there ``b`` is
    rounded up to a day that makes few blocks.
    """
    back = _blocking(t).where(F.col(CHECK_IN) > F.col(CHECK_OUT)).groupBy(
        "room_id", _day_number(F.col(CHECK_OUT)).alias("p")
    ).agg(F.min(_day_number(F.col(CHECK_IN))).alias("q"))
    cuts = back.groupBy("room_id").agg(F.collect_list(F.struct("p", "q")).alias("_all"))
    days = gaps.select("room_id", _day_number(F.col("free_from")).alias("f"), _day_number(F.col("free_to")).alias("t"))
    within = F.expr("sort_array(filter(_all, c -> f < c.p AND c.q < t))")
    cut = days.join(cuts, "room_id", "left").select("room_id", "f", "t", within.alias("c"))
    cut = cut.withColumn("n", F.expr("coalesce(array_size(c), 0)"))
    pieces = F.expr(
        """inline(transform(sequence(0, n), i -> named_struct(
            'a', IF(i = 0, f, get(c, i - 1).p), 'b', get(c, i).p,
            'z', IF(i < n, array_min(transform(slice(c, i + 1, n), x -> x.q)), t))))"""
    )
    open_ = "shiftleft(1, length(bin(t - a)))"
    end = F.expr(f"CAST(coalesce(b, (t + {open_} - 1) div {open_} * {open_}) AS INT)")
    return cut.select("room_id", "t", pieces).where("a < t").select("room_id", "a", end.alias("b"), "z")


def _free_kinds(t: Tables, asked: DataFrame, gaps: DataFrame) -> DataFrame:
    """``asked`` (check_in_date, check_out_date, guests, category) with the number of rooms that
    are free and fit, and their lowest price per night; those that find none are left out.

    No stay meets a room: free times fold per kind of room, block of days and last day to a
    count and a price, which are summed up from the latest day as in ``plans/dominance``. A
    stay reads one row per kind that fits and size of block, however many rooms there are.
    """
    kind = ["occupancy", "category"]
    rooms = t.rooms.where("is_active AND max_occupancy IS NOT NULL").select(
        F.col("id").alias("room_id"),
        F.col("max_occupancy").alias("occupancy"),
        # categories are told apart only where stays ask for one
        _category("room_category_id" if "category" in asked.columns else None).alias("category"),
        F.col("price_per_night").alias("price"),
    )
    wanted = asked if "category" in asked.columns else asked.withColumn("category", _category(None))
    fits = "filter(kinds, k -> k.occupancy >= guests AND (category = '' OR k.category = category))"
    kinds = rooms.agg(F.collect_set(F.struct(*kind))).scalar()
    keys = [CHECK_IN, CHECK_OUT, "guests", "category"]
    # one size more than days have bits: ends are rounded up
    sizes = f"sequence(0, {LEVELS})"
    looked = (
        wanted.withColumn("kinds", kinds)
        .select(*keys, F.expr(f"explode({fits})").alias("k"))
        .withColumns({"first": _day_number(F.col(CHECK_IN)), "z": _day_number(F.col(CHECK_OUT))})
        .select(*[F.col(c).alias(f"_{c}") for c in keys], "z", "k.*",
                F.expr(f"inline(transform({sizes}, k -> (k AS size, shiftright(first, k) AS block)))"))
    )
    place = [*kind, "size", "block"]
    free = _free_starts(t, gaps).join(rooms, "room_id").select(*kind, "z", "price", _blocks("a", "b", LEVELS + 1))
    there = free.select(*place, "z", F.lit(1).cast("bigint").alias("n"), "price")
    ends = looked.select(*place, "z", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast(rooms.schema["price"].dataType).alias("price"))
    folded = there.unionByName(ends).groupBy(*place, "z").agg(F.sum("n").alias("n"), F.min("price").alias("price"))
    later = Window.partitionBy(*place).orderBy(F.desc("z")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = folded.select(*place, "z", F.sum("n").over(later).alias("n"), F.min("price").over(later).alias("price"))
    return (
        looked.join(reached.where("n > 0"), [*place, "z"])
        .groupBy(*[F.col(f"_{c}").alias(c) for c in keys])
        .agg(F.sum("n").cast("bigint").alias("n"), F.min("price").alias("price"))
    )


def _category(name: str | None) -> Column:
    """A category as text, empty where there is none."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")


def free_room_counts(t: Tables, asked: DataFrame, gaps: DataFrame | None = None) -> DataFrame:
    """How many rooms each asked stay finds and the lowest price; stays that find none have 0.

    The rooms are those of ``rooms_for_stays``, counted without listing them.
    """
    keys = [CHECK_IN, CHECK_OUT, "guests"]
    stays = asked.where(F.col(CHECK_IN) < F.col(CHECK_OUT)).select("request_id", *keys, *(
        [_category("category_id").alias("category")] if "category_id" in asked.columns else []
    ))
    keys = stays.columns[1:]
    free = _free_kinds(t, stays.select(*keys).distinct(), free_gaps(t) if gaps is None else gaps)
    lowest = (F.col("price") * F.date_diff(F.col(CHECK_OUT), F.col(CHECK_IN))).cast("decimal(14,2)")
    found = stays.join(free, keys).groupBy("request_id").agg(
        F.sum("n").alias("n"), F.min(lowest).alias("lowest_price")
    )
    return asked.join(found, "request_id", "left").select(
        "request_id", CHECK_IN, CHECK_OUT, F.coalesce("n", F.lit(0)).alias("free_rooms"), "lowest_price"
    )
