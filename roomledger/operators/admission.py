"""Batch admission of booking requests.

Requests are judged in the order of their time and id, as if they had come
one by one: an accepted request blocks the later ones that share a night of
its room.

Only the first request for a given room and stay can ever be accepted: if it
is, the later ones collide with it; if it is not, the booking that stopped it
stops them too. Requests therefore fold to one row per room and stay before
anything is shuffled, and all further work is bounded by the calendar instead
of by the number of requests, however many of them want the same room. For the
same reason a stay that holds an earlier one of the same arrival is hopeless,
which leaves a busy room a handful of stays per day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roomledger.functions.clock import day, timestamp
from roomledger.functions.measures import BLOCKING, status_in
from roomledger.functions.stays import CHECK_IN, CHECK_OUT
from roomledger.operators.bookings import TAX_RATE, quoted
from roomledger.plans.keyed import renamed
from roomledger.sources.schema import schema_of

STAY = ["room_id", CHECK_IN, CHECK_OUT]

# Reasons, in the order in which they are tried.
INVALID = "missing_or_invalid_field"
BAD_DATES = "check_out_not_after_check_in"
IN_PAST = "check_in_in_past"
TOO_FAR = "check_in_too_far_ahead"
NO_ROOM = "room_missing_or_inactive"
TOO_MANY = "guests_exceed_capacity"
TAKEN = "room_not_available"


def _screen(
    requests: DataFrame, rooms: DataFrame, today: dt.date, max_advance_days: int | None
) -> DataFrame:
    """Requests with room data and the first rule they fail on their own."""
    active = renamed(
        rooms.where("is_active"),
        room_id="id",
        price_per_night="price_per_night",
        max_occupancy="max_occupancy",
    )
    guests = F.col("adults") + F.coalesce("children", F.lit(0))
    too_far: Column = F.lit(False)
    if max_advance_days is not None:
        too_far = F.col(CHECK_IN) > day(today + dt.timedelta(days=max_advance_days))
    incomplete = (
        F.col("room_id").isNull()
        | F.col(CHECK_IN).isNull()
        | F.col(CHECK_OUT).isNull()
        | (F.coalesce("adults", F.lit(0)) < 1)
    )
    reason = (
        F.when(incomplete, INVALID)
        .when(F.col(CHECK_IN) >= F.col(CHECK_OUT), BAD_DATES)
        .when(F.col(CHECK_IN) < day(today), IN_PAST)
        .when(too_far, TOO_FAR)
        .when(F.col("max_occupancy").isNull(), NO_ROOM)
        .when(guests > F.col("max_occupancy"), TOO_MANY)
    )
    return requests.join(active, "room_id", "left").withColumn("_reason", reason)


def _contenders(stays: DataFrame) -> DataFrame:
    """Stays that may still win: shorter than all earlier ones of their arrival.

    An earlier stay within this one either wins and collides with it, or loses
    to something that collides with this one too.
    """
    earlier = (
        Window.partitionBy("room_id", CHECK_IN)
        .orderBy("rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shortest = F.min(CHECK_OUT).over(earlier)
    return (
        stays.withColumn("_shortest", shortest)
        .where(F.col("_shortest").isNull() | (F.col(CHECK_OUT) < F.col("_shortest")))
        .drop("_shortest")
    )


def _free_stays(stays: DataFrame, bookings: DataFrame) -> DataFrame:
    """The stays that collide with no open booking of their room.

    A booking collides if it begins before the stay ends and ends after the
    stay begins, so it is enough to know the latest end among the bookings
    that begin before the stay ends: a running maximum over the days of a
    room. Bookings fold to one row per room and first day before that, so
    neither long stays nor busy rooms make rows.
    """
    begins = (
        bookings.where(status_in(BLOCKING) & F.col("room_id").isNotNull())
        .groupBy("room_id", F.col(CHECK_IN).alias("day"))
        .agg(F.max(CHECK_OUT).alias("held_until"))
    )
    asked = stays.select("room_id", F.col(CHECK_OUT).alias("day"), CHECK_IN, "rank")
    # On one day a stay that ends stands before a booking that begins.
    line = Window.partitionBy("room_id").orderBy("day", F.desc_nulls_last("rank.request_id"))
    until = F.max("held_until").over(line.rowsBetween(Window.unboundedPreceding, -1))
    placed = asked.unionByName(begins, allowMissingColumns=True).withColumn("_until", until)
    free = F.col("_until").isNull() | (F.col("_until") <= F.col(CHECK_IN))
    return placed.where(F.col("rank").isNotNull() & free).select(
        "room_id", CHECK_IN, F.col("day").alias(CHECK_OUT), "rank"
    )


def _first_come(stays: DataFrame) -> DataFrame:
    """Ids accepted when the stays of a room are taken in ``rank`` order.

    A room's stays fall into islands that share no night; each island is
    judged by itself. The array of an island holds distinct stays only.
    """
    earlier = (
        Window.partitionBy("room_id")
        .orderBy(CHECK_IN, CHECK_OUT)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    running = (
        Window.partitionBy("room_id")
        .orderBy(CHECK_IN, CHECK_OUT)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    reach = F.max(CHECK_OUT).over(earlier)
    begins = F.when(reach.isNull() | (F.col(CHECK_IN) >= reach), 1).otherwise(0)
    islands = stays.withColumn("_begins", begins).withColumn(
        "_island", F.sum("_begins").over(running)
    )
    entry = F.struct("rank", CHECK_IN, CHECK_OUT)
    queues = islands.groupBy("room_id", "_island").agg(
        F.array_sort(F.collect_list(entry)).alias("queue")
    )

    def admit(admitted: Column, stay: Column) -> Column:
        collides = F.exists(
            admitted,
            lambda held: (held[CHECK_IN] < stay[CHECK_OUT]) & (stay[CHECK_IN] < held[CHECK_OUT]),
        )
        return F.when(collides, admitted).otherwise(F.concat(admitted, F.array(stay)))

    nobody = F.filter("queue", lambda stay: F.lit(False))
    admitted = F.aggregate("queue", nobody, admit)
    return queues.select(F.explode(admitted).alias("stay")).select(
        F.col("stay.rank.request_id").alias("request_id"), F.lit(True).alias("_admitted")
    )


def admit_bookings(
    requests: DataFrame,
    bookings: DataFrame,
    rooms: DataFrame,
    as_of: dt.datetime,
    tax_rate: str = TAX_RATE,
    max_advance_days: int | None = None,
) -> DataFrame:
    """Each request with ``accepted``, the reason if not, and its price.

    ``requests`` needs request_id (unique), requested_at, room_id, the stay,
    adults and children; other columns pass through. Rows with a missing or
    impossible field are refused first.
    """
    today = as_of.date()
    screened = _screen(requests, rooms, today, max_advance_days)
    stays = (
        screened.where(F.col("_reason").isNull())
        .groupBy(*STAY)
        .agg(F.min(F.struct("requested_at", "request_id")).alias("rank"))
    )
    free = _free_stays(_contenders(stays), bookings)
    judged = screened.join(_first_come(free), "request_id", "left")
    accepted = F.col("_admitted").isNotNull()
    priced = quoted(judged, tax_rate)
    return priced.select(
        *requests.columns,
        accepted.alias("accepted"),
        F.when(~accepted, F.coalesce("_reason", F.lit(TAKEN))).alias("reason"),
        *[
            F.when(accepted, F.col(name)).alias(alias)
            for name, alias in (
                ("nights", "nights"),
                ("subtotal", "subtotal"),
                ("tax_amount", "tax_amount"),
                ("quote_total", "total_amount"),
            )
        ],
    )


def admitted_bookings(outcomes: DataFrame, customers: DataFrame, as_of: dt.datetime) -> DataFrame:
    """New booking rows of the accepted requests.

    Guests are found by e-mail, so ``upsert_customers`` runs first. The
    reference is made of the request id; the store assigns the booking id.
    """
    known = customers.select(
        F.col("id").alias("customer_id"), F.lower("email").alias("_email")
    )
    rows = (
        outcomes.where("accepted")
        .withColumn("_email", F.lower("email"))
        .join(known, "_email", "left")
        .withColumn("booking_reference", F.concat(F.lit("RQ"), F.col("request_id").cast("string")))
        .withColumn("children", F.coalesce("children", F.lit(0)))
        .withColumn("booking_status", F.lit("pending"))
        .withColumn("payment_status", F.lit("pending"))
        .withColumn("source", F.lit("direct"))
        .withColumn("created_at", timestamp(as_of))
        .withColumn("updated_at", timestamp(as_of))
    )
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema_of("bookings").fields
        ]
    )
