"""Cancellations, status changes, guest upserts, deletions and flags."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.functions.clock import day, first_whole_day, timestamp
from roomledger.functions.measures import BLOCKING, status_in
from roomledger.plans.keyed import key_set, renamed
from roomledger.plans.numbering import number_rows, number_within
from roomledger.plans.stored import stored
from roomledger.sources.schema import BOOKING_STATUSES
from roomledger.sources.tables import Tables

NOTICE_HOURS = 24

UNKNOWN = "booking_unknown"
ALREADY = "already_cancelled"
COMPLETED = "booking_completed"
TOO_LATE = "too_close_to_check_in"


def cancel_bookings(
    requests: DataFrame, t: Tables, as_of: dt.datetime, notice_hours: int = NOTICE_HOURS
) -> DataFrame:
    """Each cancel request with ``cancelled`` and the reason if not.

    Of several requests for one booking the earliest decides; once it has
    cancelled, the others find the booking cancelled. Whole hours to the
    midnight of the arrival day count, and a no-show may be cancelled. A
    request without a reference asks for an unknown booking.
    """
    known = (
        t.bookings.join(
            t.customers.select(F.col("id").alias("customer_id")), "customer_id", "left_semi"
        )
        .join(t.rooms.select(F.col("id").alias("room_id")), "room_id", "left_semi")
        .select("booking_reference", "booking_status", "check_in_date")
    )
    # One row per asked reference: a reference asked for a million times
    # meets the bookings once.
    asked = requests.groupBy("booking_reference").agg(
        F.min(F.struct("requested_at", "request_id")).alias("_first")
    )
    deadline = day(first_whole_day(as_of + dt.timedelta(hours=notice_hours)))
    status = F.col("booking_status")
    refusal = (
        F.when(status.isNull(), UNKNOWN)
        .when(status == "cancelled", ALREADY)
        .when(status == "completed", COMPLETED)
        .when(F.col("check_in_date") < deadline, TOO_LATE)
    )
    verdicts = asked.join(known, "booking_reference", "left").select(
        F.col("booking_reference").alias("_asked"),
        F.col("_first.request_id").alias("_first_id"),
        refusal.alias("_refusal"),
    )
    first = F.col("request_id") == F.col("_first_id")
    reason = F.coalesce("_refusal", F.when(~first, ALREADY))
    same = F.col("booking_reference").eqNullSafe(F.col("_asked"))
    return requests.join(verdicts, same).select(
        *requests.columns, reason.isNull().alias("cancelled"), reason.alias("reason")
    )


def _with_status(bookings: DataFrame, changes: DataFrame) -> DataFrame:
    """Bookings overlaid with ``_key``, ``_status``, ``_changed_at``."""
    return bookings.withColumns(
        {
            "booking_status": F.coalesce("_status", "booking_status"),
            "updated_at": F.coalesce("_changed_at", "updated_at"),
        }
    ).drop("_key", "_status", "_changed_at")


def apply_cancellations(
    bookings: DataFrame, outcomes: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Bookings after the accepted cancel requests."""
    done = outcomes.where("cancelled").select(
        F.col("booking_reference").alias("_key"),
        F.lit("cancelled").alias("_status"),
        timestamp(as_of).alias("_changed_at"),
    )
    overlaid = bookings.join(done, F.col("booking_reference") == F.col("_key"), "left")
    return _with_status(overlaid, done)


def valid_status() -> Column:
    return F.coalesce(F.col("status").isin(*BOOKING_STATUSES), F.lit(False))


def latest_changes(changes: DataFrame) -> DataFrame:
    """The last valid status of each booking in a change feed.

    Folds before the shuffle: a booking that changed a million times leaves
    each map task as one row.
    """
    newest = F.max_by(
        F.struct("status", "changed_at", "change_id"), F.struct("changed_at", "change_id")
    )
    return changes.where(valid_status()).groupBy("booking_id").agg(newest.alias("c")).select(
        "booking_id", "c.status", "c.changed_at", "c.change_id"
    )


def rejected_changes(changes: DataFrame) -> DataFrame:
    return changes.where(~valid_status())


def apply_status_changes(bookings: DataFrame, changes: DataFrame) -> DataFrame:
    """Bookings after a change feed; the last valid change of each one wins.

    Changes of unknown bookings have no effect. Applying a feed twice gives
    the same table as applying it once.
    """
    newest = latest_changes(changes).select(
        F.col("booking_id").alias("_key"),
        F.col("status").alias("_status"),
        F.col("changed_at").cast("timestamp_ntz").alias("_changed_at"),
    )
    overlaid = bookings.join(newest, F.col("id") == F.col("_key"), "left")
    return _with_status(overlaid, newest)


def apply_special_requests(
    bookings: DataFrame, edits: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """Bookings with edited special requests; closed bookings keep theirs.

    ``edits`` holds one row per booking_reference.
    """
    wanted = renamed(edits, _key="booking_reference", _wanted="special_requests")
    joined = bookings.join(wanted, F.col("booking_reference") == F.col("_key"), "left")
    edited = F.col("_key").isNotNull() & ~status_in(("cancelled", "completed"))
    return joined.withColumns(
        {
            "special_requests": F.when(edited, F.col("_wanted")).otherwise(
                F.col("special_requests")
            ),
            "updated_at": F.when(edited, timestamp(as_of)).otherwise(F.col("updated_at")),
        }
    ).drop("_key", "_wanted")


def has_email() -> Column:
    return F.coalesce(F.trim("email") != "", F.lit(False))


def guests_without_email(incoming: DataFrame) -> DataFrame:
    """Incoming details that cannot be matched; ``upsert_customers`` leaves them out."""
    return incoming.where(~has_email())


def upsert_customers(incoming: DataFrame, customers: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Guests after incoming details, matched on e-mail without case.

    A known guest takes the latest name and phone only. A new one is stored
    as first seen, with the latest name and phone; new ids continue after the
    highest known id in the order of the first request. Details without an
    e-mail are in ``guests_without_email`` instead.
    """
    order = F.struct("received_at", "request_id")
    seen = incoming.where(has_email()).groupBy(F.lower("email").alias("_email")).agg(
        F.min_by(
            F.struct("email", "address", "city", "country", "postal_code", "request_id"), order
        ).alias("_first"),
        F.max_by(F.struct("first_name", "last_name", "phone"), order).alias("_last"),
    )
    held = customers.select(F.struct(*customers.columns).alias("_held"), F.lower("email").alias("_key"))
    met = stored(held.join(seen, F.col("_key") == F.col("_email"), "full"), "guests-met")
    known, touched = F.col("_held").isNotNull(), F.col("_last").isNotNull()
    added = number_rows(met.where(~known), F.col("_first.request_id"), "_number")
    kept = met.where(known).withColumn("_number", F.lit(None).cast("bigint"))
    numbered = kept.unionByName(added)
    highest = customers.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    now = timestamp(as_of)
    values = {
        "id": highest + F.col("_number"),
        **{n: F.col(f"_last.{n}") for n in ("first_name", "last_name", "phone")},
        **{
            n: F.col(f"_first.{n}")
            for n in ("email", "address", "city", "country", "postal_code")
        },
        "created_at": now,
        "updated_at": now,
    }
    moved = {n: values[n] for n in ("first_name", "last_name", "phone", "updated_at")}

    def value(field) -> Column:
        old = F.col("_held")[field.name]
        new = values.get(field.name, F.lit(None)).cast(field.dataType)
        kept = F.when(touched, moved[field.name]).otherwise(old) if field.name in moved else old
        return F.when(known, kept).otherwise(new).alias(field.name)

    action = F.when(~known, "insert").when(touched, "update").otherwise("keep")
    return numbered.select(*[value(f) for f in customers.schema.fields], action.alias("action"))


# Deletions ------------------------------------------------------------------


def deletable_customers(t: Tables) -> DataFrame:
    """Guests without a pending or confirmed booking."""
    busy = key_set(t.bookings.where(status_in(BLOCKING)), "customer_id", "id")
    return t.customers.join(busy, "id", "left_anti")


def deletable_rooms(t: Tables) -> DataFrame:
    """Rooms without a pending or confirmed booking."""
    busy = key_set(t.bookings.where(status_in(BLOCKING)), "room_id", "id")
    return t.rooms.join(busy, "id", "left_anti")


def deletable_currencies(t: Tables) -> DataFrame:
    return t.currencies.where(~F.col("is_default"))


def deletable_languages(t: Tables) -> DataFrame:
    return t.languages.where(~F.col("is_default"))


CHILDREN_OF_ROOMS = ("room_images", "room_amenities", "room_availability")


def room_cascade(t: Tables, rooms: DataFrame) -> dict[str, DataFrame]:
    """Rows that go with the given rooms: images, amenities, availability."""
    gone = rooms.select(F.col("id").alias("room_id"))
    return {
        name: getattr(t, name).join(gone, "room_id", "left_semi") for name in CHILDREN_OF_ROOMS
    }


def room_cascade_counts(t: Tables, rooms: DataFrame) -> DataFrame:
    """How many rows of each child table go with the given rooms.

    The rooms are found once: the children meet them together, as one row per
    table and room.
    """
    children = [
        getattr(t, name).select(F.lit(code).alias("code"), "room_id")
        for code, name in enumerate(CHILDREN_OF_ROOMS)
    ]
    used = children[0].unionByName(children[1]).unionByName(children[2])
    folded = used.groupBy("code", "room_id").agg(F.count(F.lit(1)).alias("n"))
    going = folded.join(rooms.select(F.col("id").alias("room_id")), "room_id", "left_semi")
    sums = going.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("code") == code, F.col("n"))), F.lit(0)).alias(name)
            for code, name in enumerate(CHILDREN_OF_ROOMS)
        ]
    )
    return sums.unpivot([], list(CHILDREN_OF_ROOMS), "table_name", "row_count")


# Flags and order --------------------------------------------------------------


def set_single_flag(
    df: DataFrame, flag: str, targets: DataFrame | int, group: str | None = None
) -> DataFrame:
    """Sets ``flag`` on one row per group and clears it on the others.

    With ``group``, ``targets`` holds (group, id) rows and groups without a
    target keep their flags; otherwise it is the one id of the whole table.
    """
    if group is None:
        return df.withColumn(flag, F.col("id") == F.lit(targets))
    chosen = targets.select(F.col(group).alias("_group"), F.col("id").alias("_target"))
    joined = df.join(chosen, F.col(group) == F.col("_group"), "left")
    value = F.when(F.col("_target").isNull(), F.col(flag)).otherwise(
        F.col("id") == F.col("_target")
    )
    return joined.withColumn(flag, value).drop("_group", "_target")


def flag_violations(df: DataFrame, flag: str, group: str | None = None) -> DataFrame:
    """Groups (or the whole table) where not exactly one row carries the flag."""
    flagged = F.count_if(F.col(flag)).alias("flagged")
    counted = df.groupBy(group).agg(flagged) if group else df.agg(flagged)
    return counted.where("flagged <> 1")


def append_room_images(t: Tables, new: DataFrame) -> DataFrame:
    """New image rows, ordered after the present images of their room.

    Images of unknown rooms are left out; new images of a room follow in the
    order of their ids.
    """
    known = new.join(t.rooms.select(F.col("id").alias("room_id")), "room_id", "left_semi")
    last = t.room_images.groupBy("room_id").agg(F.max("display_order").alias("_last"))
    return (
        number_within(known, "room_id", "id", "_number")
        .join(last, "room_id", "left")
        .withColumn(
            "display_order",
            (F.coalesce("_last", F.lit(0)) + F.col("_number")).cast("int"),
        )
        .withColumn("is_primary", F.lit(False))
        .select("id", "room_id", "image_path", "is_primary", "display_order")
    )
