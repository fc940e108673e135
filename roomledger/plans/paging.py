"""Top-k and pages that look at narrow rows first.

Sorting whole rows to keep fifty of them would shuffle every wide column. The
helpers sort only the keys, cut the page, and fetch the wide columns for the
rows of that page by a broadcast of at most ``limit`` keys.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomledger.functions.clock import timestamp
from roomledger.plans.numbering import positions

# A page up to this many rows is proven small enough to broadcast; a larger
# one is joined by whatever strategy the measured sizes call for.
BROADCAST_ROWS = 10_000


def older_than(after: tuple | None, time: str = "created_at", key: str = "id") -> Column:
    """Rows that follow the last row ``(time, id)`` of a page in newest-first order.

    A page sought by it costs as much as the first one, however deep it is, where an
    offset has to move all rows before it through one task.
    """
    if after is None:
        return F.lit(True)
    moment, last = after
    return (F.col(time) < F.lit(moment)) | ((F.col(time) == F.lit(moment)) & (F.col(key) < last))


def page_of(df: DataFrame, order: list[Column], page: int = 1, limit: int = 50) -> DataFrame:
    if page < 1 or limit < 1:
        raise ValueError("page and limit count from 1")
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_at(
    rows: DataFrame, time: str, order: list[Column], page: int = 1, limit: int = 50
) -> DataFrame:
    """``page_of`` at any depth; ``order`` begins with the falling ``time``.

    Deep pages are located first: the rows of each day are counted, at most one number per
    calendar day reaches the driver, and only the days that the page lies in are read again.
    Where these hold very many rows, they are numbered by ranges instead of being sorted
    in one task.
    """
    skip = (page - 1) * limit
    if skip <= BROADCAST_ROWS:
        return page_of(rows, order, page, limit)
    counted = rows.groupBy(F.to_date(time).alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()
    counted.sort(key=lambda r: (r["day"] is None, -r["day"].toordinal() if r["day"] else 0))
    days, held, start, before = [], 0, skip, 0
    for day, n in counted:
        if before + n > skip and before < skip + limit:
            start = start if days else before
            days.append(day)
            held += n
        before += n
    known = [d for d in days if d]
    there = F.col(time).isNull() if None in days else F.lit(False)
    if known:
        first, last = (dt.datetime.combine(d, dt.time()) for d in (known[-1], known[0]))
        there = there | (F.col(time) >= timestamp(first)) & (F.col(time) < timestamp(last + dt.timedelta(days=1)))
    near, skip = rows.where(there), skip - start
    if held > limit + BROADCAST_ROWS:
        placed = positions(near, order, "_position")
        near, skip = placed.where(F.col("_position").between(skip + 1, skip + limit)).drop("_position"), 0
    return near.orderBy(*order).offset(skip).limit(limit)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Mark ``df`` for broadcast where its row bound allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def fetch(wide: DataFrame, keys: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows of ``wide`` whose unique ``key`` is among at most ``rows`` keys."""
    return wide.join(bounded(keys.select(key), rows), key, "left_semi")


def page_count(total: Column, limit: int) -> Column:
    return F.ceil(total / F.lit(limit)).cast("bigint")
