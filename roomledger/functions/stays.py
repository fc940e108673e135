"""Half-open stays ``[check_in_date, check_out_date)``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from roomledger.functions.clock import day

CHECK_IN = "check_in_date"
CHECK_OUT = "check_out_date"


def nights(check_in: str = CHECK_IN, check_out: str = CHECK_OUT) -> Column:
    return F.date_diff(F.col(check_out), F.col(check_in))


def overlaps(start: dt.date, end: dt.date) -> Column:
    """Stay shares a night with ``[start, end)``, or lies strictly inside it."""
    return (F.col(CHECK_OUT) > day(start)) & (F.col(CHECK_IN) < day(end))


def in_house(today: dt.date) -> Column:
    return (F.col(CHECK_IN) <= day(today)) & (F.col(CHECK_OUT) > day(today))
