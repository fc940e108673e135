from __future__ import annotations

import datetime as dt

from hypothesis import given
from hypothesis import strategies as st

from roomledger.functions.clock import first_whole_day, months_back, period_start


def test_month_end_is_clamped():
    assert months_back(dt.datetime(2024, 3, 31, 8), 1) == dt.datetime(2024, 2, 29, 8)
    assert months_back(dt.datetime(2024, 2, 29), 12) == dt.datetime(2023, 2, 28)
    assert months_back(dt.datetime(2001, 12, 1), -1) == dt.datetime(2002, 1, 1)


def test_unknown_period_means_month():
    as_of = dt.datetime(2001, 6, 15, 12)
    assert period_start(as_of, "decade") == dt.datetime(2001, 5, 15, 12)
    assert period_start(as_of, "week") == dt.datetime(2001, 6, 8, 12)
    assert period_start(as_of, "year") == dt.datetime(2000, 6, 15, 12)


@given(st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1)))
def test_first_whole_day_is_the_earliest_midnight_not_before(moment):
    found = dt.datetime.combine(first_whole_day(moment), dt.time(0))
    assert found >= moment
    assert found - moment < dt.timedelta(days=1)


@given(
    st.datetimes(dt.datetime(1950, 1, 1), dt.datetime(2100, 1, 1)),
    st.integers(min_value=0, max_value=60),
)
def test_months_back_lands_in_the_right_month(moment, months):
    found = months_back(moment, months)
    gap = (moment.year - found.year) * 12 + moment.month - found.month
    assert gap == months
    assert found.day <= moment.day
