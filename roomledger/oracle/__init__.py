"""Plain SQL for every query, to be run by another engine for comparison."""

from __future__ import annotations

from roomledger.oracle.base import with_tables
from roomledger.oracle import bookings, channels, customers, jobs, reports, rooms


def statements() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in (rooms, bookings, reports, customers, channels, jobs):
        for name, (needs, body) in module.SQL.items():
            found[name] = with_tables(needs, body)
    return found
