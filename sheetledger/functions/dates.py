"""Date and time predicates (DAT); "now" is always an argument, so runs repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _moment(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp") if isinstance(now, str) else now


def this_year(ts: Column, now: str | Column) -> Column:
    return ts >= F.date_trunc("year", _moment(now))


def last_days(ts: Column, now: str | Column, days: int) -> Column:
    return ts >= _moment(now) - F.make_interval(days=F.lit(days))


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def stale(started: Column, active: Column, now: str | Column, hours: float) -> Column:
    """Strictly older than the limit and still active; an unknown start is not stale."""
    age = F.unix_micros(_moment(now)) - F.unix_micros(started)
    return F.coalesce(active & (age > hours * 3_600_000_000), F.lit(False))


def expired(ends: Column, waiting: Column, now: str | Column) -> Column:
    """Notice period over (an end exactly now counts)."""
    return F.coalesce(waiting & (ends <= _moment(now)), F.lit(False))


def seconds_between(start: Column, end: Column, digits: int = 1) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 1e6, digits)


def hours_between(start: Column, end: Column, digits: int = 2) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(start)) / 3.6e9, digits)
