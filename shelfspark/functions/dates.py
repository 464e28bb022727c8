"""Date helpers: the ``as_of`` clock, day differences and report periods."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = ("today", "week", "month", "year")


def as_date(d: dt.date | str) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(d)


def lit_date(d: dt.date | str) -> Column:
    return F.lit(as_date(d))


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """``later - earlier`` in whole days as BIGINT (date minus date)."""
    return F.datediff(later, earlier).cast("long")


def period_bounds(period: str, as_of: dt.date | str) -> tuple[dt.date, dt.date]:
    """First and last day of a report period ending on ``as_of``.

    ``week`` starts on Monday; any period outside ``PERIODS`` is rejected.
    """
    d = as_date(as_of)
    if period == "today":
        return d, d
    if period == "week":
        return d - dt.timedelta(days=d.weekday()), d
    if period == "month":
        return d.replace(day=1), d
    if period == "year":
        return d.replace(month=1, day=1), d
    raise ValueError(f"Invalid period: {period!r}")


def in_period(ts_col: Column | str, period: str, as_of: dt.date | str) -> Column:
    """``DATE(ts) BETWEEN start AND end``. Spark unwraps this to a range on the raw column."""
    start, end = period_bounds(period, as_of)
    return F.to_date(ts_col).between(F.lit(start), F.lit(end))


def lit_ntz(ts: dt.datetime) -> Column:
    """A wall-clock TIMESTAMP_NTZ literal, independent of the session and process time zones."""
    return F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz")
