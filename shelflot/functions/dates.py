"""Calendar expressions. Every operator takes its day explicitly."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

Day = "dt.date | str | Column"


def day(value: dt.date | str | Column) -> Column:
    """A DATE column from a date, an ISO string or a column."""
    if isinstance(value, Column):
        return value.cast("date")
    if isinstance(value, dt.datetime):
        value = value.date()
    return F.lit(str(value)).cast("date")


def moment(value: dt.datetime | str | Column) -> Column:
    """A TIMESTAMP_NTZ column from a datetime, an ISO string or a column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.lit(str(value)).cast("timestamp_ntz")


def days_left(expiry: str | Column, as_of) -> Column:
    """Signed days from ``as_of`` to the expiry date; NULL when it is unknown."""
    return F.datediff(F.col(expiry) if isinstance(expiry, str) else expiry, day(as_of))


def on_or_after(ts: str, start) -> Column:
    return F.to_date(ts) >= day(start)


def between_days(ts: str, start, end=None) -> Column:
    """Calendar-day test on a timestamp, both ends inclusive, open above without ``end``.

    Catalyst rewrites the cast into a timestamp range, so the test reaches the Parquet scan.
    """
    test = on_or_after(ts, start)
    return test if end is None else test & (F.to_date(ts) <= day(end))
