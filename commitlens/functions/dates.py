"""Calendar keys of the statistics views (session time zone is UTC).

Weeks start on Monday and are numbered ISO-wise, while ``year`` is the calendar
year, so a week that straddles New Year yields two keys - as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(ts) -> Column:
    return F.to_date(_col(ts))


def week_start(ts) -> Column:
    return F.date_trunc("week", _col(ts)).cast("date")


def month_start(ts) -> Column:
    return F.date_trunc("month", _col(ts)).cast("date")


def year_month(ts) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def iso_week(ts) -> Column:
    return F.weekofyear(_col(ts))


def whole_days_between(first, last) -> Column:
    """Whole days in ``last - first`` (floor), as INT."""
    micros = F.unix_micros(_col(last)) - F.unix_micros(_col(first))
    return F.floor(micros / F.lit(86_400_000_000)).cast("int")


def iso_weekday(ts) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return F.weekday(_col(ts)) + 1
