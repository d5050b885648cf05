"""Run times of weekly and monthly schedules as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Runs are on Mondays at six.
DAY, HOUR = 0, 6
_NAMES = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def _at(day: Column, hour: int) -> Column:
    return day.cast("timestamp") + F.make_interval(hours=F.lit(hour))


def first_of_month(day: Column, weekday: int = DAY, hour: int = HOUR) -> Column:
    """The hour on the first such weekday of day's month."""
    return _at(F.next_day(F.date_sub(F.trunc(day, "month"), 1), _NAMES[weekday]), hour)


def next_weekly(ts: Column, weekday: int = DAY, hour: int = HOUR) -> Column:
    """The next such weekday at the hour: today before that hour, else within seven days."""
    day = F.to_date(ts)
    today = _at(day, hour)
    return F.when((F.weekday(ts) == weekday) & (F.hour(ts) < hour), today).otherwise(_at(F.next_day(day, _NAMES[weekday]), hour))


def next_monthly(ts: Column, weekday: int = DAY, hour: int = HOUR) -> Column:
    """The first such weekday of the next month at the hour."""
    return first_of_month(F.add_months(F.trunc(ts, "month"), 1), weekday, hour)


def monthly_after(ts: Column, weekday: int = DAY, hour: int = HOUR) -> Column:
    """The first monthly run after ts, in its own month or the next."""
    own = first_of_month(F.to_date(ts), weekday, hour)
    return F.when(ts < own, own).otherwise(next_monthly(ts, weekday, hour))
