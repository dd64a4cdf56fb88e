"""Trading-calendar expressions: windows, expected dates, staleness, labels.

``as_of`` is always an argument. Nothing here reads the clock, so a plan gives
the same answer whenever it runs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar days looked back by each timeframe; ALL has no bound.
TIMEFRAME_DAYS = {"1M": 31, "3M": 93, "6M": 186, "1Y": 366}
UNBOUNDED = "ALL"
TIMEFRAMES = [*TIMEFRAME_DAYS, UNBOUNDED]
DEFAULT_TIMEFRAME = "6M"

# The labels and display modes of the freshness badge.
LABEL_MOCK, LABEL_STALE, LABEL_CURRENT = "MOCK DATA", "STALE", "EOD CURRENT"
MODE_MOCK, MODE_STALE, MODE_CURRENT = "mock", "stale", "current"


def as_date(value: Column | dt.date | str) -> Column:
    """A date literal, or the column itself."""
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def last_weekday(day: Column | dt.date | str) -> Column:
    """``day`` itself, or the Friday before it when it falls on a weekend."""
    day = as_date(day)
    return F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))


def is_stale(latest: Column, as_of: Column | dt.date | str) -> Column:
    """True when the data is missing or older than the last expected session."""
    return latest.isNull() | (latest < last_weekday(as_of))


def lookback_days(timeframe: Column) -> Column:
    """Days a timeframe looks back; NULL for the unbounded one."""
    days = F.lit(None).cast("int")
    for name, n in TIMEFRAME_DAYS.items():
        days = F.when(timeframe == name, F.lit(n)).otherwise(days)
    return days


def window_start(explicit: Column, timeframe: Column, anchor: Column) -> Column:
    """First date of a window: the explicit bound, else ``anchor`` minus the lookback.

    NULL, meaning no lower bound, for the unbounded timeframe.
    """
    return F.coalesce(explicit, F.date_sub(anchor, lookback_days(timeframe)))


def within(day: Column, start: Column | None, end: Column | None) -> Column:
    """Inclusive date range; a bound that is absent or NULL does not restrict."""
    keep = F.lit(True)
    if start is not None:
        keep = keep & (start.isNull() | (day >= start))
    if end is not None:
        keep = keep & (end.isNull() | (day <= end))
    return keep


def freshness_label(stale: Column, mock: Column) -> Column:
    return F.when(mock, LABEL_MOCK).when(stale, LABEL_STALE).otherwise(LABEL_CURRENT)


def freshness_mode(stale: Column, mock: Column) -> Column:
    return F.when(mock, MODE_MOCK).when(stale, MODE_STALE).otherwise(MODE_CURRENT)
