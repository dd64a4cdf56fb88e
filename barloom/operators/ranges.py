"""Date ranges that also prune the partitions of stored bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.calendar import as_date
from barloom.schema import PERIOD_COLUMNS


def period_of(day: Column, grain: str) -> Column:
    """Period number of a date: 2024, 202403 or 20240315."""
    if grain == "year":
        return F.year(day)
    if grain == "month":
        return F.year(day) * 100 + F.month(day)
    if grain == "day":
        return F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)
    raise ValueError(f"grain must be one of {', '.join(PERIOD_COLUMNS)}")


def periods_between(first: Column, last: Column, grain: str) -> Column:
    """All period numbers from one date to another."""
    step = {"year": "interval 1 year", "month": "interval 1 month", "day": "interval 1 day"}[grain]
    start = F.trunc(first, grain) if grain != "day" else first
    return F.transform(F.sequence(start, last, F.expr(step)), lambda day: period_of(day, grain))


def grain_of(rows: DataFrame) -> str | None:
    """Grain of the partition column, or None for rows that are not from stored bars."""
    return next((g for g, name in PERIOD_COLUMNS.items() if name in rows.columns), None)


def in_range(
    rows: DataFrame,
    date_from: Column | dt.date | str | None = None,
    date_to: Column | dt.date | str | None = None,
) -> DataFrame:
    """Rows in the inclusive date range; an absent bound does not restrict.

    On stored bars each bound also becomes a filter on the partition column. A
    bound may be a scalar subquery: Spark runs it first and prunes with its result.
    """
    day, grain = F.col("trade_date"), grain_of(rows)
    keep = []
    for bound, passes in ((date_from, Column.__ge__), (date_to, Column.__le__)):
        if bound is None:
            continue
        keep.append(passes(day, as_date(bound)))
        if grain:
            period = F.col(PERIOD_COLUMNS[grain])
            keep.append(passes(period, period_of(as_date(bound), grain)))
    for condition in keep:
        rows = rows.where(condition)
    return rows
