"""Newest rows per key.

``newest_rows`` keeps the top n, which Spark limits inside each map task before
the shuffle, so a key with very many rows sends n rows per task. ``latest_row``
is a plain aggregate with a partial step.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.operators.ranges import grain_of, in_range
from barloom.schema import PERIOD_COLUMNS


def newest_rows(
    rows: DataFrame, n: int, key: str = "ticker", order: str = "trade_date"
) -> DataFrame:
    """The ``n`` newest rows of each key."""
    newest_first = W.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rank", F.row_number().over(newest_first)).where(
        F.col("_rank") <= n
    ).drop("_rank")


def latest_row(
    rows: DataFrame,
    columns: list[str],
    key: str | list[str] = "ticker",
    order: str | Column = "trade_date",
) -> DataFrame:
    """The row with the greatest ``order`` per key.

    One ``max_by`` per column stays a hash aggregate for fixed-width columns. The
    order must be unique within the key, or the picks may come from two rows.
    """
    picks = [
        F.max(order).alias(name) if name == order else F.max_by(name, order).alias(name)
        for name in columns
    ]
    keys = [key] if isinstance(key, str) else key
    return rows.groupBy(*keys).agg(*picks)


def latest_on_or_before(
    rows: DataFrame, day: Column | dt.date | str, columns: list[str]
) -> DataFrame:
    """As-of read: the newest row per ticker not after ``day``."""
    return latest_row(in_range(rows, date_to=day), columns)


def latest_date(rows: DataFrame) -> DataFrame:
    """One row: the newest trade date of all symbols, NULL when there is none.

    Of stored bars only the newest partition is read; the subquery that finds it
    reads no column.
    """
    grain = grain_of(rows)
    if grain:
        period = PERIOD_COLUMNS[grain]
        rows = rows.where(F.col(period) == rows.agg(F.max(period)).scalar())
    return rows.agg(F.max("trade_date").alias("latest_trade_date"))


def latest_dates(rows: DataFrame) -> DataFrame:
    """The newest trade date of each symbol."""
    # Stated here so that every use gives the same plan, whose shuffle Spark can share.
    rows = rows.where(F.col("ticker").isNotNull())
    return rows.groupBy("ticker").agg(F.max("trade_date").alias("latest_trade_date"))
