"""Providers: named sources of bars that the ingest job can pull from.

A provider turns its landed input into a :class:`Feed`. Two kinds come with the
package, landed payload files and an existing table of bars; anything with a
``name``, ``history`` and ``summary`` can take their place.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.calendar import as_date
from barloom.operators.latest import latest_on_or_before, newest_rows
from barloom.operators.ranges import in_range
from barloom.schema import FACTS, STOCK_COLUMNS
from barloom.sources.payloads import Feed, landing_files, read_history, read_summary


class Provider(Protocol):
    """What the ingest job needs from a source."""

    name: str

    def history(self) -> Feed:
        """All rows the source holds, ready for :func:`pull_window`."""

    def summary(self, day: dt.date | None) -> Feed:
        """One row per symbol: its newest on or before ``day``."""


def pull_window(
    rows: DataFrame,
    date_from: dt.date | str | None = None,
    date_to: dt.date | str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """What one pull returns: the range first, then the newest bars per ticker if a limit is given."""
    rows = in_range(rows, date_from, date_to)
    if limit is None:
        return rows
    if limit < 1:
        raise ValueError("a pull limit must be positive")
    return newest_rows(rows, limit)


@dataclass(frozen=True)
class LandedProvider:
    """Payload files that a downloader has put under ``path``."""

    spark: SparkSession
    name: str
    path: str
    one_per_line: bool = False

    def _landed(self) -> DataFrame:
        return landing_files(self.spark, self.path, self.one_per_line)

    def history(self) -> Feed:
        return read_history(self._landed(), self.name)

    def summary(self, day: dt.date | None = None) -> Feed:
        feed = read_summary(self._landed(), self.name)
        if day is None:
            return feed
        # A summary request names one date; rows without a readable date stay for quarantine.
        keep = F.col("trade_date").isNull() | (F.col("trade_date") == as_date(day))
        return Feed(feed.parsed.where(keep))


@dataclass(frozen=True)
class TableProvider:
    """An existing table of bars with its stocks, such as another store."""

    name: str
    bars: DataFrame
    stocks: DataFrame

    def _feed(self, bars: DataFrame) -> Feed:
        rows = bars.join(self.stocks.select(*STOCK_COLUMNS), "ticker").select(
            F.lit(None).cast("timestamp").alias("arrived_at"),
            F.concat_ws("/", F.lit(self.name), "ticker").alias("payload_id"),
            F.lit(0).alias("position"),
            *STOCK_COLUMNS,
            "trade_date",
            *FACTS,
            F.lit(self.name).alias("source"),
            F.array().cast("array<string>").alias("parse_errors"),
            F.lit(None).cast("string").alias("fault"),
        )
        return Feed(rows)

    def history(self) -> Feed:
        return self._feed(self.bars)

    def summary(self, day: dt.date | None = None) -> Feed:
        bars = self.bars if day is None else self.bars.where(F.col("trade_date") <= as_date(day))
        newest = latest_on_or_before(bars, dt.date.max, ["trade_date", *FACTS])
        return self._feed(newest)
