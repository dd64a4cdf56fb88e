"""Data freshness, stock details and as-of summaries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.calendar import (
    as_date,
    freshness_label,
    freshness_mode,
    is_stale,
    last_weekday,
)
from barloom.operators.latest import latest_date, latest_dates, latest_on_or_before
from barloom.operators.ranges import grain_of, in_range
from barloom.operators.runlog import latest_run
from barloom.plans.watchlist import newest_of_stored
from barloom.schema import FACTS, STOCK_COLUMNS


def _freshness(latest: Column, as_of: dt.date | str, is_mock: bool) -> list[Column]:
    stale, mock = is_stale(latest, as_of), F.lit(is_mock)
    return [
        last_weekday(as_of).alias("expected_trade_date"),
        stale.alias("is_stale"),
        mock.alias("is_mock"),
        freshness_label(stale, mock).alias("label"),
        freshness_mode(stale, mock).alias("mode"),
    ]


def freshness(
    bars: DataFrame,
    runs: DataFrame,
    *,
    as_of: dt.date | str,
    provider: str,
    repository: str,
    is_mock: bool = False,
) -> DataFrame:
    """One row: how fresh the whole table is, and how its last ingestion went."""
    run = latest_run(runs).select(F.struct("*")).scalar()
    return (
        latest_date(bars)
        .withColumn("run", run)
        .select(
            "latest_trade_date",
            *_freshness(F.col("latest_trade_date"), as_of, is_mock),
            F.lit(provider).alias("provider"),
            F.lit(repository).alias("repository"),
            F.col("run.provider").alias("ingestion_provider"),
            F.col("run.status").alias("ingestion_status"),
            F.col("run.finished_at").alias("ingestion_finished_at"),
            F.col("run.rows_received").alias("ingestion_rows_received"),
        )
    )


def freshness_by_ticker(
    bars: DataFrame, stocks: DataFrame, *, as_of: dt.date | str, is_mock: bool = False
) -> DataFrame:
    """Freshness of each stock; a stock without bars is stale."""
    if grain_of(bars):
        latest = newest_of_stored(bars, stocks, 1)
        latest = latest.select("ticker", F.col("trade_date").alias("latest_trade_date"))
    else:
        latest = latest_dates(bars)
    return (
        stocks.select("ticker")
        .join(latest, "ticker", "left")
        .select(
            "ticker",
            "latest_trade_date",
            *_freshness(F.col("latest_trade_date"), as_of, is_mock),
        )
    )


def stock_details(stocks: DataFrame, tickers: DataFrame) -> DataFrame:
    """Details of the requested tickers, in any case; unknown ones give no row."""
    asked = tickers.select(F.upper("ticker").alias("ticker")).distinct()
    return stocks.select(*STOCK_COLUMNS).join(asked, "ticker", "left_semi")


def stock_detail(stocks: DataFrame, ticker: str) -> DataFrame:
    """Details of one ticker as a pushed-down point filter."""
    return stocks.where(F.col("ticker") == ticker.upper()).select(*STOCK_COLUMNS)


def summary_as_of(bars: DataFrame, stocks: DataFrame, day: dt.date | str) -> DataFrame:
    """The newest bar on or before ``day`` of every stock that has one."""
    facts = ["trade_date", *FACTS]
    if grain_of(bars):
        newest = newest_of_stored(in_range(bars, date_to=day), stocks, 1).select("ticker", *facts)
    else:
        newest = latest_on_or_before(bars, as_date(day), facts)
    return newest.join(stocks.select("ticker", "company_name"), "ticker")
