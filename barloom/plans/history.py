"""Symbol history with the frequency indicator.

``history`` answers any number of requests in one plan; ``universe_history``
answers one common request for every listed symbol, without a join on requests.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.calendar import (
    DEFAULT_TIMEFRAME,
    TIMEFRAME_DAYS,
    UNBOUNDED,
    as_date,
    is_stale,
    window_start,
)
from barloom.functions.frequency import frequency_raw
from barloom.functions.prices import lots
from barloom.operators.joins import bars_for_requests, salted
from barloom.operators.latest import latest_dates, newest_rows
from barloom.operators.quality import REQUEST_RULES, assess, check_request, split
from barloom.operators.ranges import grain_of, in_range, periods_between
from barloom.schema import PERIOD_COLUMNS
from barloom.session import working_folder

BAR_FACTS = [
    "trade_date", "open", "high", "low", "close", "previous",
    "volume_shares", "value_idr", "frequency",
]


class History(NamedTuple):
    """One header row per request, the bars of all requests, and the requests that break a rule, with reasons."""

    header: DataFrame
    bars: DataFrame
    rejected: DataFrame | None = None


def bar_view(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The bar columns a reader sees, with lots and both forms of the indicator."""
    volume, frequency = F.col("volume_shares"), F.col("frequency")
    return rows.select(
        *keep,
        *BAR_FACTS,
        lots(volume).alias("volume_lots"),
        frequency_raw(volume, frequency).alias("raw_shares"),
        frequency_raw(volume, frequency, unit="lots").alias("raw_lots"),
    )


def resolve(requests: DataFrame, bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Requests with their stock and first date; ``listed`` is false for unknown symbols.

    Only requests that need the symbol's latest date have it looked up.
    """
    asked = requests.withColumn("ticker", F.upper("ticker"))
    known = stocks.select("ticker", "company_name", F.lit(True).alias("listed"))
    open_ended = asked.where(
        F.col("date_from").isNull()
        & F.col("date_to").isNull()
        & (F.col("timeframe") != UNBOUNDED)
    ).select("ticker").distinct()
    latest = latest_dates(bars.join(open_ended, "ticker", "left_semi"))
    anchor = F.coalesce("date_to", "latest_trade_date", "as_of")
    # What is known of a symbol goes to its slices, so requests aren't shuffled by ticker alone.
    dealt = salted(asked)
    facts = (
        dealt.select("ticker", "slice").distinct().join(known, "ticker", "left").join(latest, "ticker", "left")
    )
    return (
        dealt.join(facts, ["ticker", "slice"])
        .select(
            *requests.columns,
            "company_name",
            F.coalesce("listed", F.lit(False)).alias("listed"),
            window_start(F.col("date_from"), F.col("timeframe"), anchor).alias("start"),
        )
    )


def request_rows(resolved: DataFrame, bars: DataFrame) -> DataFrame:
    """Bars of each listed request; a row limit keeps the newest of its window."""
    wanted = resolved.where("listed").select(
        "request_id", "ticker", "company_name", "start", "date_to", "row_limit"
    )
    offered = bars.select("ticker", *BAR_FACTS)
    # Only requests with a limit are ranked, where the join has put them.
    newest_first = W.partitionBy("ticker", "slice", "request_id").orderBy(F.desc("trade_date"))
    limited = (
        bars_for_requests(wanted.where(F.col("row_limit").isNotNull()), offered, keep_slice=True)
        .withColumn("rank", F.row_number().over(newest_first))
        .where(F.col("rank") <= F.col("row_limit"))
        .drop("rank", "slice")
    )
    return bars_for_requests(wanted.where(F.col("row_limit").isNull()), offered).unionByName(limited)


def prune_to_requests(bars: DataFrame, resolved: DataFrame) -> DataFrame:
    """Restrict stored bars to the dates any request can reach.

    A request without a bound opens the range on that side.
    """
    reach = resolved.where("listed").agg(
        F.min(F.coalesce("start", as_date("0001-01-01"))).alias("first"),
        F.max(F.coalesce("date_to", as_date("9999-12-31"))).alias("last"),
    )
    return in_range(bars, reach.select("first").scalar(), reach.select("last").scalar())


def _header(
    asked: DataFrame, rows: DataFrame, key: str, as_of: Column, provider: str, is_mock: bool
) -> DataFrame:
    """Header rows. An empty window falls back to the bounds that were asked for."""
    span = rows.groupBy(key).agg(
        F.min("trade_date").alias("first_date"),
        F.max("trade_date").alias("latest_trade_date"),
        F.count("*").alias("n_bars"),
    )
    return asked.join(span, key, "left").select(
        *dict.fromkeys([key, "ticker"]),
        "company_name",
        F.coalesce("first_date", "start").alias("date_from"),
        F.coalesce("latest_trade_date", "date_to").alias("date_to"),
        "latest_trade_date",
        is_stale(F.col("latest_trade_date"), as_of).alias("is_stale"),
        F.lit(is_mock).alias("is_mock"),
        F.lit(provider).alias("source"),
        F.coalesce("n_bars", F.lit(0)).alias("n_bars"),
    )


def history(
    bars: DataFrame,
    stocks: DataFrame,
    requests: DataFrame,
    *,
    provider: str,
    is_mock: bool = False,
    prune: bool = False,
) -> History:
    """Answer a frame of requests (:data:`barloom.schema.HISTORY_REQUEST`).

    ``prune`` suits stored bars, where the dates reachable by the requests cut
    partitions. Requests that break a rule are not answered but returned; those
    for unknown symbols are in :func:`not_found`.
    """
    valid, rejected = split(assess(requests, REQUEST_RULES))
    resolved = resolve(valid, bars, stocks)
    if prune:  # its bounds and its rows are asked for one after the other
        path = working_folder(bars.sparkSession, "requests")
        resolved.write.parquet(path)
        resolved = bars.sparkSession.read.schema(resolved.schema).parquet(path)
    rows = request_rows(resolved, prune_to_requests(bars, resolved) if prune else bars)
    header = _header(
        resolved.where("listed"), rows, "request_id", F.col("as_of"), provider, is_mock
    )
    return History(header, bar_view(rows, ["request_id", "ticker", "company_name"]), rejected)


def symbol_history(
    bars: DataFrame,
    stocks: DataFrame,
    ticker: str,
    *,
    timeframe: str = DEFAULT_TIMEFRAME,
    date_from: dt.date | str | None = None,
    date_to: dt.date | str | None = None,
    row_limit: int | None = None,
) -> DataFrame:
    """The bars of one symbol, oldest first; a row limit keeps the newest of the window.

    The ticker is a plain filter that reaches the scan, and so are all bounds: an
    open-ended window is anchored by one look at the symbol's own dates. An
    unknown symbol is an error. A symbol has at most one bar a day, which bounds
    the sort.
    """
    check_request(timeframe, row_limit)
    name = ticker.upper()
    stock = stocks.where(F.col("ticker") == name).select("company_name").first()
    if stock is None:
        raise LookupError(f"unknown ticker {name}")
    own = bars.where(F.col("ticker") == name)
    days = TIMEFRAME_DAYS.get(timeframe)
    if date_from is None and days is not None:
        last = date_to or own.agg(F.max("trade_date")).first()[0]
        if last is not None:
            date_from = F.date_sub(as_date(last), days)
    rows = in_range(own, date_from, date_to)
    if row_limit is not None:
        rows = rows.orderBy(F.desc("trade_date")).limit(row_limit)
    named = rows.withColumn("company_name", F.lit(stock.company_name))
    return bar_view(named, ["ticker", "company_name"]).orderBy("trade_date")


def not_found(requests: DataFrame, stocks: DataFrame) -> DataFrame:
    """Requests that name a symbol the dimension does not hold."""
    asked = requests.withColumn("ticker", F.upper("ticker"))
    return asked.join(stocks.select("ticker"), "ticker", "left_anti").select(*requests.columns)


def universe_rows(
    bars: DataFrame,
    timeframe: str = DEFAULT_TIMEFRAME,
    date_from: dt.date | str | None = None,
    date_to: dt.date | str | None = None,
    row_limit: int | None = None,
    latest: DataFrame | None = None,
) -> DataFrame:
    """Bars of one common window for every symbol.

    Constant bounds stay plain filters and reach the scan. Only an open-ended
    timeframe needs each symbol's latest date, which may be given as `latest`.
    """
    check_request(timeframe, row_limit)
    days = TIMEFRAME_DAYS.get(timeframe)
    if date_from is None and date_to is not None and days is not None:
        date_from = F.date_sub(as_date(date_to), days)
    rows = in_range(bars, date_from, date_to)
    if date_from is None and days is not None:
        rows = _since_latest(rows, days, latest) if grain_of(rows) else window_of_result(rows, timeframe)
    return rows if row_limit is None else newest_rows(rows, row_limit)


def staged_latest(bars: DataFrame) -> DataFrame:
    """The newest date of each symbol, written once where stored bars would be scanned for every use of it."""
    latest = latest_dates(bars)
    if not grain_of(bars):
        return latest
    path = working_folder(bars.sparkSession, "latest")
    latest.write.parquet(path)
    return bars.sparkSession.read.schema(latest.schema).parquet(path)


def _since_latest(rows: DataFrame, days: int, latest: DataFrame | None = None) -> DataFrame:
    """Stored bars not older than ``days`` before their symbol's latest date.

    The latest dates are one row per symbol, from one scan of two columns. Each
    symbol needs the periods of its own window only: bars are joined to the
    (symbol, period) pairs, and partitions that no pair names are not read. A
    symbol that stopped long ago adds its own last periods, not all since then.
    Only the distinct periods reach the driver; the calendar bounds them.
    """
    grain = grain_of(rows)
    period = PERIOD_COLUMNS[grain]
    latest = staged_latest(rows) if latest is None else latest
    since = F.date_sub("latest_trade_date", days)
    pairs = latest.select(
        "ticker", "latest_trade_date", F.explode(periods_between(since, F.col("latest_trade_date"), grain)).alias(period)
    )
    needed = sorted(r[0] for r in pairs.select(period).distinct().collect())
    return (
        rows.where(F.col(period).isin(needed))
        .join(pairs, ["ticker", period])
        .where(F.col("trade_date") >= since)
        .select(*rows.columns)
    )


def universe_history(
    bars: DataFrame,
    stocks: DataFrame,
    *,
    as_of: dt.date | str,
    provider: str,
    timeframe: str = DEFAULT_TIMEFRAME,
    date_from: dt.date | str | None = None,
    date_to: dt.date | str | None = None,
    row_limit: int | None = None,
    is_mock: bool = False,
) -> History:
    """Answer the same request for every symbol of ``stocks``."""
    open_ended = date_to is None and date_from is None and timeframe != UNBOUNDED
    latest = staged_latest(bars) if open_ended else None
    rows = universe_rows(bars, timeframe, date_from, date_to, row_limit, latest)
    names = stocks.select("ticker", "company_name")
    start, end = F.lit(date_from).cast("date"), F.lit(date_to).cast("date")
    # A symbol without a bar in the table is anchored on as_of.
    anchor = end if date_to is not None else as_date(as_of)
    asked = names
    if latest is not None:
        asked = names.join(latest.withColumnRenamed("latest_trade_date", "last"), "ticker", "left")
        anchor = F.coalesce(F.col("last"), anchor)
    asked = asked.select(
        "ticker",
        "company_name",
        window_start(start, F.lit(timeframe), anchor).alias("start"),
        end.alias("date_to"),
    )
    header = _header(asked, rows, "ticker", as_date(as_of), provider, is_mock)
    return History(header, bar_view(rows.join(names, "ticker"), ["ticker", "company_name"]))


def window_of_result(rows: DataFrame, timeframe: str) -> DataFrame:
    """Narrow rows at hand to a timeframe that ends at each symbol's own last bar."""
    check_request(timeframe, None)
    if timeframe == UNBOUNDED:
        return rows
    last = F.max("trade_date").over(W.partitionBy("ticker"))
    return (
        rows.withColumn("_last", last)
        .where(F.col("trade_date") >= F.date_sub("_last", TIMEFRAME_DAYS[timeframe]))
        .drop("_last")
    )
