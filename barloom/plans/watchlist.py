"""Watchlist: every active stock with its last session and a 30-session trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.arrays import scaled_points
from barloom.functions.prices import change, change_percent, direction
from barloom.operators.latest import latest_date, latest_row, newest_rows
from barloom.operators.ranges import grain_of, in_range

# Fixed value: sessions shown in a sparkline.
SPARKLINE_DEPTH = 30
# Calendar days in which a symbol that trades every week day has one session.
DAYS_PER_SESSION = 2


def newest_of_stored(bars: DataFrame, stocks: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest stored bars of each of the given stocks, newest partitions first.

    Most symbols have their ``n`` sessions in the newest partitions, and only
    those are read for them. The others, such as new, halted or thinly traded
    symbols, are then looked up in all partitions.
    """
    since = latest_date(bars).select(
        F.date_sub("latest_trade_date", n * DAYS_PER_SESSION)
    ).scalar()
    found = F.count("*").over(W.partitionBy("ticker"))
    complete = (
        newest_rows(in_range(bars, since), n)
        .withColumn("_found", found)
        .where(F.col("_found") == n)
        .drop("_found")
    )
    rest = stocks.select("ticker").join(
        complete.select("ticker").distinct(), "ticker", "left_anti"
    )
    looked_up = newest_rows(bars.join(rest, "ticker", "left_semi"), n)
    return complete.unionByName(looked_up)


def recent_closes(
    bars: DataFrame, stocks: DataFrame, depth: int = SPARKLINE_DEPTH
) -> DataFrame:
    """Per stock: the last session and the closes of the last ``depth`` sessions in order.

    At most ``depth`` rows are collected per ticker.
    """
    newest = newest_of_stored(bars, stocks, depth) if grain_of(bars) else newest_rows(bars, depth)
    recent = newest.select("ticker", "trade_date", "close", "previous")
    sessions = F.sort_array(F.collect_list(F.struct("trade_date", "close", "previous")))
    last = F.try_element_at("sessions", F.lit(-1))
    return (
        recent.groupBy("ticker")
        .agg(sessions.alias("sessions"))
        .select(
            "ticker",
            last["close"].alias("latest_close"),
            last["previous"].alias("previous"),
            last["trade_date"].alias("latest_trade_date"),
            F.col("sessions.close").alias("sparkline"),
        )
    )


def watchlist(bars: DataFrame, stocks: DataFrame, depth: int = SPARKLINE_DEPTH) -> DataFrame:
    """One row per active stock; a stock without bars has NULLs and an empty sparkline."""
    close, previous = F.col("latest_close"), F.col("previous")
    moved = change(close, previous)
    listed = stocks.where("is_active")
    return (
        listed.join(recent_closes(bars, listed, depth), "ticker", "left")
        .select(
            "ticker",
            "company_name",
            "sector",
            "latest_close",
            moved.alias("change"),
            change_percent(close, previous).alias("change_percent"),
            direction(moved).alias("direction"),
            "latest_trade_date",
            F.coalesce("sparkline", F.array().cast("array<decimal(18,4)>")).alias("sparkline"),
        )
    )


def search(listed: DataFrame, text: str) -> DataFrame:
    """Rows whose ticker or company name contains the text, in any case."""
    wanted = text.strip().lower()
    if not wanted:
        return listed
    return listed.where(
        F.contains(F.lower("ticker"), F.lit(wanted))
        | F.contains(F.lower("company_name"), F.lit(wanted))
    )


def sparkline_points(listed: DataFrame) -> DataFrame:
    """Sparklines in long form, one row per session."""
    return listed.select("ticker", F.posexplode("sparkline").alias("position", "close"))


def sparkline_scaled(listed: DataFrame) -> DataFrame:
    """Sparklines scaled to the unit square; series of one point have no line."""
    points = scaled_points(F.col("sparkline").cast("array<double>"))
    return listed.select("ticker", F.posexplode(points).alias("idx", "point")).select(
        "ticker", "idx", "point.position", "point.level"
    )


def latest_quotes(bars: DataFrame, stocks: DataFrame | None = None) -> DataFrame:
    """The quote header of each symbol, from its last bar. With ``stocks``, stored bars are read newest first."""
    quote = ["trade_date", "close", "previous", "high", "low", "volume_shares", "frequency"]
    close, previous = F.col("close"), F.col("previous")
    moved = change(close, previous)
    if stocks is not None and grain_of(bars):
        last = newest_of_stored(bars, stocks, 1)
    else:
        last = latest_row(bars, quote)
    return last.select(
        "ticker",
        *quote,
        moved.alias("change"),
        change_percent(close, previous).alias("change_percent"),
        direction(moved).alias("direction"),
    )


def by_ticker(listed: DataFrame) -> DataFrame:
    """A watchlist or stocks in the order a reader sees them: for the last step before display only."""
    return listed.orderBy("ticker")
