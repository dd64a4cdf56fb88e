"""Sessions that a symbol missed while the market traded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def session_calendar(bars: DataFrame) -> DataFrame:
    """The dates on which anything traded, numbered, with the sessions before and after each.

    One row per date after an aggregate with a partial step; only these rows, which the calendar
    bounds, are ordered in one task.
    """
    in_order = W.orderBy("trade_date")
    return bars.groupBy("trade_date").agg(F.count("*").alias("n_symbols")).select(
        "trade_date",
        F.row_number().over(in_order).alias("session"),
        F.lag("trade_date").over(in_order).alias("session_before"),
        F.lead("trade_date").over(in_order).alias("session_after"),
    )


def missing_sessions(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """One row per gap: the symbol's sessions around it, the first and last session missed, and how many.

    Gaps lie between two bars of a symbol, or after its last one, up to the last session of the
    calendar (`next_traded` is NULL then). Days before a symbol's first bar are no gap. No
    row is made for a missed day. A calendar of one's own has the columns of :func:`session_calendar`; bars
    on days that it doesn't have are left out.
    """
    calendar = session_calendar(bars) if calendar is None else calendar
    last = calendar.agg(F.max("session").alias("n"), F.max("trade_date").alias("day")).select(F.struct("n", "day")).scalar()
    in_order = W.partitionBy("ticker").orderBy("trade_date")
    # What follows a bar: the next bar of the symbol, or the end of the calendar.
    placed = (
        bars.select("ticker", "trade_date")
        .join(calendar, "trade_date")
        .withColumns(
            {
                "next_traded": F.lead("trade_date").over(in_order),
                "next_session": F.lead("session").over(in_order),
                "before_next": F.lead("session_before").over(in_order),
                "end": last,
            }
        )
    )
    missed = F.coalesce(F.col("next_session"), F.col("end.n") + 1) - F.col("session") - 1
    return placed.where(missed > 0).select(
        "ticker",
        F.col("trade_date").alias("last_traded"),
        "next_traded",
        F.col("session_after").alias("first_missed"),
        F.coalesce("before_next", "end.day").alias("last_missed"),
        missed.cast("bigint").alias("n_missed"),
    )
