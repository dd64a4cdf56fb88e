"""Joins of history requests with bars.

No side is broadcast by hint. Spark broadcasts a side only when its own size
estimate or the measured shuffle size is under the session's threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shares into which the requests of a symbol are dealt by their ids, if there are more than FEW.
SALTS, FEW = 16, 32


def salted(requests: DataFrame, salts: int = SALTS) -> DataFrame:
    """Requests with their ``slice``: (ticker, slice) spreads a symbol that most requests name."""
    return requests.withColumn("slice", F.pmod(F.xxhash64("request_id"), F.lit(salts)).cast("int"))


def bars_of_stocks(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Bars with the identity columns of their stock."""
    return bars.join(stocks, "ticker")


def bars_listed(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Bars of the given stocks, without their columns."""
    return bars.join(stocks.select("ticker"), "ticker", "left_semi")


def bars_for_requests(
    requests: DataFrame, bars: DataFrame, salts: int = SALTS, few: int = FEW, keep_slice: bool = False
) -> DataFrame:
    """All bars of each request: equal ticker, date inside ``[start, date_to]``.

    Bars per symbol are bounded by the calendar, but any share of the requests
    may name one symbol. Requests are dealt into ``salts`` slices by their ids, and
    a symbol's bars are copied to the slices that ask for it, so a hot symbol
    spreads over as many tasks. A symbol with ``few`` requests at most has one slice and one
    copy; symbols nobody asks for leave the plan early. Requests are never shuffled by ticker alone.

    All rows of a request are in one slice; with ``keep_slice``, they need no shuffle to be ranked.

    The join gives many times the rows it takes. The number of partitions is
    fixed, because the adaptive planner would merge them by their small input.
    """
    partitions = int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = salted(requests, salts).withColumnRenamed("slice", "salt")
    shares = dealt.groupBy("ticker", "salt").agg(F.count("*").alias("share"))
    totals = shares.groupBy("ticker").agg(F.sum("share").alias("total"))
    slice_ = F.when(F.col("total") > few, F.col("salt")).otherwise(0).alias("slice")
    placed = shares.join(totals, "ticker").select("ticker", "salt", slice_)
    asked = dealt.join(placed, ["ticker", "salt"]).repartition(partitions, "ticker", "slice").alias("request")
    offered = bars.join(placed.select("ticker", "slice").distinct(), "ticker").alias("bar")
    same = (F.col("request.ticker") == F.col("bar.ticker")) & (
        F.col("request.slice") == F.col("bar.slice")
    )
    start, end, day = F.col("request.start"), F.col("request.date_to"), F.col("bar.trade_date")
    inside = (start.isNull() | (day >= start)) & (end.isNull() | (day <= end))
    return asked.join(offered, same & inside).select(
        *[F.col(f"request.{name}") for name in [*requests.columns, *["slice"] * keep_slice]],
        *[F.col(f"bar.{name}") for name in bars.columns if name != "ticker"],
    )
