"""Market views over the test tables, which hold no price bars of their own."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from barloom.functions.calendar import TIMEFRAMES, as_date
from barloom.schema import BAR_COLUMNS, OPTIONAL_FACTS, PRICE, VALUE

SHARES_PER_UNIT = 100
SOURCE_NAME = "fixture"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _symbol(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and ship date, from the line items of that day.

    Open and close are the prices of the first and last line item in key order.
    A supplier has about one line item a day, so a partial step before the shuffle
    reduces nothing. The line items are shuffled and sorted once, by symbol: the
    days and the window over them find their rows in place.
    """
    # Two decimals and whole quantities: the product fits a compact decimal(18,2).
    price = F.col("l_extendedprice").cast("decimal(10,2)")
    shares = (F.col("l_quantity").cast("bigint") * SHARES_PER_UNIT).cast("decimal(7,0)")
    # A number of parts that the adaptive planner doesn't merge: the sort of a task holds several times what it reads.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trades = table(spark, sf_dir, "lineitem").repartition(parts, "l_suppkey").select(
        "l_suppkey",
        F.to_date("l_shipdate").alias("trade_date"),
        price.alias("price"),
        shares.alias("shares"),
        F.struct(
            "l_orderkey", "l_linenumber", "l_partkey", price.alias("price"), "l_quantity"
        ).alias("trade"),
    )
    daily = trades.groupBy("l_suppkey", "trade_date").agg(
        F.min("trade")["price"].cast(PRICE).alias("open"),
        F.max("price").cast(PRICE).alias("high"),
        F.min("price").cast(PRICE).alias("low"),
        F.max("trade")["price"].cast(PRICE).alias("close"),
        F.sum("shares").cast("bigint").alias("volume_shares"),
        F.sum(F.col("price") * F.col("shares")).cast(VALUE).alias("value_idr"),
        F.count("*").alias("frequency"),
    )
    per_symbol = W.partitionBy("l_suppkey").orderBy("trade_date")
    return (
        daily.withColumn(
            "previous", F.coalesce(F.lag("close").over(per_symbol), F.col("open")).cast(PRICE)
        )
        .withColumn("ticker", _symbol("S", "l_suppkey"))
        .withColumn("foreign_buy_shares", F.expr("volume_shares div 5"))
        .withColumn("foreign_sell_shares", F.expr("volume_shares div 6"))
        .withColumn("non_regular_volume_shares", F.lit(None).cast(T.LongType()))
        .withColumn("non_regular_value_idr", F.lit(None).cast(VALUE))
        .withColumn("non_regular_frequency", F.lit(None).cast(T.LongType()))
        .withColumn("source", F.lit(SOURCE_NAME))
        .select(*BAR_COLUMNS)
    )


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the stock dimension, nation and region as sector and subsector."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            _symbol("S", "s_suppkey").alias("ticker"),
            F.col("s_name").alias("company_name"),
            F.col("n_name").alias("sector"),
            F.col("r_name").alias("subsector"),
            (F.col("s_acctbal") >= 0).alias("is_active"),
        )
    )


def customer_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stocks. Symbols beyond the suppliers have no bars at all."""
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            _symbol("S", "c_custkey").alias("ticker"),
            F.col("c_name").alias("company_name"),
            F.col("n_name").alias("sector"),
            F.col("c_mktsegment").alias("subsector"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
        )
    )


def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per user and day of the event stream, weekends included."""
    value = (F.col("value") + 1).cast("decimal(10,2)")
    ticks = table(spark, sf_dir, "events").select(
        _symbol("U", "user_id").alias("ticker"),
        F.to_date("ts").alias("trade_date"),
        value.alias("price"),
        F.struct("ts", "event_id", value.alias("price")).alias("tick"),
    )
    daily = ticks.groupBy("ticker", "trade_date").agg(
        F.min("tick")["price"].cast(PRICE).alias("open"),
        F.max("price").cast(PRICE).alias("high"),
        F.min("price").cast(PRICE).alias("low"),
        F.max("tick")["price"].cast(PRICE).alias("close"),
        (F.count("*") * SHARES_PER_UNIT).alias("volume_shares"),
        (F.sum("price") * SHARES_PER_UNIT).cast(VALUE).alias("value_idr"),
        F.count("*").alias("frequency"),
    )
    per_symbol = W.partitionBy("ticker").orderBy("trade_date")
    previous = F.coalesce(F.lag("close").over(per_symbol), F.col("open")).cast(PRICE)
    frame = daily.withColumn("previous", previous).withColumn("source", F.lit("events"))
    for name, kind in OPTIONAL_FACTS.items():
        frame = frame.withColumn(name, F.lit(None).cast(kind))
    return frame.select(*BAR_COLUMNS)


def order_requests(spark: SparkSession, sf_dir: str, as_of: dt.date | str) -> DataFrame:
    """One history request per order; many orders name a symbol that is not listed.

    The five order priorities stand for the five timeframes. Closed orders end
    at the order date, pending ones ask for a range and a row limit.
    """
    day = F.to_date("o_orderdate")
    pending = F.col("o_orderstatus") == "P"
    timeframe = F.lit(TIMEFRAMES[-1])
    for position, name in enumerate(TIMEFRAMES[:-1], start=1):
        chosen = F.substring("o_orderpriority", 1, 1) == str(position)
        timeframe = F.when(chosen, F.lit(name)).otherwise(timeframe)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        _symbol("s", "o_custkey").alias("ticker"),
        F.when(pending, F.date_sub(day, 45)).alias("date_from"),
        F.when(pending | (F.col("o_orderstatus") == "F"), day).alias("date_to"),
        timeframe.alias("timeframe"),
        F.when(pending, (F.col("o_orderkey") % 9 + 1).cast("int")).alias("row_limit"),
        as_date(as_of).alias("as_of"),
    )


def dirty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars with faults planted by a rule on symbol and date, some repeated.

    Every row is kept; the rule only decides which values are spoilt. Each
    fault has its own prime, so a row may carry several.
    """
    k = F.datediff("trade_date", as_date("1992-01-01")) * 7 + F.substring("ticker", 2, 18).cast(
        "bigint"
    ) * 13

    def hit(prime: int) -> Column:
        return k % prime == 0

    clean = bars(spark, sf_dir)
    spoilt = clean.select(
        F.when(hit(107), F.lower("ticker")).otherwise(F.col("ticker")).alias("ticker"),
        "trade_date",
        "open",
        F.when(hit(101), (F.col("low") - 1).cast(PRICE)).otherwise(F.col("high")).alias("high"),
        "low",
        F.when(hit(109), F.lit(0).cast(PRICE)).otherwise(F.col("close")).alias("close"),
        F.when(~hit(131), F.col("previous")).alias("previous"),
        F.when(hit(97), F.lit(-1).cast("bigint"))
        .otherwise(F.col("volume_shares"))
        .alias("volume_shares"),
        "value_idr",
        F.when(hit(103), F.lit(0).cast("bigint")).otherwise(F.col("frequency")).alias("frequency"),
        F.when(hit(137), F.lit(-5).cast("bigint"))
        .otherwise(F.col("foreign_buy_shares"))
        .alias("foreign_buy_shares"),
        *[n for n in OPTIONAL_FACTS if n != "foreign_buy_shares"],
        F.when(hit(113), F.lit(" \t ")).otherwise(F.col("source")).alias("source"),
        F.when(hit(127), 2).otherwise(1).alias("copies"),
    )
    return spoilt.withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies")))
    ).drop("copies")
