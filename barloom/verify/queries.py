"""The registered queries: each runs a plan of the package over the test tables.

Keys match those of :mod:`barloom.verify.oracle`. Prices leave as doubles and
counts as bigint, so two engines can be compared by value.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import parsing
from barloom.functions.arrays import last_of, spread_of, tail_of
from barloom.functions.calendar import as_date
from barloom.functions.frequency import frequency_log10, frequency_raw
from barloom.functions.prices import change, change_percent, direction
from barloom.functions.variants import computed_once
from barloom.operators import asof, joins, latest, quality, runlog, sessions, upsert
from barloom.plans import history as hist
from barloom.plans import indicators, ingest, maintain, rolling, status, watchlist
from barloom.schema import BAR_COLUMNS, BAR_KEY, FACTS, PRICE
from barloom.session import shuffles_dropped, working_folder
from barloom.sources import fixtures, payloads
from barloom.sources.providers import pull_window
from barloom.sources.snapshots import SnapshotTables
from barloom.sources.tables import MarketTables
from barloom.streaming.incremental import start_ingest

AS_OF = "2001-11-04"
SUMMARY_DAY = "1998-09-05"
RANGE = ("1998-03-01", "1998-06-30")
ANCHOR = "1999-12-31"
ROW_LIMIT = 5
PAYLOADS_A_FILE = 2000
CUT, OVERLAP = "1999-01-01", "1998-07-01"
PROVIDER = "landing"
T0 = dt.datetime(2024, 1, 1, 8, 0, tzinfo=dt.UTC)
T1 = dt.datetime(2024, 1, 2, 8, 0, tzinfo=dt.UTC)

PRICES = ["open", "high", "low", "close", "previous"]
MONEY = [*PRICES, "value_idr"]

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _double(name: str, digits: int | None = None) -> Column:
    value = F.col(name).cast("double")
    return (value if digits is None else F.round(value, digits)).alias(name)


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _instant(name: str) -> Column:
    """An instant as UTC text, whatever the time zone of the session."""
    # Counted from the epoch: the session's clock shows an hour twice a year, and conversions cost more than the text.
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return F.timestamp_add("SECOND", F.unix_seconds(F.col(name)), epoch).cast("string").alias(name)


def _bar_rows(rows: DataFrame, *keys: str) -> DataFrame:
    """History bars in comparable form."""
    return rows.select(
        *keys,
        "trade_date",
        *[_double(c) for c in MONEY],
        "volume_shares",
        _double("volume_lots"),
        "frequency",
        _double("raw_shares", 6),
        _double("raw_lots", 6),
    )


def _header_rows(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys, "date_from", "date_to", "latest_trade_date", "is_stale", "is_mock", "source",
        _long("n_bars"),
    )


# --- watchlist -----------------------------------------------------------------------


def _watchlist_rows(listed: DataFrame) -> DataFrame:
    return listed.select(
        "ticker", "company_name", "sector", _double("latest_close"), _double("change"),
        _double("change_percent", 6), "direction", "latest_trade_date",
        F.size("sparkline").cast("bigint").alias("n_points"),
    )


@query
def watchlist_snapshot(spark, sf):
    return _watchlist_rows(watchlist.watchlist(fixtures.bars(spark, sf), fixtures.stocks(spark, sf)))


@query
def watchlist_stocks_without_bars(spark, sf):
    stocks = fixtures.customer_stocks(spark, sf)
    return _watchlist_rows(watchlist.watchlist(fixtures.bars(spark, sf), stocks))


@query
def watchlist_search(spark, sf):
    listed = watchlist.watchlist(fixtures.bars(spark, sf), fixtures.stocks(spark, sf))
    found = watchlist.search(listed, "  R#00000000 ")
    return found.select("ticker", "company_name", _double("latest_close"))


@query
def watchlist_search_count(spark, sf):
    return watchlist.search(fixtures.stocks(spark, sf), "s1").agg(F.count("*").alias("n_symbols"))


@query
def sparkline_points(spark, sf):
    listed = watchlist.watchlist(fixtures.bars(spark, sf), fixtures.stocks(spark, sf))
    return watchlist.sparkline_points(listed).select("ticker", _long("position"), _double("close"))


@query
def sparkline_normalized(spark, sf):
    listed = watchlist.watchlist(fixtures.bars(spark, sf), fixtures.stocks(spark, sf))
    return watchlist.sparkline_scaled(listed).select(
        "ticker", _long("idx"), _double("position", 6), _double("level", 6)
    )


@query
def sparkline_range(spark, sf):
    listed = watchlist.watchlist(fixtures.bars(spark, sf), fixtures.stocks(spark, sf))
    line = F.col("sparkline").cast("array<double>")
    return listed.where(F.size("sparkline") > 0).select(
        "ticker",
        F.array_min(line).alias("low"),
        F.array_max(line).alias("high"),
        F.round(spread_of(line), 4).alias("spread"),
    )


@query
def sparkline_tail(spark, sf):
    listed = watchlist.watchlist(fixtures.bars(spark, sf), fixtures.customer_stocks(spark, sf))
    line = F.col("sparkline").cast("array<double>")
    return listed.select(
        "ticker",
        last_of(line).alias("last_close"),
        F.size(tail_of(line, 5)).cast("bigint").alias("n_tail"),
        F.round(F.array_max(tail_of(line, 5)), 4).alias("tail_high"),
    )


@query
def latest_quote(spark, sf):
    return watchlist.latest_quotes(fixtures.bars(spark, sf)).select(
        "ticker", "trade_date", *[_double(c) for c in ("close", "previous", "high", "low")],
        "volume_shares", "frequency", _double("change"), _double("change_percent", 6), "direction",
    )


@query
def daily_change(spark, sf):
    close, previous = F.col("close"), F.col("previous")
    return fixtures.bars(spark, sf).select(
        *BAR_KEY,
        change(close, previous).cast("double").alias("change"),
        F.round(change_percent(close, previous).cast("double"), 6).alias("change_percent"),
        direction(change(close, previous)).alias("direction"),
    )


# --- history -------------------------------------------------------------------------


def _universe(spark: SparkSession, sf: str, **request) -> hist.History:
    return hist.universe_history(
        fixtures.bars(spark, sf),
        fixtures.stocks(spark, sf),
        as_of=AS_OF,
        provider=PROVIDER,
        **request,
    )


@query
def history_1m(spark, sf):
    return _bar_rows(_universe(spark, sf, timeframe="1M").bars, "ticker", "company_name")


@query
def history_3m(spark, sf):
    return _bar_rows(_universe(spark, sf, timeframe="3M").bars, "ticker", "company_name")


@query
def history_6m_all(spark, sf):
    return _bar_rows(_universe(spark, sf, timeframe="6M").bars, "ticker", "company_name")


@query
def history_1y(spark, sf):
    return _bar_rows(_universe(spark, sf, timeframe="1Y").bars, "ticker", "company_name")


@query
def history_all(spark, sf):
    return _bar_rows(_universe(spark, sf, timeframe="ALL").bars, "ticker", "company_name")


@query
def history_limit_n(spark, sf):
    found = _universe(spark, sf, timeframe="1Y", row_limit=ROW_LIMIT)
    return _bar_rows(found.bars, "ticker", "company_name")


@query
def history_from_to(spark, sf):
    found = _universe(spark, sf, date_from=RANGE[0], date_to=RANGE[1])
    return _bar_rows(found.bars, "ticker", "company_name")


@query
def history_to_anchor(spark, sf):
    found = _universe(spark, sf, timeframe="3M", date_to=ANCHOR)
    return _bar_rows(found.bars, "ticker", "company_name")


@query
def history_header(spark, sf):
    return _header_rows(_universe(spark, sf, timeframe="1M").header, "ticker", "company_name")


@query
def history_header_without_bars(spark, sf):
    found = hist.universe_history(
        fixtures.bars(spark, sf),
        fixtures.customer_stocks(spark, sf),
        as_of=AS_OF,
        provider=PROVIDER,
        timeframe="3M",
    )
    return _header_rows(found.header, "ticker", "company_name")


def _requested(spark: SparkSession, sf: str) -> hist.History:
    return hist.history(
        fixtures.bars(spark, sf),
        fixtures.stocks(spark, sf),
        fixtures.order_requests(spark, sf, AS_OF),
        provider=PROVIDER,
        prune=True,
    )


@query
def history_requests(spark, sf):
    return _bar_rows(_requested(spark, sf).bars, "request_id", "ticker", "company_name")


@query
def history_requests_header(spark, sf):
    return _header_rows(_requested(spark, sf).header, "request_id", "ticker", "company_name")


@query
def history_not_found(spark, sf):
    requests = fixtures.order_requests(spark, sf, AS_OF)
    return hist.not_found(requests, fixtures.stocks(spark, sf)).select(
        "request_id", "ticker", "timeframe"
    )


@query
def result_window_3m(spark, sf):
    rows = hist.window_of_result(fixtures.bars(spark, sf), "3M")
    return rows.select(*BAR_KEY, _double("close"))


@query
def intraday_window_1m(spark, sf):
    rows = hist.universe_rows(fixtures.intraday_bars(spark, sf), timeframe="1M")
    return rows.select(
        *BAR_KEY, *[_double(c) for c in MONEY], "volume_shares", "frequency"
    )


# --- indicator -----------------------------------------------------------------------


def _indicator(spark: SparkSession, sf: str, unit: str) -> DataFrame:
    raw = frequency_raw(F.col("volume_shares"), F.col("frequency"), unit)
    return fixtures.bars(spark, sf).select(*BAR_KEY, F.round(raw, 6).alias("raw"))


@query
def frequency_indicator(spark, sf):
    return _indicator(spark, sf, "shares")


@query
def frequency_indicator_lots(spark, sf):
    return _indicator(spark, sf, "lots")


@query
def frequency_log10_scaled(spark, sf):
    raw = frequency_raw(F.col("volume_shares"), F.col("frequency"))
    shown = fixtures.bars(spark, sf).select(*BAR_KEY, frequency_log10(raw).alias("value"))
    return shown.where(F.col("value").isNotNull()).select(*BAR_KEY, _double("value", 6))


@query
def indicator_panel(spark, sf):
    every = [i.id for i in indicators.registered()]
    rows = indicators.panel(fixtures.bars(spark, sf), every)
    return rows.select(*BAR_KEY, "indicator", _double("value", 6), "direction")


@query
def indicator_panel_default(spark, sf):
    rows = indicators.panel(fixtures.bars(spark, sf))
    return rows.select(*BAR_KEY, "indicator", _double("value", 6), "direction")


@query
def volume_direction(spark, sf):
    return indicators.volume_bars(fixtures.bars(spark, sf))


@query
def candles(spark, sf):
    return indicators.candles(fixtures.bars(spark, sf))


@query
def close_line(spark, sf):
    return indicators.close_line(fixtures.bars(spark, sf))


# --- freshness, detail, as-of --------------------------------------------------------


@query
def latest_trade_date(spark, sf):
    return latest.latest_date(fixtures.bars(spark, sf))


@query
def latest_trade_date_by_ticker(spark, sf):
    return latest.latest_dates(fixtures.bars(spark, sf))


@query
def freshness_status(spark, sf):
    stocks, bars = fixtures.stocks(spark, sf), fixtures.bars(spark, sf)
    found = status.freshness(
        bars, _run_events(bars, stocks), as_of=AS_OF, provider=PROVIDER, repository="parquet"
    )
    return found.withColumn("ingestion_finished_at", _instant("ingestion_finished_at"))


@query
def freshness_by_ticker(spark, sf):
    stocks = fixtures.customer_stocks(spark, sf)
    return status.freshness_by_ticker(fixtures.bars(spark, sf), stocks, as_of=AS_OF)


@query
def freshness_intraday(spark, sf):
    bars = fixtures.intraday_bars(spark, sf)
    symbols = bars.select("ticker").distinct()
    return status.freshness_by_ticker(bars, symbols, as_of="2024-01-28", is_mock=True)


@query
def summary_as_of(spark, sf):
    rows = status.summary_as_of(fixtures.bars(spark, sf), fixtures.stocks(spark, sf), SUMMARY_DAY)
    return rows.select(
        "ticker", "company_name", "trade_date", *[_double(c) for c in MONEY],
        "volume_shares", "frequency", "foreign_buy_shares", "foreign_sell_shares",
    )


@query
def stock_detail(spark, sf):
    asked = fixtures.customer_stocks(spark, sf).select(F.lower("ticker").alias("ticker"))
    return status.stock_details(fixtures.stocks(spark, sf), asked)


# --- joins and scans -----------------------------------------------------------------


@query
def bars_with_stock(spark, sf):
    stocks = fixtures.stocks(spark, sf)
    rows = joins.bars_of_stocks(fixtures.bars(spark, sf), stocks)
    return rows.select(*BAR_KEY, "company_name", "sector", "subsector", _double("close"))


@query
def bars_of_active_stocks(spark, sf):
    active = fixtures.stocks(spark, sf).where("is_active")
    return joins.bars_listed(fixtures.bars(spark, sf), active).select(*BAR_KEY, _double("close"))


@query
def source_pull_window(spark, sf):
    rows = pull_window(fixtures.bars(spark, sf), RANGE[0], ANCHOR, limit=40)
    return rows.select(*BAR_KEY, _double("close"))


@query
def source_default_pull(spark, sf):
    return pull_window(fixtures.bars(spark, sf)).select(*BAR_KEY, _double("close"))


@query
def provider_conversions(spark, sf):
    """Order columns as provider text, and back."""
    total = F.col("o_totalprice").cast("string")
    return fixtures.table(spark, sf, "orders").select(
        "o_orderkey",
        parsing.parse_iso_date(F.col("o_orderdate").cast("string")).alias("iso_date"),
        parsing.parse_iso_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("basic_date"),
        parsing.parse_iso_date(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("other_date"),
        parsing.parse_number(F.col("o_custkey").cast("string"), T.LongType()).alias("whole"),
        parsing.parse_number(total, T.LongType()).alias("not_whole"),
        parsing.parse_number(total, PRICE).cast("double").alias("price"),
        parsing.finite(
            F.when(F.col("o_orderstatus") == "P", "NaN")
            .when(F.col("o_orderstatus") == "F", "-Infinity")
            .otherwise(F.col("o_custkey").cast("string"))
        ).alias("finite"),
        parsing.clipped(parsing.strip(F.concat(F.lit("\t "), "o_orderpriority", F.lit(" \n"))), 4)
        .alias("label"),
    )


# --- quality -------------------------------------------------------------------------


def _assessed(spark: SparkSession, sf: str) -> DataFrame:
    return quality.assess(fixtures.dirty_bars(spark, sf), quality.BAR_RULES)


@query
def quality_reasons(spark, sf):
    rows = quality.split(_assessed(spark, sf)).quarantine
    return rows.select(*BAR_KEY, _long("copy"), F.array_join("reasons", ",").alias("reasons"))


@query
def quality_valid(spark, sf):
    rows = quality.split(_assessed(spark, sf)).valid
    return rows.select(*BAR_KEY, _long("copy"), _double("close"), "volume_shares", "frequency")


@query
def quality_summary(spark, sf):
    return quality.reason_counts(_assessed(spark, sf))


@query
def duplicate_keys(spark, sf):
    return quality.duplicate_keys(fixtures.dirty_bars(spark, sf))


@query
def orphan_bars(spark, sf):
    rows = quality.orphans(fixtures.dirty_bars(spark, sf), fixtures.stocks(spark, sf))
    return rows.select(*BAR_KEY, _long("copy"))


def _faulty_requests(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.order_requests(spark, sf, AS_OF).select(
        "request_id",
        "date_from",
        "date_to",
        "as_of",
        F.when(F.col("request_id") % 17 == 0, F.concat("ticker", F.lit("-X")))
        .otherwise(F.col("ticker"))
        .alias("ticker"),
        F.when(F.col("request_id") % 19 == 0, "5Y").otherwise(F.col("timeframe")).alias("timeframe"),
        ((F.col("row_limit") - 3) * 400).alias("row_limit"),
    )


@query
def history_rejected_requests(spark, sf):
    requests = _faulty_requests(spark, sf)
    found = hist.history(fixtures.bars(spark, sf), fixtures.stocks(spark, sf), requests, provider=PROVIDER)
    return found.rejected.select("request_id", F.array_join("reasons", ",").alias("reasons"))


@query
def stock_violations(spark, sf):
    """Customers as stocks, some with a name of white space or none."""
    number = F.substring("ticker", 2, 18).cast("bigint")
    name = F.when(number % 5 == 0, " \t ").when(number % 7 != 0, F.col("company_name"))
    stocks = fixtures.customer_stocks(spark, sf).withColumn("company_name", name)
    found = quality.split(quality.assess(stocks, quality.STOCK_RULES)).quarantine
    return found.select("ticker", F.array_join("reasons", ",").alias("reasons"))


@query
def request_violations(spark, sf):
    requests = _faulty_requests(spark, sf)
    rows = quality.split(quality.assess(requests, quality.REQUEST_RULES)).quarantine
    return rows.select("request_id", F.array_join("reasons", ",").alias("reasons"))


@query
def run_log_violations(spark, sf):
    urgent = F.substring("o_orderpriority", 1, 1)
    day = F.to_timestamp("o_orderdate")
    runs = fixtures.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.when(urgent == "5", "  ").otherwise(F.col("o_orderpriority")).alias("provider"),
        F.when(F.col("o_orderstatus") == "O", "running")
        .when(F.col("o_orderstatus") == "F", "succeeded")
        .otherwise("pending")
        .alias("status"),
        (F.col("o_custkey") - 5).alias("rows_received"),
        (F.col("o_custkey") - 7).alias("rows_inserted"),
        F.lit(2).alias("rows_updated"),
        day.alias("started_at"),
        F.when(urgent == "1", day - F.expr("interval 1 day"))
        .when(urgent == "2", day)
        .alias("finished_at"),
    )
    rows = quality.split(quality.assess(runs, quality.RUN_RULES)).quarantine
    return rows.select("run_id", F.array_join("reasons", ",").alias("reasons"))


# --- upsert --------------------------------------------------------------------------


def _stored(bars: DataFrame, day: str = "trade_date") -> DataFrame:
    at = upsert.as_instant(T0)
    return bars.where(F.col(day) < as_date(CUT)).select(
        *BAR_COLUMNS,
        at.alias("ingested_at"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def _restated(bars: DataFrame, day: str = "trade_date") -> DataFrame:
    """A later slice with new volumes; busy sessions arrive twice, foreign sells not at all."""
    return (
        bars.where(F.col(day) >= as_date(OVERLAP))
        .withColumn("copies", F.when(F.col("frequency") >= 2, 2).otherwise(1))
        .withColumn("arrival", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .withColumn("volume_shares", F.col("volume_shares") + F.col("arrival") * 100)
        .withColumn("foreign_sell_shares", F.lit(None).cast("bigint"))
        .select(*BAR_COLUMNS, "arrival")
    )


def _batch(bars: DataFrame, day: str = "trade_date") -> DataFrame:
    return upsert.last_wins(_restated(bars, day), BAR_KEY, ["arrival"])


def _merged_rows(rows: DataFrame) -> DataFrame:
    # Most rows have the same instant three times: its text is worked out once.
    rows = rows.withColumn("created", _instant("created_at"))

    def text(name: str) -> Column:
        as_created = F.col(name) == F.col("created_at")
        return F.when(as_created, F.col("created")).otherwise(_instant(name)).alias(name)

    return rows.select(
        *BAR_KEY, *[_double(c) for c in PRICES], "volume_shares", "frequency",
        "foreign_buy_shares", "foreign_sell_shares", "source", text("ingested_at"),
        F.col("created").alias("created_at"), text("updated_at"),
    )


def _bars_once(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    """The bars, worked out once for a query that uses them several times."""
    bars, path = fixtures.bars(spark, sf), path or working_folder(spark, "bars")
    with shuffles_dropped(spark):
        bars.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(bars.schema).parquet(path)


def _bars_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """The bars, shuffled by key where a merge needs them, for a query that uses them several times.

    Neither filters on ``day``, the date once more, nor unused columns cross the generator: below it every use
    has the same plan, and Spark works it out once. Reduction and join by key find their rows in place.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bars = fixtures.bars(spark, sf).repartition(parts, *BAR_KEY)
    facts = {name: F.col(name) for name in BAR_COLUMNS if name not in BAR_KEY}
    return computed_once(bars, BAR_KEY, day=F.col("trade_date"), **facts)


@query
def upsert_merge(spark, sf):
    bars = _bars_by_key(spark, sf)
    return _merged_rows(upsert.merge_bars(_stored(bars, "day"), _batch(bars, "day"), T1))


@query
def upsert_coalesce_nulls(spark, sf):
    bars = _bars_by_key(spark, sf)
    merged = upsert.merge_bars(_stored(bars, "day"), _batch(bars, "day"), T1, coalesce_nulls=True)
    return _merged_rows(merged)


@query
def upsert_idempotent(spark, sf):
    bars = _bars_once(spark, sf)
    once = upsert.merge_bars(_stored(bars), _batch(bars), T1)
    return _merged_rows(upsert.merge_bars(once, _batch(bars), T1))


@query
def upsert_stats(spark, sf):
    bars = fixtures.bars(spark, sf)
    counts = upsert.merge_counts(_batch(bars), _stored(bars))
    return counts.select(
        "ticker", _long("rows_received"), _long("rows_inserted"), _long("rows_updated")
    )


@query
def upsert_new_keys(spark, sf):
    bars = fixtures.bars(spark, sf)
    return upsert.new_keys(_restated(bars), _stored(bars))


@query
def upsert_existing_keys(spark, sf):
    bars = fixtures.bars(spark, sf)
    return upsert.existing_keys(_restated(bars), _stored(bars))


@query
def union_last_wins(spark, sf):
    bars = fixtures.bars(spark, sf)
    patch = _batch(bars).select(*BAR_COLUMNS)
    base = bars.where(F.col("trade_date") < as_date(CUT))
    return upsert.overlay(base, patch, BAR_KEY).select(*BAR_KEY, "volume_shares")


@query
def stock_upsert(spark, sf):
    at = upsert.as_instant(T0)
    stored = fixtures.stocks(spark, sf).select(
        "*", at.alias("created_at"), at.alias("updated_at")
    )
    renamed = fixtures.customer_stocks(spark, sf).withColumn("subsector", F.lit(None).cast("string"))
    merged = upsert.merge_stocks(stored, renamed, T1)
    return merged.select(
        "ticker", "company_name", "sector", "subsector", "is_active",
        _instant("created_at"), _instant("updated_at"),
    )


@query
def cascade_delete(spark, sf):
    closed = fixtures.stocks(spark, sf).where(~F.col("is_active"))
    return upsert.without_stocks(fixtures.bars(spark, sf), closed).select(*BAR_KEY, _double("close"))


# --- payloads ------------------------------------------------------------------------


def _by_year(spark: SparkSession, sf: str) -> DataFrame:
    return payloads.history_payloads(
        fixtures.bars(spark, sf), fixtures.stocks(spark, sf), F.year("trade_date")
    )


def _by_hundred(spark: SparkSession, sf: str) -> DataFrame:
    hundred = F.floor(F.substring("ticker", 2, 18).cast("bigint") / 100)
    bars = (
        fixtures.bars(spark, sf)
        .withColumn("non_regular_volume_shares", F.expr("volume_shares div 7"))
        .withColumn("non_regular_value_idr", F.col("value_idr"))
    )
    return payloads.summary_payloads(bars, fixtures.stocks(spark, sf), hundred)


def _parsed_rows(rows: DataFrame) -> DataFrame:
    return rows.select(
        "ticker", "company_name", "trade_date", *[_double(c) for c in MONEY],
        *[c for c in FACTS if c not in (*MONEY, "non_regular_value_idr")],
        _double("non_regular_value_idr"), "source",
        F.size("parse_errors").cast("bigint").alias("n_errors"),
    )


@query
def payload_history_parse(spark, sf):
    return _parsed_rows(payloads.read_history(_by_year(spark, sf), PROVIDER).rows)


@query
def payload_summary_parse(spark, sf):
    return _parsed_rows(payloads.read_summary(_by_hundred(spark, sf), PROVIDER).rows)


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Every payload with one kind of damage, chosen by symbol and year; some stay whole."""
    parts = F.split("payload_id", "/")
    number = F.substring(parts[0], 2, 18).cast("bigint")
    whole, kind = F.col("payload"), F.col("kind")
    damage = {
        0: F.expr("left(payload, length(payload) - 1)"),
        1: F.concat(F.lit("["), whole, F.lit("]")),
        2: F.concat(F.lit('{"data":['), whole, F.lit("]}")),
        3: F.concat(
            F.lit('{"data":'),
            F.replace(whole, F.lit('"unit":"shares"'), F.lit('"unit":"lots"')),
            F.lit("}"),
        ),
        4: F.replace(whole, F.lit('"items":['), F.lit('"items":null,"was":[')),
        5: F.replace(whole, F.lit('"code":"S'), F.lit('"code":"S-')),
        6: F.concat(F.lit('{"data":'), whole, F.lit("}")),
        7: F.replace(whole, F.lit('"items":['), F.lit('"items":[7,null,"x",[],')),
    }
    damaged = whole
    for number_, text in damage.items():
        damaged = F.when(kind == number_, text).otherwise(damaged)
    chosen = (number + parts[1].cast("bigint")) % 9
    made = computed_once(_by_year(spark, sf), ["payload_id", "arrived_at"], payload=whole, kind=chosen)
    return made.withColumn("payload", damaged)


@query
def payload_rejects(spark, sf):
    rejects = payloads.read_history(_damaged(spark, sf), PROVIDER).rejects
    return rejects.select("payload_id", "reason")


@query
def payload_survivors(spark, sf):
    rows = payloads.read_history(_damaged(spark, sf), PROVIDER).rows
    return rows.select("payload_id", "trade_date", _double("close"))


# --- run log, ingest, stream ---------------------------------------------------------


def _run_events(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """One run per stock: inactive stocks fail, the others report their bars."""
    later = F.expr("interval 1 second") * F.length("company_name")
    opened = runlog.open_runs(stocks, "nightly", PROVIDER, T0, dt.date(2001, 11, 4))
    counts = bars.groupBy("ticker").agg(F.count("*").alias("rows_received"))
    outcome = (
        stocks.join(counts, "ticker", "left")
        .withColumn("rows_inserted", F.col("rows_received"))
        .withColumn("rows_updated", F.lit(0))
        .withColumn("error", F.when(~F.col("is_active"), F.repeat("company_name", 80)))
        .withColumn("failed", ~F.col("is_active"))
        .withColumn("finished", upsert.as_instant(T0) + later)
        .drop(*[c for c in stocks.columns if c != "ticker"])
    )
    closed = runlog.close_runs(opened, outcome, F.col("finished"))
    return opened.unionByName(closed)


@query
def ingest_run_log(spark, sf):
    events = _run_events(fixtures.bars(spark, sf), fixtures.stocks(spark, sf))
    return runlog.current_state(events).select(
        "run_id", "provider", "ticker", "status", "requested_date", "rows_received",
        "rows_inserted", "rows_updated", "error_message", _instant("started_at"),
        _instant("finished_at"),
    )


@query
def latest_ingestion(spark, sf):
    events = _run_events(fixtures.bars(spark, sf), fixtures.stocks(spark, sf))
    return runlog.latest_run(events).select(
        "provider", "status", "rows_received", _instant("finished_at")
    )


def _seeded(
    spark: SparkSession, sf: str, before: str | None = None
) -> tuple[MarketTables, DataFrame, DataFrame]:
    """Tables in the working folder that hold all bars, or those before a date."""
    tables = MarketTables(spark, working_folder(spark, "market"), grain="year").create()
    # What follows a seed of early bars uses all of them again.
    bars = fixtures.bars(spark, sf) if before is None else _bars_once(spark, sf)
    stocks = fixtures.stocks(spark, sf)
    held = bars if before is None else bars.where(F.col("trade_date") < as_date(before))
    ingest.seed(tables, held, stocks, provider=PROVIDER, job_id="seed", at=T0)
    return tables, bars, stocks


def _late_payloads(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    late = bars.where(F.col("trade_date") >= as_date(OVERLAP)).withColumn(
        "volume_shares", F.col("volume_shares") + 100
    )
    return payloads.history_payloads(late, stocks, F.year("trade_date"))


@query
def batch_ingest(spark, sf):
    tables, bars, stocks = _seeded(spark, sf, CUT)
    feed = payloads.read_history(_late_payloads(bars, stocks), PROVIDER)
    runs = ingest.ingest(tables, feed, provider=PROVIDER, job_id="late", at=T1)
    return runs.select(
        "ticker", "status", "rows_received", "rows_inserted", "rows_updated", "error_message"
    )


@query
def batch_ingest_whole_payloads(spark, sf):
    tables, bars, stocks = _seeded(spark, sf, CUT)
    spoilt = _late_payloads(bars, stocks).withColumn(
        "payload",
        F.when(
            F.col("payload_id").endswith("0/2000"),
            F.replace("payload", F.lit('"volume":'), F.lit('"volume":-')),
        ).otherwise(F.col("payload")),
    )
    runs = ingest.ingest(
        tables,
        payloads.read_history(spoilt, PROVIDER),
        provider=PROVIDER,
        job_id="late",
        at=T1,
        whole_payloads=True,
    )
    return runs.select(
        "ticker", "status", "rows_received", "rows_inserted", "rows_updated", "error_message"
    )


@query
def seed_load(spark, sf):
    tables, _, _ = _seeded(spark, sf)
    return runlog.current_state(tables.runs()).select(
        "job_id", "status", "rows_received", "rows_inserted", "rows_updated"
    )


@query
def ingest_asked_for(spark, sf):
    """Damaged payloads are reported whatever tickers were asked for, also if theirs can't be read."""
    tables = MarketTables(spark, working_folder(spark, "market"), grain="year").create()
    stocks = fixtures.stocks(spark, sf)
    feed = payloads.read_history(_damaged(spark, sf), PROVIDER)
    ingest.ingest(
        tables, feed, provider=PROVIDER, job_id="asked", at=T0, tickers=stocks.select(F.lower("ticker").alias("ticker"))
    )
    found = ingest.quarantine(tables, "asked")
    return found.select("payload_id", F.element_at("reasons", 1).alias("reason")).distinct()


@query
def stored_scan(spark, sf):
    tables, _, _ = _seeded(spark, sf)
    return tables.bars(*RANGE).select(*BAR_KEY, _double("close"), _long("trade_year"))


@query
def stored_watchlist(spark, sf):
    tables, _, _ = _seeded(spark, sf)
    return _watchlist_rows(watchlist.watchlist(tables.bars(), tables.stocks()))


@query
def stored_history_3m(spark, sf):
    tables, _, _ = _seeded(spark, sf)
    found = hist.universe_history(
        tables.bars(), tables.stocks(), as_of=AS_OF, provider=PROVIDER, timeframe="3M"
    )
    return _bar_rows(found.bars, "ticker", "company_name")


@query
def stored_history_requests(spark, sf):
    tables, _, _ = _seeded(spark, sf)
    requests = fixtures.order_requests(spark, sf, AS_OF)
    found = hist.history(
        tables.bars(), tables.stocks(), requests, provider=PROVIDER, prune=True
    )
    return _header_rows(found.header, "request_id", "ticker", "company_name")


@query
def symbol_history(spark, sf):
    """The whole history of the symbol that comes first, from stored bars."""
    tables, _, stocks = _seeded(spark, sf)
    name = stocks.agg(F.min("ticker")).first()[0]
    found = hist.symbol_history(tables.bars(), tables.stocks(), name.lower(), timeframe="ALL")
    return _bar_rows(found, "ticker", "company_name")


@query
def stored_freshness(spark, sf):
    tables, _, _ = _seeded(spark, sf)
    found = status.freshness(
        tables.bars(), tables.runs(), as_of=AS_OF, provider=PROVIDER, repository="parquet"
    )
    return found.withColumn("ingestion_finished_at", _instant("ingestion_finished_at"))


@query
def stream_ingest(spark, sf):
    """Two landings, the second restating part of the first, through the same stream."""
    folder = working_folder(spark, "stream")
    tables = MarketTables(spark, f"{folder}/tables", grain="year").create()
    bars, stocks = _bars_once(spark, sf, f"{folder}/bars"), fixtures.stocks(spark, sf)
    early = bars.where(F.col("trade_date") < as_date(CUT))
    landings = {
        "early": payloads.history_payloads(early, stocks, F.year("trade_date")),
        "late": _late_payloads(bars, stocks),
    }
    fs, path = tables._fs(), lambda name: tables._path(f"{folder}/{name}")
    for name, feed in landings.items():
        # Compressed files can't be split between tasks: many small ones.
        lines = feed.select("payload").write.option("compression", "gzip").option("maxRecordsPerFile", PAYLOADS_A_FILE)
        with shuffles_dropped(spark):
            lines.text(f"{folder}/{name}")
    fs.delete(path("bars"), True)
    fs.mkdirs(path("landing"))
    for name in landings:
        fs.rename(path(name), path(f"landing/{name}"))
        start_ingest(
            tables,
            f"{folder}/landing/*",
            f"{folder}/checkpoint",
            provider=PROVIDER,
            stream="eod",
            one_per_line=True,
        ).awaitTermination()
    return tables.bars().select(
        *BAR_KEY, *[_double(c) for c in PRICES], "volume_shares", "frequency", "source"
    )




# --- tables with versions ------------------------------------------------------------


def _versioned(spark: SparkSession, sf: str, before: str | None = None) -> tuple[SnapshotTables, DataFrame, DataFrame]:
    """Tables with versions that hold all bars, or those before a date."""
    tables = SnapshotTables(spark, working_folder(spark, "versions"), grain="year").create()
    # What follows a seed of early bars uses all of them again.
    bars = fixtures.bars(spark, sf) if before is None else _bars_once(spark, sf)
    stocks = fixtures.stocks(spark, sf)
    held = bars if before is None else bars.where(F.col("trade_date") < as_date(before))
    ingest.seed(tables, held, stocks, provider=PROVIDER, job_id="seed", at=T0)
    return tables, bars, stocks


class _StopsBeforeCommit(SnapshotTables):
    """Tables whose jobs are stopped when all their files are written and none is live."""

    def commit(self, base, changes, job_id=None):
        if job_id is not None:
            raise InterruptedError(f"{job_id} stopped")
        return super().commit(base, changes, job_id)


@query
def ingest_snapshot_read(spark, sf):
    """What a reader sees before a job, after it was stopped between its tables, and when it was run again."""
    tables, bars, stocks = _versioned(spark, sf, CUT)
    feed = payloads.read_history(_late_payloads(bars, stocks), PROVIDER)
    late = {"provider": PROVIDER, "job_id": "late", "at": T1}
    moments = {"before": tables.pinned()}
    try:
        ingest.ingest(_StopsBeforeCommit(spark, tables.root, tables.grain), feed, **late)
    except InterruptedError:
        moments["stopped"] = tables.pinned()
    ingest.ingest(tables, feed, **late)
    moments["after"] = tables.pinned()
    seen = None
    for moment, at in moments.items():
        held = at.bars().groupBy("ticker").agg(F.count("*").alias("n_bars"), F.sum("volume_shares").alias("volume_shares"))
        states = runlog.current_state(at.runs()).where("ticker is not null").select("ticker", "status")
        rows = held.join(states, "ticker", "left").select(F.lit(moment).alias("moment"), "ticker", "n_bars", "volume_shares", "status")
        seen = rows if seen is None else seen.unionByName(rows)
    return seen


@query
def stored_cascade_delete(spark, sf):
    """Inactive stocks and their bars leave the stored tables; the stocks that stay are listed beside their bars."""
    tables, _, stocks = _versioned(spark, sf)
    maintain.delete_stocks(tables, stocks.where(~F.col("is_active")), job_id="delisted")
    held = tables.bars().groupBy("ticker").agg(F.count("*").alias("n_bars"), F.max("trade_date").alias("latest_trade_date"))
    kept = tables.stocks().select("ticker", "company_name")
    recent = tables.recent().groupBy("ticker").agg(F.count("*").alias("n_recent"))
    return kept.join(held, "ticker", "full_outer").join(recent, "ticker", "full_outer")


def _restated_tables(spark: SparkSession, sf: str) -> SnapshotTables:
    """Tables after a job that restates previous closes, and the deletion of every seventh symbol's last bar."""
    tables, bars, stocks = _versioned(spark, sf, CUT)
    late = bars.where(F.col("trade_date") >= as_date(OVERLAP)).withColumn("previous", (F.col("previous") + 1).cast(PRICE))
    feed = payloads.read_history(payloads.history_payloads(late, stocks, F.year("trade_date")), PROVIDER)
    ingest.ingest(tables, feed, provider=PROVIDER, job_id="late", at=T1, coalesce_nulls=True)
    seventh = F.substring("ticker", 2, 18).cast("bigint") % 7 == 0
    maintain.delete_bars(tables, latest.latest_dates(bars.where(seventh)).withColumnRenamed("latest_trade_date", "trade_date"), job_id="wrong")
    return tables


@query
def maintained_watchlist(spark, sf):
    return _watchlist_rows(maintain.maintained_watchlist(_restated_tables(spark, sf)))


@query
def maintained_latest_dates(spark, sf):
    return maintain.maintained_latest_dates(_restated_tables(spark, sf))


@query
def run_log_compacted(spark, sf):
    """The runs of all stocks, logged by many jobs of a few stocks each."""
    tables = SnapshotTables(spark, working_folder(spark, "versions")).create()
    events = _run_events(fixtures.bars(spark, sf), fixtures.stocks(spark, sf))
    path = working_folder(spark, "events")
    events.withColumn("job", F.pmod(F.xxhash64("ticker"), F.lit(10))).write.parquet(path)
    staged = spark.read.parquet(path)
    for job in range(10):
        for seq in (runlog.OPENED, runlog.CLOSED):
            tables.append_runs(staged.where((F.col("job") == job) & (F.col("event_seq") == seq)))
    return runlog.current_state(tables.runs()).select(
        "run_id", "provider", "ticker", "status", "requested_date", "rows_received",
        "rows_inserted", "rows_updated", "error_message", _instant("started_at"),
        _instant("finished_at"),
    )


@query
def stored_symbol_lookup(spark, sf):
    """The bars of the symbol that comes last, from the files that can hold it."""
    tables, _, stocks = _versioned(spark, sf)
    name = stocks.agg(F.max("ticker")).first()[0]
    return tables.bars_of(name, RANGE[0]).select(*BAR_KEY, _double("close"), "volume_shares")


# --- rolling forms, as-of join, missing sessions -------------------------------------


def _raw_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The raw indicator; some sessions have none, and every fifth symbol the same value on all days."""
    same = F.substring("ticker", 2, 18).cast("bigint") % 5 == 0
    bars = fixtures.bars(spark, sf)
    return rolling.raw_series(
        bars.withColumns(
            {
                "volume_shares": F.when(same, F.lit(700).cast("bigint")).otherwise(F.col("volume_shares")),
                "frequency": F.when(F.col("volume_shares") % 700 == 0, 0).when(same, 3).otherwise(F.col("frequency")).cast("bigint"),
            }
        )
    )


@query
def indicator_rolling_zscore(spark, sf):
    rows = rolling.rolling_zscore(_raw_with_gaps(spark, sf))
    return rows.select(*BAR_KEY, *[_double(c, 6) for c in ("raw", "mean", "deviation", "zscore")])


@query
def indicator_rolling_percentile(spark, sf):
    rows = rolling.rolling_percentile(_raw_with_gaps(spark, sf))
    return rows.select(*BAR_KEY, _double("raw", 6), _double("percentile", 6))


@query
def asof_requests(spark, sf):
    """The newest bar on or before the day of every order."""
    asked = fixtures.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.to_date("o_orderdate").alias("day"),
    )
    found = asof.asof_join(asked, fixtures.bars(spark, sf), ["trade_date", "close", "volume_shares"])
    return found.select("request_id", "ticker", "day", "trade_date", _double("close"), "volume_shares")


@query
def missing_sessions(spark, sf):
    return sessions.missing_sessions(fixtures.bars(spark, sf))
