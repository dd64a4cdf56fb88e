from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import SMALL, bar_row
from pyspark.sql import functions as F

from barloom.operators.joins import bars_for_requests
from barloom.operators.runlog import open_runs
from barloom.plans import history as hist
from barloom.plans import indicators, status, watchlist
from barloom.schema import HISTORY_REQUEST
from barloom.verify.queries import REGISTRY

DAY = dt.timedelta(days=1)
LAST = dt.date(2026, 8, 21)


def days_of(rows):
    return sorted(str(r.trade_date) for r in rows.collect())


def requests(spark, *rows):
    full = [
        (i, r["ticker"], r.get("date_from"), r.get("date_to"), r.get("timeframe", "6M"),
         r.get("row_limit"), r.get("as_of", LAST))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, HISTORY_REQUEST)


@pytest.fixture
def market(make_bars, make_stocks):
    """AAA has 400 daily bars up to LAST, BBB three sparse ones, CCC none; DDD is inactive."""
    rows = [bar_row("AAA", LAST - i * DAY, 100 + i % 17, frequency=1 + i % 4) for i in range(400)]
    rows += [bar_row("BBB", d) for d in ("2026-01-01", "2026-07-25", "2026-08-21")]
    rows += [bar_row("DDD", "2026-08-20")]
    stocks = make_stocks(("AAA",), ("BBB",), ("CCC",), ("DDD", "Dee", None, None, False))
    return make_bars(*rows).cache(), stocks


def test_universe_window_is_relative_to_each_symbol(market):
    bars, stocks = market
    rows = hist.universe_rows(bars, "1M")
    assert days_of(rows.where("ticker = 'BBB'")) == ["2026-07-25", "2026-08-21"]
    assert days_of(rows.where("ticker = 'AAA'"))[0] == "2026-07-21"
    assert hist.universe_rows(bars, "ALL").count() == 404
    short, long = (hist.universe_rows(bars, t).count() for t in ("1M", "6M"))
    assert short < long < 404


def test_requests_match_brute_force(spark, market):
    bars, stocks = market
    rng = random.Random(7)
    rows = []
    for _ in range(120):
        day = LAST - rng.randrange(0, 450) * DAY
        rows.append(
            {
                "ticker": rng.choice(["aaa", "AAA", "AAA", "bbb", "CCC", "ddd", "ZZZ"]),
                "date_from": rng.choice([None, None, day - 20 * DAY, day + 5 * DAY]),
                "date_to": rng.choice([None, day]),
                "timeframe": rng.choice(["1M", "3M", "6M", "1Y", "ALL"]),
                "row_limit": rng.choice([None, 1, 5, 2000]),
            }
        )
    answer = hist.history(bars, stocks, requests(spark, *rows), provider="feed", prune=True)
    by_ticker: dict[str, list[dt.date]] = {}
    for r in bars.select("ticker", "trade_date").collect():
        by_ticker.setdefault(r.ticker, []).append(r.trade_date)
    got: dict[int, list[dt.date]] = {}
    for r in answer.bars.collect():
        got.setdefault(r.request_id, []).append(r.trade_date)
    heads = {r.request_id: r for r in answer.header.collect()}
    lookback = {"1M": 31, "3M": 93, "6M": 186, "1Y": 366}
    for i, r in enumerate(rows):
        ticker = r["ticker"].upper()
        if ticker == "ZZZ":
            assert i not in heads and i not in got
            continue
        known = sorted(by_ticker.get(ticker, []))
        start = r["date_from"]
        if start is None and r["timeframe"] != "ALL":
            anchor = r["date_to"] or (known[-1] if known else LAST)
            start = anchor - lookback[r["timeframe"]] * DAY
        days = [d for d in known if (not start or d >= start)
                and (not r["date_to"] or d <= r["date_to"])]
        days = days[-r["row_limit"]:] if r["row_limit"] else days
        assert sorted(got.get(i, [])) == days, r
        head = heads[i]
        assert head.n_bars == len(days)
        assert head.date_from == (days[0] if days else start)
        assert head.date_to == (days[-1] if days else r["date_to"])
        assert head.is_stale == (not days or days[-1] < LAST)
    missing = hist.not_found(requests(spark, *rows), stocks).count()
    assert missing == sum(r["ticker"] == "ZZZ" for r in rows)


def test_hot_symbol_is_sliced_without_loss(spark, market):
    bars, _ = market
    asked = spark.range(0, 90).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 3 < 2, "AAA").otherwise("BBB").alias("ticker"),
        F.lit(LAST - 9 * DAY).alias("start"),
        F.lit(None).cast("date").alias("date_to"),
    )
    plain = bars_for_requests(asked, bars, salts=1)
    sliced = bars_for_requests(asked, bars, salts=8)
    assert plain.count() == 60 * 10 + 30 * 1
    assert plain.exceptAll(sliced).count() == 0 and sliced.exceptAll(plain).count() == 0

    def tasks(rows):
        hot = rows.where("ticker = 'AAA'")
        return hot.select(F.spark_partition_id().alias("p")).distinct().count()

    # Where neither side is small enough to broadcast, slices decide the tasks.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert tasks(plain) == 1 and tasks(sliced) > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_old_end_date_is_stale_and_future_end_date_anchors(spark, market):
    bars, stocks = market
    asked = requests(
        spark,
        {"ticker": "AAA", "date_to": dt.date(2026, 1, 1), "timeframe": "1M"},
        {"ticker": "AAA", "date_to": LAST + 20 * DAY, "timeframe": "1M"},
        {"ticker": "AAA", "date_from": LAST, "date_to": LAST - DAY},
    )
    answer = hist.history(bars, stocks, asked, provider="feed", is_mock=True)
    heads = {r.request_id: r for r in answer.header.collect()}
    assert heads[0].is_stale and heads[0].latest_trade_date == dt.date(2026, 1, 1)
    assert heads[1].date_from == LAST + 20 * DAY - 31 * DAY and not heads[1].is_stale
    assert (heads[2].n_bars, heads[2].date_from, heads[2].latest_trade_date) == (0, LAST, None)
    assert heads[0].is_mock and heads[0].source == "feed"


def test_universe_header_without_bars(market):
    bars, stocks = market
    heads = hist.universe_history(bars, stocks, as_of="2026-08-23", provider="f", timeframe="1M")
    rows = {r.ticker: r for r in heads.header.collect()}
    assert rows["CCC"].date_from == dt.date(2026, 8, 23) - 31 * DAY
    assert rows["CCC"].is_stale and rows["CCC"].n_bars == 0
    assert rows["AAA"].n_bars == 32 and not rows["AAA"].is_stale
    assert rows["DDD"].is_stale


def test_watchlist(market, make_bars):
    bars, stocks = market
    rows = {r.ticker: r for r in watchlist.watchlist(bars, stocks).collect()}
    assert set(rows) == {"AAA", "BBB", "CCC"}
    assert len(rows["AAA"].sparkline) == 30 and rows["AAA"].sparkline[-1] == rows["AAA"].latest_close
    assert float(rows["AAA"].change_percent) == pytest.approx(100 / 99)
    assert (rows["CCC"].latest_close, rows["CCC"].sparkline, rows["CCC"].direction) == (
        None, [], "flat",
    )
    # The snapshot agrees with the end of the history.
    last = bars.where("ticker = 'AAA'").orderBy(F.desc("trade_date")).first()
    assert (rows["AAA"].latest_close, rows["AAA"].latest_trade_date) == (last.close, last.trade_date)


def test_search_takes_text_literally(make_stocks):
    stocks = make_stocks(("AAA", "Alpha_1 50%"), ("BBB", "Beta"))
    found = lambda text: [r.ticker for r in watchlist.search(stocks, text).collect()]
    assert found(" alpha ") == ["AAA"] and found("bb") == ["BBB"]
    assert found("%") == ["AAA"] and found("_") == ["AAA"] and len(found("  ")) == 2


def test_scaled_sparkline_of_short_series(make_bars, make_stocks):
    bars = make_bars(bar_row("AAA", LAST), bar_row("BBB", LAST - DAY, 10), bar_row("BBB", LAST, 30))
    listed = watchlist.watchlist(bars, make_stocks(("AAA",), ("BBB",), ("CCC",)))
    points = [(r.ticker, r.position, r.level) for r in watchlist.sparkline_scaled(listed).collect()]
    assert sorted(points) == [("BBB", 0.0, 0.0), ("BBB", 1.0, 1.0)]


def test_freshness(spark, market):
    bars, stocks = market
    args = {"as_of": "2026-08-23", "provider": "feed", "repository": "parquet"}
    runs = open_runs(stocks, "job", "feed", dt.datetime(2026, 8, 21, tzinfo=dt.UTC))
    row = status.freshness(bars, runs, **args).first()
    assert (row.latest_trade_date, row.is_stale, row.ingestion_status) == (LAST, False, "running")
    empty = status.freshness(bars.limit(0), runs.limit(0), **args).collect()
    assert len(empty) == 1 and empty[0].is_stale and empty[0].ingestion_status is None
    assert status.stock_detail(stocks, "aaa").first().company_name == "AAA Ltd"


def test_indicator_panel(make_bars):
    bars = make_bars(
        bar_row("AAA", LAST, volume_shares=3000, frequency=10),
        bar_row("AAA", LAST - DAY, volume_shares=3000, frequency=0),
        bar_row("AAA", LAST - 2 * DAY, volume_shares=0, frequency=10),
    )
    both = indicators.panel(bars, ["volume", "frequency-analyzer", "volume"])
    rows = {(r.indicator, r.trade_date): r for r in both.collect()}
    assert len(rows) == both.count() == 4
    assert rows["frequency-analyzer", LAST].value == pytest.approx(0.47712125)
    assert rows["volume", LAST].direction == "up"
    assert rows["frequency-analyzer", LAST].direction is None
    default = {r.indicator for r in indicators.panel(bars).collect()}
    assert default == {"volume"} == set(indicators.default_ids())


def test_indicator_registry_guards(make_bars):
    bars = make_bars(bar_row("AAA", LAST))
    with pytest.raises(ValueError, match="needs column frequency"):
        indicators.panel(bars.drop("frequency"), ["frequency-analyzer"])
    with pytest.raises(KeyError):
        indicators.panel(bars, ["macd"])
    with pytest.raises(ValueError, match="exists already"):
        indicators.register(indicators.VOLUME)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_watchlist_limits_before_the_shuffle(spark):
    plan = plan_of(REGISTRY["watchlist_snapshot"](spark, SMALL))
    assert "WindowGroupLimit" in plan


def test_universe_window_adds_no_shuffle(spark):
    """Bars come partitioned by ticker; latest date and row limit reuse that."""
    base = plan_of(REGISTRY["candles"](spark, SMALL)).count("Exchange hashpartitioning")
    rows = plan_of(REGISTRY["result_window_3m"](spark, SMALL))
    assert rows.count("Exchange hashpartitioning") <= base + 1


def test_symbol_history_pushes_the_ticker_and_takes_the_newest(spark, folder, make_bars, make_stocks):
    from barloom.plans.history import symbol_history
    from barloom.plans.ingest import seed
    from barloom.sources.tables import MarketTables

    tables = MarketTables(spark, folder, grain="month").create()
    bars = make_bars(*[bar_row(t, f"2026-08-{d:02}") for t in ("AAA", "BBB") for d in range(1, 21)])
    at = dt.datetime(2026, 8, 21, tzinfo=dt.UTC)
    seed(tables, bars, make_stocks(("AAA",), ("BBB",)), provider="feed", job_id="seed", at=at)
    found = symbol_history(tables.bars(), tables.stocks(), "aaa", timeframe="1M", row_limit=3)
    assert [r.trade_date.day for r in found.collect()] == [18, 19, 20]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ticker,AAA)" in plan and "TakeOrderedAndProject" in plan
    with pytest.raises(LookupError):
        symbol_history(tables.bars(), tables.stocks(), "ZZZ")
    with pytest.raises(ValueError):
        symbol_history(tables.bars(), tables.stocks(), "AAA", row_limit=2001)


def test_history_returns_rejected_requests(spark, make_bars, make_stocks):
    from barloom.plans.history import history
    from barloom.schema import HISTORY_REQUEST

    day = dt.date(2026, 8, 21)
    names = HISTORY_REQUEST.fieldNames()
    row = lambda **x: tuple({"date_from": None, "date_to": None, "row_limit": None, "as_of": day, **x}.get(n) for n in names)
    requests = spark.createDataFrame(
        [row(request_id=1, ticker="AAA", timeframe="1M"), row(request_id=2, ticker="AAA", timeframe="5Y"), row(request_id=3, ticker="AAA", timeframe="1M", row_limit=0)],
        HISTORY_REQUEST,
    )
    bars = make_bars(bar_row("AAA", "2026-08-03"))
    found = history(bars, make_stocks(("AAA",)), requests, provider="feed")
    assert [r.request_id for r in found.bars.collect()] == [1]
    assert {(r.request_id, r.reasons[0]) for r in found.rejected.collect()} == {(2, "unknown_timeframe"), (3, "row_limit_out_of_range")}


def test_a_symbol_that_stopped_does_not_widen_the_others(spark, folder, make_bars, make_stocks):
    from barloom.plans.ingest import seed
    from barloom.sources.tables import MarketTables

    tables = MarketTables(spark, folder, grain="month").create()
    days = [f"{y}-{m:02}-10" for y in range(2015, 2027) for m in range(1, 9)]
    bars = make_bars(*[bar_row("AAA", d) for d in days], bar_row("OLD", "2015-03-10"), bar_row("OLD", "2015-03-12"))
    stocks = make_stocks(("AAA",), ("OLD",))
    seed(tables, bars, stocks, provider="feed", job_id="seed", at=dt.datetime(2026, 8, 21, tzinfo=dt.UTC))
    rows = hist.universe_rows(tables.bars(), "1M")
    got = sorted((r.ticker, str(r.trade_date)) for r in rows.collect())
    assert got == [("AAA", "2026-07-10"), ("AAA", "2026-08-10"), ("OLD", "2015-03-10"), ("OLD", "2015-03-12")]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "IN (201502,201503,202607,202608)" in plan.replace(" IN ", " IN ")
    quotes = {r.ticker: str(r.trade_date) for r in watchlist.latest_quotes(tables.bars(), tables.stocks()).collect()}
    assert quotes == {"AAA": "2026-08-10", "OLD": "2015-03-12"}
    early = {r.ticker: str(r.trade_date) for r in status.summary_as_of(tables.bars(), tables.stocks(), dt.date(2015, 3, 11)).collect()}
    assert early == {"AAA": "2015-03-10", "OLD": "2015-03-10"}
    fresh = status.freshness_by_ticker(tables.bars(), tables.stocks(), as_of=dt.date(2026, 8, 10))
    assert {r.ticker: r.is_stale for r in fresh.collect()} == {"AAA": False, "OLD": True}
