from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from conftest import bar_row
from pyspark.sql import functions as F

from barloom.operators import latest, quality, runlog, upsert
from barloom.operators.quality import BAR_RULES, STOCK_RULES, assess, split
from barloom.schema import BAR_COLUMNS, BAR_KEY
from barloom.sources.providers import pull_window

T0 = dt.datetime(2024, 1, 1, 8, tzinfo=dt.UTC)
T1 = dt.datetime(2024, 1, 2, 8, tzinfo=dt.UTC)
T2 = dt.datetime(2024, 1, 3, 8, tzinfo=dt.UTC)


def stored(bars, at=T0):
    at = upsert.as_instant(at)
    return bars.select(
        *BAR_COLUMNS, at.alias("ingested_at"), at.alias("created_at"), at.alias("updated_at")
    )


def batch(bars, arrival=None):
    rows = bars.withColumn("arrival", F.lit(1)) if arrival is None else arrival
    return upsert.last_wins(rows, BAR_KEY, ["arrival"])


@pytest.mark.parametrize(
    ("facts", "reasons"),
    [
        ({}, []),
        ({"frequency": 0, "volume_shares": 0}, []),
        ({"high": 90, "low": 80, "close": 95}, ["high_too_low"]),
        ({"low": 101, "high": 103}, ["low_too_high"]),
        ({"close": 0}, ["close_not_positive", "low_too_high"]),
        ({"previous": None}, ["previous_not_positive"]),
        ({"volume_shares": -1, "frequency": None}, ["volume_shares_negative", "frequency_negative"]),
        ({"foreign_buy_shares": 0, "non_regular_value_idr": None}, []),
        ({"non_regular_value_idr": -1}, ["non_regular_value_idr_negative"]),
        ({"source": "\t "}, ["blank_source"]),
        ({"source": None}, ["blank_source"]),
    ],
)
def test_bar_rules(make_bars, facts, reasons):
    exact = {
        k: Decimal(v) if isinstance(v, int) and k not in ("volume_shares", "frequency",
        "foreign_buy_shares") else v for k, v in facts.items()
    }
    row = assess(make_bars(bar_row("AAA", "2026-08-21", **exact)), BAR_RULES).first()
    assert row.reasons == reasons


@pytest.mark.parametrize("ticker", ["aaa", "A-B", "", "A\n", "ABCDEFGHIJKLM", None])
def test_bad_tickers(make_bars, ticker):
    assert assess(make_bars(bar_row(ticker, "2026-08-21")), BAR_RULES).first().reasons == [
        "bad_ticker"
    ]


def test_split_adds_up_to_the_input(make_bars):
    rows = [bar_row(f"A{i}", "2026-08-21", frequency=i - 2) for i in range(6)]
    parts = split(assess(make_bars(*rows), BAR_RULES))
    assert sorted(r.ticker for r in parts.quarantine.collect()) == ["A0", "A1"]
    assert parts.valid.columns == BAR_COLUMNS and parts.valid.count() == 4


def test_stock_rules_and_missing_columns(spark):
    frame = spark.createDataFrame([("AAA", " "), ("b", "B")], "ticker string, company_name string")
    got = {r.ticker: r.reasons for r in assess(frame, STOCK_RULES).collect()}
    assert got == {"AAA": ["blank_company_name"], "b": ["bad_ticker"]}
    with pytest.raises(ValueError, match="needs column"):
        assess(frame, BAR_RULES)


def test_request_arguments():
    quality.check_request("6M", 2000)
    for timeframe, limit in (("2M", None), ("6M", 0), ("6M", 2001)):
        with pytest.raises(ValueError):
            quality.check_request(timeframe, limit)


def test_last_wins_and_order_does_not_matter(spark, make_bars):
    rows = make_bars(*[bar_row("AAA", "2026-08-21", c) for c in (100, 120, 110)])
    arrived = rows.withColumn("arrival", (F.col("close") % 7).cast("int"))
    for frame in (arrived, arrived.orderBy(F.desc("close"))):
        row = batch(rows, frame).first()
        assert (row.close, row.copies) == (Decimal("110"), 3)  # 100%7=2, 120%7=1, 110%7=5


def test_merge_counts_include_repeated_rows(make_bars):
    old = make_bars(bar_row("AAA", "2026-08-20"))
    new = make_bars(
        bar_row("AAA", "2026-08-20"), bar_row("AAA", "2026-08-21"), bar_row("AAA", "2026-08-21"),
        bar_row("BBB", "2026-08-21"),
    )
    got = {r.ticker: tuple(r)[1:] for r in upsert.merge_counts(batch(new), old).collect()}
    assert got == {"AAA": (3, 1, 2), "BBB": (1, 1, 0)}


def test_merge_replaces_facts_and_keeps_first_instants(spark, make_bars):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    old = make_bars(
        bar_row("AAA", "2026-08-20", foreign_buy_shares=7), bar_row("AAA", "2026-08-19")
    )
    new = make_bars(bar_row("AAA", "2026-08-20", 200), bar_row("AAA", "2026-08-21"))
    merged = upsert.merge_bars(stored(old), batch(new), T1)
    rows = {str(r.trade_date): r for r in merged.collect()}
    assert [rows[d].close for d in sorted(rows)] == [100, 200, 100]
    assert rows["2026-08-20"].foreign_buy_shares is None
    when = {
        d: (r.created_at.day, r.ingested_at.day, r.updated_at.day) for d, r in rows.items()
    }
    assert when == {"2026-08-19": (1, 1, 1), "2026-08-20": (1, 1, 2), "2026-08-21": (2, 2, 2)}
    kept = upsert.merge_bars(stored(old), batch(new), T1, coalesce_nulls=True)
    assert kept.where("trade_date = '2026-08-20'").first().foreign_buy_shares == 7


def test_merge_is_idempotent(make_bars):
    old = make_bars(*[bar_row("AAA", f"2026-08-{d:02}") for d in range(1, 11)])
    new = batch(make_bars(*[bar_row("AAA", f"2026-08-{d:02}", 50) for d in range(5, 21)]))
    once = upsert.merge_bars(stored(old), new, T1)
    twice = upsert.merge_bars(once, new, T1)
    assert sorted(once.collect()) == sorted(twice.collect()) and once.count() == 20


def test_stock_merge_activates_and_overwrites_with_null(spark, make_stocks):
    at = upsert.as_instant(T0)
    old = make_stocks(("AAA", "Old", "Sector", "Sub", False), ("BBB", "B", "S", "T", False))
    held = old.select("*", at.alias("created_at"), at.alias("updated_at"))
    merged = upsert.merge_stocks(held, make_stocks(("AAA", "New"), ("CCC", "C")), T1)
    rows = {r.ticker: (r.company_name, r.sector, r.is_active) for r in merged.collect()}
    assert rows == {
        "AAA": ("New", None, True), "BBB": ("B", "S", False), "CCC": ("C", None, True),
    }


def test_newest_rows_and_pull_window(make_bars):
    bars = make_bars(*[bar_row("AAA", f"2026-08-{d:02}") for d in range(1, 11)])

    def days(rows):
        return sorted(r.trade_date.day for r in rows.collect())

    assert days(latest.newest_rows(bars, 3)) == [8, 9, 10]
    assert days(pull_window(bars, "2026-08-03", "2026-08-06", limit=2)) == [5, 6]
    assert days(pull_window(bars, limit=4)) == [7, 8, 9, 10]
    assert days(pull_window(bars)) == list(range(1, 11))
    with pytest.raises(ValueError):
        pull_window(bars, limit=0)


def test_latest_on_or_before(make_bars):
    bars = make_bars(
        bar_row("AAA", "2026-08-10", 10), bar_row("AAA", "2026-08-20", 20),
        bar_row("BBB", "2026-08-20", 30),
    )
    rows = latest.latest_on_or_before(bars, "2026-08-15", ["trade_date", "close"]).collect()
    assert [(r.ticker, r.close) for r in rows] == [("AAA", 10)]
    assert latest.latest_date(bars.limit(0)).first().latest_trade_date is None


def test_run_log(spark):
    tickers = spark.createDataFrame([("AAA",), ("BBB",)], "ticker string")
    opened = runlog.open_runs(tickers, "job", "feed", T0, dt.date(2026, 8, 21))
    assert runlog.latest_run(opened).first().status == "running"
    outcome = spark.createDataFrame(
        [("AAA", 5, 3, 2, None, False), ("BBB", 5, 3, 2, "x" * 1500, True)],
        "ticker string, rows_received long, rows_inserted long, rows_updated long, error string,"
        "failed boolean",
    )
    events = opened.unionByName(runlog.close_runs(opened, outcome, T1))
    state = {r.ticker: r for r in runlog.current_state(events).collect()}
    assert (state["AAA"].status, state["AAA"].rows_inserted) == ("succeeded", 3)
    assert (state["BBB"].status, state["BBB"].rows_received) == ("failed", 0)
    assert len(state["BBB"].error_message) == 1500 and state["AAA"].error_message is None
    shown = runlog.current_state(events).select(runlog.shown_error(F.col("error_message")).alias("e"))
    assert {len(r.e) for r in shown.collect() if r.e} == {1000}
    assert assess(events, quality.RUN_RULES).where(F.size("reasons") > 0).count() == 0
    newest = runlog.latest_run(events).first()
    assert (newest.provider, newest.status) == ("feed", "failed")
    assert runlog.latest_run(events.limit(0)).count() == 0


def test_few_requests_of_a_symbol_take_one_copy_of_its_bars(spark, make_bars):
    from barloom.operators.joins import bars_for_requests

    bars = make_bars(*[bar_row("AAA", f"2026-08-{d:02}") for d in range(1, 21)])
    asked = spark.range(40).selectExpr(
        "id as request_id", "'AAA' as ticker", "cast(null as date) as start", "date'2026-08-10' as date_to"
    )
    one = bars_for_requests(asked.where("request_id < 20"), bars, keep_slice=True)
    many = bars_for_requests(asked, bars, keep_slice=True)
    assert one.select("slice").distinct().count() == 1 < many.select("slice").distinct().count()
    assert one.count() == 200 and many.count() == 400
    assert one.drop("slice").exceptAll(many.drop("slice")).isEmpty()
