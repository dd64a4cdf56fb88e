from __future__ import annotations

import datetime as dt
import glob
import json
import shutil
import time

import pytest
from conftest import bar_row
from pyspark.sql import functions as F

from barloom.operators.latest import latest_date, newest_rows
from barloom.operators.runlog import current_state, latest_run
from barloom.plans.history import universe_rows, window_of_result
from barloom.plans.watchlist import watchlist
from barloom.plans.ingest import IngestError, ingest, quarantine, seed
from barloom.session import SHUFFLE_CLEANUP
from barloom.sources.payloads import Feed, history_payloads, read_history, read_summary
from barloom.sources.providers import LandedProvider, TableProvider
from barloom.sources.tables import MarketTables, publish_bucketed
from barloom.streaming.incremental import start_ingest

T0 = dt.datetime(2026, 8, 21, 18, tzinfo=dt.UTC)
T1 = dt.datetime(2026, 8, 22, 18, tzinfo=dt.UTC)


def item(day, close=100, **changes):
    record = {
        "date": day, "open": close, "high": close + 2, "low": close - 2, "close": close,
        "previous": close, "volume": 3000, "value": 300000, "frequency": 10,
    }
    return {**record, **changes}


def payload(code, *items, **changes):
    return {"code": code, "name": f"{code} Tbk", "unit": "shares", "items": list(items), **changes}


def august(n, **changes):
    return [item(f"2026-08-{d:02}", **changes) for d in range(1, n + 1)]


@pytest.fixture
def landed(spark):
    def make(*payloads):
        rows = [(f"p{i}", json.dumps(p) if isinstance(p, dict) else p) for i, p in enumerate(payloads)]
        frame = spark.createDataFrame(rows, "payload_id string, payload string")
        return frame.withColumn("arrived_at", F.lit(None).cast("timestamp"))

    return make


@pytest.fixture
def tables(spark, folder):
    return MarketTables(spark, folder, grain="month").create()


def counts(runs):
    return {
        r.ticker: (r.status, r.rows_received, r.rows_inserted, r.rows_updated)
        for r in runs.collect()
    }


def run(tables, frame, job, at=T0, read=read_history, **options):
    return ingest(tables, read(frame, "feed"), provider="feed", job_id=job, at=at, **options)


def test_ingest_twice_inserts_then_updates(tables, landed):
    frame = landed(payload("AAA", *august(30)), payload("BBB", *august(5)))
    first, second = run(tables, frame, "one"), run(tables, frame, "two", T1)
    assert counts(first) == {"AAA": ("succeeded", 30, 30, 0), "BBB": ("succeeded", 5, 5, 0)}
    assert counts(second) == {"AAA": ("succeeded", 30, 0, 30), "BBB": ("succeeded", 5, 0, 5)}
    assert tables.bars().count() == 35
    stocks = {r.ticker: (r.company_name, r.is_active) for r in tables.stocks().collect()}
    assert stocks == {"AAA": ("AAA Tbk", True), "BBB": ("BBB Tbk", True)}
    assert latest_run(tables.runs()).first().finished_at is not None


def test_job_that_ran_is_not_repeated(tables, landed):
    frame = landed(payload("AAA", *august(3)))
    run(tables, frame, "one")
    again = run(tables, landed(payload("AAA", *august(9))), "one", T1)
    assert counts(again) == {"AAA": ("succeeded", 3, 3, 0)}
    assert tables.bars().count() == 3
    # The job and its one symbol, each opened and closed.
    assert tables.runs().count() == 4


@pytest.mark.parametrize("step", ["overwrite_bars", "overwrite_stocks"])
def test_rerun_after_a_crash_counts_once(tables, landed, monkeypatch, step):
    run(tables, landed(payload("AAA", *august(2))), "zero")
    frame = landed(payload("AAA", *august(5)))
    real = getattr(MarketTables, step)

    def write_then_fail(self, rows):
        real(self, rows)
        raise OSError("executor lost")

    monkeypatch.setattr(MarketTables, step, write_then_fail)
    with pytest.raises(OSError):
        run(tables, frame, "one")
    monkeypatch.setattr(MarketTables, step, real)
    log = tables.runs().where("job_id = 'one'")
    assert {r.status for r in current_state(log).collect()} == {"failed"}
    assert log.where("error_message like '%executor lost%'").count() == 2
    assert counts(run(tables, frame, "one", T1)) == {"AAA": ("succeeded", 5, 3, 2)}
    assert tables.bars().count() == 5 and tables.stocks().count() == 1


def test_rerun_restores_a_period_lost_inside_the_commit(tables, landed, monkeypatch):
    """The write is stopped between the deletion of an old partition and the move of the new one."""
    run(tables, landed(payload("AAA", *august(6))), "zero")
    real = MarketTables.overwrite_bars

    def lose_the_period(self, rows):
        for folder in glob.glob(f"{self.path('bars').removeprefix('file:')}/trade_*=*"):
            shutil.move(folder, f"{folder}.lost".replace("/bars/", "/bars-"))
        raise OSError("driver lost")

    monkeypatch.setattr(MarketTables, "overwrite_bars", lose_the_period)
    frame = landed(payload("AAA", item("2026-08-25")))
    with pytest.raises(OSError):
        run(tables, frame, "one")
    monkeypatch.setattr(MarketTables, "overwrite_bars", real)
    assert tables.bars().count() == 0
    assert counts(run(tables, frame, "one", T1))["AAA"][0] == "succeeded"
    assert tables.bars().count() == 7


def test_a_job_that_fails_while_parsing_is_logged_and_may_run_again(tables, landed):
    frame = landed(payload("AAA", *august(2)))
    feed = read_history(frame, "feed")
    broken = Feed(feed.parsed.withColumn("open", F.raise_error(F.lit("no such disk")).cast("decimal(18,2)")))
    with pytest.raises(Exception, match="no such disk"):
        ingest(tables, broken, provider="feed", job_id="one", at=T0, clock=lambda: T1)
    last = latest_run(tables.runs()).first()
    assert last.status == "failed" and last.finished_at > T0.replace(tzinfo=None)
    assert counts(run(tables, frame, "one", T1)) == {"AAA": ("succeeded", 2, 2, 0)}


def test_finish_is_taken_from_the_clock(tables, landed):
    runs = run(tables, landed(payload("AAA", *august(2))), "one", clock=lambda: T1)
    row = runs.first()
    assert row.finished_at > row.started_at


def test_damaged_payloads_are_kept_when_tickers_are_asked_for(tables, landed, spark):
    frame = landed(payload("AAA", *august(2)), "{broken", payload("B-B", item("2026-08-01")), payload("CCC", *august(1)))
    wanted = spark.createDataFrame([("aaa",), ("ddd",)], "ticker string")
    got = counts(run(tables, frame, "one", tickers=wanted))
    assert got["AAA"] == ("succeeded", 2, 2, 0) and got["DDD"][0] == "failed" and "CCC" not in got
    assert got["?"][0] == "failed"
    assert {r.reasons[0] for r in quarantine(tables, "one").collect()} == {"malformed_json", "bad_ticker"}


def test_a_blank_company_name_is_not_stored(tables, landed):
    frame = landed(payload("AAA", *august(2), name="  "))
    assert counts(run(tables, frame, "one"))["AAA"][0] in ("failed", "succeeded")
    assert tables.stocks().count() == 0 and tables.bars().count() == 0
    assert {tuple(r.reasons) for r in quarantine(tables, "one").collect()} == {("blank_company_name",)}


def test_an_explicit_limit_is_honoured(tables, landed):
    frame = landed(payload("AAA", *august(30)))
    assert counts(run(tables, frame, "one", limit=29))["AAA"][1] == 29


def test_bad_rows_go_to_quarantine(tables, landed):
    frame = landed(
        payload("AAA", item("2026-08-03"), item("2026-08-04", volume=-1), item("x"), 7),
        payload("BBB", *august(2), unit="lots"),
        "{broken",
    )
    got = counts(run(tables, frame, "one"))
    assert got == {
        "AAA": ("succeeded", 1, 1, 0), "BBB": ("failed", 0, 0, 0), "?": ("failed", 0, 0, 0),
    }
    errors = {r.ticker: r.error_message for r in tables.runs().where("event_seq = 1").collect()}
    assert (errors["BBB"], errors["?"]) == ("unit_not_shares", "malformed_json")
    rejected = quarantine(tables, "one").collect()
    faults = ("unit_not_shares", "malformed_json")
    assert {r.reasons[0] for r in rejected if r.reasons[0] in faults} == set(faults)
    bad = {str(r.trade_date): r.reasons for r in rejected if r.reasons[0] not in faults}
    assert bad == {
        "2026-08-04": ["volume_shares_negative"],
        "None": ["trade_date_unreadable", "no_trade_date"],
    }
    assert [r.ticker for r in tables.stocks().collect()] == ["AAA"]


def test_whole_payloads_and_fail_fast(tables, landed):
    spoilt = payload("AAA", item("2026-08-03"), item("2026-08-04", close=0))
    frame = landed(spoilt, payload("BBB", *august(2)))
    with pytest.raises(IngestError, match="^AAA: .*close_not_positive"):
        run(tables, frame, "one", whole_payloads=True, fail_fast=True)
    assert {r.ticker for r in tables.bars().collect()} == {"BBB"}


def test_one_bad_row_of_a_summary_fails_all_its_symbols(tables, landed):
    def row(code, volume):
        return {
            "Date": "2026-08-03", "StockCode": code, "StockName": code, "OpenPrice": 1, "High": 1,
            "Low": 1, "Close": 1, "Previous": 1, "Volume": volume, "Value": 1, "Frequency": 1,
        }

    frame = landed({"data": [row("AAA", 1), row("BBB", -1)]}, {"data": [row("CCC", 1)]})
    got = counts(run(tables, frame, "one", read=read_summary, whole_payloads=True))
    assert got == {
        "AAA": ("failed", 0, 0, 0), "BBB": ("failed", 0, 0, 0), "CCC": ("succeeded", 1, 1, 0),
    }
    assert [r.ticker for r in tables.bars().collect()] == ["CCC"]


def test_rejected_payload_beside_a_good_one(tables, landed):
    good, bad = payload("AAA", *august(2)), payload("AAA", *august(3), unit="lots")
    got = run(tables, landed(good, bad), "one").first()
    assert (got.status, got.rows_inserted, got.error_message) == ("succeeded", 2, "unit_not_shares")
    whole = counts(run(tables, landed(good, bad), "two", whole_payloads=True))
    assert whole == {"AAA": ("failed", 0, 0, 0)}


def test_symbol_with_only_bad_rows_writes_nothing(tables, landed):
    got = counts(run(tables, landed(payload("AAA", item("2026-08-03", frequency=-1))), "one"))
    assert got == {"AAA": ("succeeded", 0, 0, 0)}
    assert tables.bars().count() == 0 and tables.stocks().count() == 0


def test_requested_symbols_range_and_limit(spark, tables, landed):
    frame = landed(payload("AAA", *august(20)), payload("BBB", *august(20)))
    asked = spark.createDataFrame([("aaa",), ("zzz",)], "ticker string")
    window = {"date_from": dt.date(2026, 8, 5), "date_to": dt.date(2026, 8, 15), "limit": 4}
    got = counts(run(tables, frame, "one", tickers=asked, **window))
    assert got == {"AAA": ("succeeded", 4, 4, 0), "ZZZ": ("failed", 0, 0, 0)}
    assert sorted(r.trade_date.day for r in tables.bars().collect()) == [12, 13, 14, 15]
    assert {r.requested_date for r in tables.runs().collect()} == {dt.date(2026, 8, 15)}


def test_duplicate_dates_in_a_batch_last_wins(tables, landed):
    frame = landed(payload("AAA", item("2026-08-03", 100), item("2026-08-03", 150)))
    assert counts(run(tables, frame, "one")) == {"AAA": ("succeeded", 2, 1, 1)}
    assert tables.bars().first().close == 150


def test_history_after_summary_nulls_what_history_lacks(tables, landed):
    row = {
        "Date": "2026-08-03", "StockCode": "AAA", "StockName": "A", "OpenPrice": 1, "High": 1,
        "Low": 1, "Close": 1, "Previous": 1, "Volume": 1, "Value": 1, "Frequency": 1,
        "NonRegularVolume": 5,
    }
    run(tables, landed({"data": [row]}), "one", read=read_summary)
    assert tables.bars().first().non_regular_volume_shares == 5
    run(tables, landed(payload("AAA", item("2026-08-03"))), "two", coalesce_nulls=True)
    assert tables.bars().first().non_regular_volume_shares == 5
    run(tables, landed(payload("AAA", item("2026-08-03"))), "three")
    assert tables.bars().first().non_regular_volume_shares is None


def test_merge_rewrites_only_touched_periods(spark, tables, landed):
    run(tables, landed(payload("AAA", item("2026-07-01"), item("2026-08-03"))), "one")

    def files(period):
        path = tables.path(f"bars/trade_month={period}")
        return {r.f for r in spark.read.parquet(path).select(
            F.col("_metadata.file_path").alias("f")).distinct().collect()}

    july, before = files(202607), files(202608)
    run(tables, landed(payload("AAA", item("2026-08-04"))), "two")
    assert files(202607) == july and files(202608).isdisjoint(before)
    assert tables.bars().count() == 3


def test_date_range_prunes_partitions(spark, tables, landed):
    run(tables, landed(payload("AAA", item("2026-07-01"), item("2026-08-03"))), "one")
    rows = tables.bars("2026-08-01", "2026-08-31")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    filters = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "trade_month" in filters.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(trade_date" in filters
    assert rows.count() == 1


def test_open_ended_window_reads_only_reachable_partitions(spark, tables, make_bars, make_stocks):
    bars = make_bars(
        *[bar_row("AAA", dt.date(2026, 8, 21) - dt.timedelta(days=7 * i)) for i in range(60)],
        *[bar_row("BBB", dt.date(2026, 8, 3) - dt.timedelta(days=i)) for i in range(60)],
    )
    seed(tables, bars, make_stocks(("AAA",), ("BBB",)), provider="feed", job_id="seed", at=T0)
    found = universe_rows(tables.bars(), "3M", row_limit=10)
    expected = newest_rows(window_of_result(bars, "3M"), 10)
    assert sorted(r[:2] for r in found.collect()) == sorted(r[:2] for r in expected.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The periods that a symbol's own window reaches are named in the scan; older ones aren't read.
    scans = [x.split("PartitionFilters")[1].split("PushedFilters")[0] for x in plan.splitlines() if "FileScan" in x]
    assert any("trade_month" in x and all(f"20260{m}" in x for m in (5, 6, 7, 8)) and "202604" not in x for x in scans)
    assert found.columns == tables.bars().columns
    newest = latest_date(tables.bars())
    assert newest.first().latest_trade_date == dt.date(2026, 8, 21)
    assert "trade_month" in newest._jdf.queryExecution().executedPlan().toString()


def test_stored_watchlist_looks_further_back_where_needed(tables, make_bars, make_stocks):
    """AAA trades daily, BBB monthly, CCC stopped long ago, DDD is new, EEE never traded."""
    end = dt.date(2026, 8, 21)

    def series(ticker, n, step, last=end):
        return [bar_row(ticker, last - dt.timedelta(days=step * i), 50 + i) for i in range(n)]

    bars = make_bars(
        *series("AAA", 90, 1), *series("BBB", 9, 31), *series("DDD", 2, 1),
        *series("CCC", 12, 1, dt.date(2025, 1, 20)),
    )
    stocks = make_stocks(*[(t,) for t in ("AAA", "BBB", "CCC", "DDD", "EEE")])
    seed(tables, bars, stocks, provider="feed", job_id="seed", at=T0)
    for depth in (1, 5, 10):
        stored = watchlist(tables.bars(), tables.stocks(), depth).collect()
        assert sorted(stored) == sorted(watchlist(bars, stocks, depth).collect())
    lines = {r.ticker: len(r.sparkline) for r in stored}
    assert lines == {"AAA": 10, "BBB": 9, "CCC": 10, "DDD": 2, "EEE": 0}


def test_seed_and_providers(spark, tables, make_bars, make_stocks, folder):
    bars = make_bars(*[bar_row("AAA", f"2026-08-{d:02}") for d in range(1, 11)])
    stocks = make_stocks(("AAA", "Alpha", "S", "T"))
    seed(tables, bars, stocks, provider="feed", job_id="seed", at=T0)
    seed(tables, bars, stocks, provider="feed", job_id="seed", at=T1)
    log = current_state(tables.runs()).collect()
    assert [(r.status, r.rows_received, r.rows_inserted) for r in log] == [("succeeded", 10, 0)]
    with pytest.raises(IngestError):
        seed(tables, bars, stocks, provider="feed", job_id="second", at=T1)
    assert tables.bars().count() == 10
    source = TableProvider("mirror", bars, stocks)
    other = MarketTables(spark, f"{folder}/other").create()
    runs = ingest(other, source.history(), provider=source.name, job_id="m", at=T0, limit=260)
    assert counts(runs) == {"AAA": ("succeeded", 10, 10, 0)}
    assert {(r.source, r.sector) for r in other.bars().join(other.stocks(), "ticker").collect()} == {
        ("mirror", "S")
    }
    day = dt.date(2026, 8, 5)
    assert [r.trade_date for r in source.summary(day).rows.collect()] == [day]


def test_seed_checks_its_rows(tables, make_bars, make_stocks):
    good = bar_row("AAA", "2026-08-03")
    bars = make_bars(good, good, bar_row("AAA", "2026-08-04", volume_shares=-1))
    seed(tables, bars, make_stocks(("AAA",)), provider="feed", job_id="seed", at=T0)
    assert tables.bars().count() == 1
    assert {tuple(r.reasons) for r in quarantine(tables, "seed").collect()} == {("volume_shares_negative",)}
    assert latest_run(tables.runs()).first().rows_received == 2


def test_landed_provider(spark, folder):
    text = json.dumps(payload("AAA", *august(2)))
    spark.createDataFrame([(text,)], "value string").write.text(f"{folder}/in")
    provider = LandedProvider(spark, "feed", f"{folder}/in")
    assert provider.history().rows.count() == 2


def land(spark, folder, *payloads):
    frame = spark.createDataFrame([(json.dumps(p),) for p in payloads], "value string")
    frame.write.mode("append").text(f"{folder}/landing")


def test_stream_takes_late_and_restated_bars(spark, folder):
    tables = MarketTables(spark, f"{folder}/tables").create()

    def drain():
        start_ingest(
            tables, f"{folder}/landing", f"{folder}/checkpoint", provider="feed", stream="eod",
            one_per_line=True,
        ).awaitTermination()

    land(spark, folder, payload("AAA", item("2026-08-03"), item("2026-08-05")))
    drain()
    land(spark, folder, payload("AAA", item("2026-08-04"), item("2026-08-03", close=120)))
    drain()
    drain()
    rows = {r.trade_date.day: int(r.close) for r in tables.bars().collect()}
    assert rows == {3: 120, 4: 100, 5: 100}
    # A new checkpoint counts its batches from zero, but its jobs are not taken for old ones.
    land(spark, folder, payload("AAA", item("2026-08-06")))
    start_ingest(
        tables, f"{folder}/landing", f"{folder}/checkpoint2", provider="feed", stream="eod",
        one_per_line=True,
    ).awaitTermination()
    assert tables.bars().count() == 4
    closed = tables.runs().where("event_seq = 1 and ticker is not null").orderBy("started_at").collect()
    assert [(r.rows_inserted, r.rows_updated) for r in closed] == [(2, 0), (1, 1), (1, 4)]


def test_bucketed_copy_needs_no_shuffle(spark, folder, make_bars):
    bars = make_bars(*[bar_row(f"A{i % 5}", f"2026-08-{1 + i // 5:02}") for i in range(50)])
    publish_bucketed(bars, "bars_bucketed", f"{folder}/bucketed", buckets=4)
    rows = universe_rows(spark.table("bars_bucketed"), "1M", row_limit=3)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 15
    spark.sql("drop table bars_bucketed")


def test_a_seed_shuffles_whole_rows_of_repeated_keys_only(spark, folder, make_bars, make_stocks, monkeypatch):
    from barloom.plans import ingest as plan

    seen = []

    def counted(rows, key, arrival):
        seen.append(rows.count())
        return last_wins(rows, key, arrival)

    last_wins = plan.last_wins
    monkeypatch.setattr(plan, "last_wins", counted)
    tables = MarketTables(spark, folder, grain="month").create()
    bars = make_bars(
        *[bar_row("AAA", f"2026-08-{d:02}") for d in range(1, 21)], bar_row("AAA", "2026-08-20", price=120), bar_row("BBB", "2026-08-20")
    )
    plan.seed(tables, bars, make_stocks(("AAA",), ("BBB",)), provider="feed", job_id="seed", at=dt.datetime(2026, 8, 21, tzinfo=dt.UTC))
    assert seen == [2]
    held = {(r.ticker, r.trade_date.day): int(r.close) for r in tables.bars().collect()}
    assert len(held) == 21 and held["AAA", 20] == 120 and held["AAA", 19] == 100 and held["BBB", 20] == 100


def test_bars_of_the_test_tables_are_shuffled_once(spark):
    from barloom.sources import fixtures

    plan = fixtures.bars(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_a_batch_shuffles_whole_rows_of_repeated_keys_only(tables, landed, monkeypatch):
    from barloom.plans import ingest as plan

    seen, last_wins = [], plan.last_wins

    def counted(rows, key, arrival):
        if key == ["ticker", "trade_date"]:
            seen.append(rows.count())
        return last_wins(rows, key, arrival)

    monkeypatch.setattr(plan, "last_wins", counted)
    frame = landed(payload("AAA", *august(20), item("2026-08-20", 120)), payload("BBB", item("2026-08-20")))
    assert counts(run(tables, frame, "one")) == {"AAA": ("succeeded", 21, 20, 1), "BBB": ("succeeded", 1, 1, 0)}
    assert seen == [2]
    held = {(r.ticker, r.trade_date.day): int(r.close) for r in tables.bars().collect()}
    assert len(held) == 21 and held["AAA", 20] == 120 and held["AAA", 19] == 100


def test_keys_of_one_hash_stay_apart(spark, make_bars):
    from barloom.plans.ingest import key_hash, one_each

    bars = make_bars(bar_row("AAA", "2026-08-20"), bar_row("BBB", "2026-08-20"), bar_row("BBB", "2026-08-20", price=120))
    suspected = bars.select(key_hash()).distinct()
    held = {r.ticker: (int(r.close), r.copies) for r in one_each(bars, suspected, []).collect()}
    assert held == {"AAA": (100, 1), "BBB": (120, 2)}


def test_rules_run_no_lambda_on_sound_rows(make_bars):
    """A lambda is interpreted for every row; a row that breaks no rule takes the constant."""
    from barloom.operators.quality import BAR_RULES, assess

    made = assess(make_bars(bar_row("AAA", "2026-08-20"), bar_row("BBB", "2026-08-20", price=0, source=" \t")), BAR_RULES)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("CASE WHEN isnotnull(coalesce(") < plan.index("filter(")
    found = {r.ticker: r.reasons for r in made.collect()}
    assert found["AAA"] == [] and "open_not_positive" in found["BBB"] and found["BBB"][-1] == "blank_source"


def test_a_large_batch_is_merged_in_parts_of_its_periods(spark, tables, landed, monkeypatch):
    from barloom.sources import tables as store

    monkeypatch.setattr(store, "MERGED_AT_ONCE", 1)
    run(tables, landed(payload("AAA", item("2026-07-31"), item("2026-08-03"))), "zero")
    seen, write = [], MarketTables.overwrite_bars

    def noted(self, rows):
        seen.append(sorted(str(r.trade_date)[:7] for r in rows.collect()))
        write(self, rows)

    monkeypatch.setattr(MarketTables, "overwrite_bars", noted)
    frame = landed(payload("AAA", item("2026-06-30", 90), item("2026-07-31", 90), item("2026-08-04", 90)), payload("BBB", item("2026-09-01", 90)))
    assert counts(run(tables, frame, "one", T1)) == {"AAA": ("succeeded", 3, 2, 1), "BBB": ("succeeded", 1, 1, 0)}
    assert seen == [["2026-06"], ["2026-07"], ["2026-08", "2026-08"], ["2026-09"]]
    held = {(r.ticker, str(r.trade_date)): (int(r.close), r.created_at == r.updated_at) for r in tables.bars().collect()}
    assert held == {
        ("AAA", "2026-06-30"): (90, True), ("AAA", "2026-07-31"): (90, False), ("AAA", "2026-08-03"): (100, True),
        ("AAA", "2026-08-04"): (90, True), ("BBB", "2026-09-01"): (90, True),
    }


def test_a_rerun_writes_the_parts_that_are_left(tables, landed, monkeypatch):
    from barloom.sources import tables as store

    monkeypatch.setattr(store, "MERGED_AT_ONCE", 1)
    run(tables, landed(payload("AAA", *august(6))), "zero")
    real, written = MarketTables.overwrite_bars, []

    def fail_at_second(self, rows):
        if written:
            raise OSError("executor lost")
        written.append(rows.count())
        real(self, rows)

    frame = landed(payload("AAA", item("2026-07-01"), item("2026-08-02", 90), item("2026-09-01")), payload("BBB", item("2026-08-31")))
    monkeypatch.setattr(MarketTables, "overwrite_bars", fail_at_second)
    with pytest.raises(OSError):
        run(tables, frame, "one")
    assert written == [1] and tables.bars().count() == 7
    monkeypatch.setattr(MarketTables, "overwrite_bars", lambda self, rows: written.append(rows.count()) or real(self, rows))
    assert counts(run(tables, frame, "one", T1)) == {"AAA": ("succeeded", 3, 2, 1), "BBB": ("succeeded", 1, 1, 0)}
    assert written == [1, 7, 1] and tables.bars().count() == 9 and tables.stocks().count() == 2


def test_a_job_drops_each_copy_of_the_bars_when_the_next_is_whole(tables, landed, monkeypatch):
    merge, publish, staged = MarketTables.stage_merge, MarketTables.publish, {}
    folder = tables.path("staging/one").removeprefix("file:")

    def noted(step, real):
        def call(self, *args):
            staged[step] = {f.rsplit("/", 1)[1] for f in glob.glob(f"{folder}/*")}
            return real(self, *args)

        return call

    monkeypatch.setattr(MarketTables, "stage_merge", noted("merge", merge))
    monkeypatch.setattr(MarketTables, "publish", noted("publish", publish))
    run(tables, landed(payload("AAA", *august(3), item("2026-08-09", volume=-1)), "no json"), "one")
    assert staged["merge"] == {"quarantined", "seen", "failures", "batch", "identities"}
    assert staged["publish"] == {"quarantined", "merged_bars", "merged_stocks", "outcome"}
    assert {f.rsplit("/", 1)[1] for f in glob.glob(f"{folder}/*")} == {"quarantined"}
    assert {r.reasons[0] for r in quarantine(tables, "one").collect()} == {"malformed_json", "volume_shares_negative"}


def test_shuffles_go_with_the_query_that_wrote_its_result(spark, folder):
    [scratch] = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffles():
        return set(glob.glob(f"{scratch}/*/shuffle_*"))

    tables = MarketTables(spark, folder).create()
    rows = spark.range(100_000).selectExpr("id % 9973 as ticker", "id").groupBy("ticker").count()
    setting, before = spark.conf.get(SHUFFLE_CLEANUP), shuffles()
    rows.write.parquet(f"{folder}/kept")
    assert shuffles() - before
    before = shuffles()
    tables.stage(rows.select("*"), "one", "counts")
    deadline = time.time() + 10  # they are removed in the background
    while shuffles() - before and time.time() < deadline:
        time.sleep(0.1)
    assert not shuffles() - before and spark.conf.get(SHUFFLE_CLEANUP) == setting


def test_payloads_are_shuffled_once(spark, make_bars, make_stocks):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        made = history_payloads(make_bars(bar_row("AAA", "2026-08-20")), make_stocks(("AAA",)), F.year("trade_date"))
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # The bars and the names, each by ticker.
    assert plan.count("Exchange hashpartitioning(ticker") == plan.count("Exchange") == 2
