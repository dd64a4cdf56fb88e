"""Tables with versions: commits, conflicts, deletes, newest sessions, lookups, a bounded log."""

from __future__ import annotations

import datetime as dt
import glob
import json
from decimal import Decimal

import pytest
from conftest import bar_row
from pyspark.sql import functions as F

from barloom.operators.latest import newest_rows
from barloom.operators.runlog import CLOSED, OPENED, close_runs, current_state, latest_run, open_runs
from barloom.plans import maintain
from barloom.plans.ingest import ingest, seed
from barloom.plans.watchlist import watchlist
from barloom.sources import snapshots
from barloom.sources.payloads import read_history
from barloom.sources.snapshots import RECENT_COLUMNS, CommitConflict, SnapshotTables

T0 = dt.datetime(2026, 8, 21, 18, tzinfo=dt.UTC)
T1 = dt.datetime(2026, 8, 22, 18, tzinfo=dt.UTC)


def item(day, close=100):
    return {"date": day, "open": close, "high": close + 2, "low": close - 2, "close": close,
            "previous": close, "volume": 3000, "value": 300000, "frequency": 10}


@pytest.fixture
def feed(spark):
    def make(**symbols):
        rows = [(f"p{c}", json.dumps({"code": c, "name": f"{c} Tbk", "unit": "shares", "items": i})) for c, i in symbols.items()]
        frame = spark.createDataFrame(rows, "payload_id string, payload string")
        return read_history(frame.withColumn("arrived_at", F.lit(None).cast("timestamp")), "feed")

    return make


@pytest.fixture
def tables(spark, folder, make_bars, make_stocks):
    """AAA trades daily for 50 days, BBB on 8 days, CCC in May only."""
    made = SnapshotTables(spark, folder, grain="month").create()
    day = dt.date(2026, 8, 20)
    bars = make_bars(
        *[bar_row("AAA", day - dt.timedelta(days=i), price=100 + i) for i in range(50)],
        *[bar_row("BBB", day - dt.timedelta(days=7 * i)) for i in range(8)],
        *[bar_row("CCC", dt.date(2026, 5, 1 + i)) for i in range(5)],
    )
    seed(made, bars, make_stocks(("AAA",), ("BBB",), ("CCC",)), provider="feed", job_id="seed", at=T0)
    return made


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*(columns or frame.columns)).collect())


def agrees(tables):
    """The newest sessions are those of the bars."""
    expected = newest_rows(tables.bars().select(*RECENT_COLUMNS), snapshots.RECENT_DEPTH)
    assert rows(tables.recent(), *RECENT_COLUMNS) == rows(expected)
    assert rows(maintain.maintained_watchlist(tables).drop("sparkline")) == rows(watchlist(tables.bars(), tables.stocks()).drop("sparkline"))


@pytest.mark.parametrize("step", ["write_bars", "write_stocks", "write_recent", "commit"])
def test_a_job_that_stops_anywhere_changes_nothing_and_runs_again(tables, feed, monkeypatch, step):
    before = tables.pinned()
    held = rows(before.bars(), "ticker", "trade_date", "close")
    late = feed(AAA=[item("2026-08-20", 90), item("2026-08-21")], DDD=[item("2026-08-21")])
    real = getattr(SnapshotTables, step)

    def then_stop(self, *args, **kwargs):
        if step == "commit" and len(args) < 3:  # the opening events
            return real(self, *args, **kwargs)
        real(self, *args, **kwargs) if step != "commit" else None
        raise OSError("driver lost")

    monkeypatch.setattr(SnapshotTables, step, then_stop)
    with pytest.raises(OSError):
        ingest(tables, late, provider="feed", job_id="late", at=T1)
    assert rows(tables.bars(), "ticker", "trade_date", "close") == held and tables.stocks().count() == 3
    monkeypatch.setattr(SnapshotTables, step, real)
    runs = {r.ticker: (r.status, r.rows_inserted, r.rows_updated) for r in ingest(tables, late, provider="feed", job_id="late", at=T1).collect()}
    assert runs == {"AAA": ("succeeded", 1, 1), "DDD": ("succeeded", 1, 0)}
    assert tables.bars().count() == len(held) + 2 and tables.stocks().count() == 4
    assert rows(before.bars(), "ticker", "trade_date", "close") == held  # a pinned reader still sees its version
    agrees(tables)


def test_two_writers_of_one_partition_lose_nothing(tables, feed, monkeypatch):
    first, second = feed(AAA=[item("2026-08-21", 70)]), feed(BBB=[item("2026-08-21", 60)])
    real, conflicts = SnapshotTables.publish, []

    def overtaken(self, job_id, *rest):
        monkeypatch.setattr(SnapshotTables, "publish", real)
        ingest(tables, second, provider="feed", job_id="second", at=T1)
        try:
            real(self, job_id, *rest)
        except CommitConflict as error:
            conflicts.append(error)
            raise

    monkeypatch.setattr(SnapshotTables, "publish", overtaken)
    ingest(tables, first, provider="feed", job_id="first", at=T1)
    assert len(conflicts) == 1
    new = tables.bars("2026-08-21")
    assert rows(new.select("ticker", F.col("close").cast("int"))) == [("AAA", 70), ("BBB", 60)]
    assert {r.status for r in current_state(tables.runs()).collect()} == {"succeeded"}
    agrees(tables)


def test_writers_of_different_partitions_follow_each_other(tables):
    base = tables.newest()
    july, may = (tables.write_bars(tables.bars_in([p]).drop("trade_month")) for p in (202607, 202605))
    assert [tables.commit(base, july), tables.commit(base, may)] == [base + 1, base + 2]
    with pytest.raises(CommitConflict):
        tables.commit(base, may)
    assert tables.bars().count() == 63


def test_a_version_is_taken_once(tables):
    manifest = {**tables.manifest(), "version": tables.newest() + 1}
    assert tables._put(manifest) and not tables._put(manifest)


def test_the_store_refuses_bars_that_break_a_rule(tables, make_bars):
    bad = make_bars(bar_row("AAA", "2026-08-21", high=Decimal(1))).withColumns({c: F.lit(T0) for c in ("ingested_at", "created_at", "updated_at")})
    with pytest.raises(Exception, match="breaks a rule"):
        tables.write_bars(bad)


def test_deleted_stocks_take_their_bars_along(spark, tables):
    before = tables.manifest()["tables"]["bars"]
    version = maintain.delete_stocks(tables, spark.createDataFrame([("CCC",), ("ZZZ",)], "ticker string"), job_id="gone")
    after = tables.manifest()["tables"]["bars"]
    assert "202605" in before and "202605" not in after  # it became empty
    assert {p: f for p, f in before.items() if p != "202605"} == after  # the others keep their files
    assert rows(tables.stocks(), "ticker") == [("AAA",), ("BBB",)] and tables.bars().count() == 58
    assert maintain.delete_stocks(tables, spark.createDataFrame([("ZZZ",)], "ticker string"), job_id="none") == version
    agrees(tables)


def test_deleted_bars_are_replaced_among_the_newest(spark, tables):
    keys = [("AAA", dt.date(2026, 8, 20)), ("AAA", dt.date(2026, 8, 1)), ("BBB", dt.date(2026, 7, 2)), ("AAA", dt.date(2020, 1, 1))]
    maintain.delete_bars(tables, spark.createDataFrame(keys, "ticker string, trade_date date"), job_id="wrong")
    assert tables.bars().count() == 60
    agrees(tables)


def test_newest_sessions_are_read_without_bars(tables):
    plan = maintain.maintained_watchlist(tables)._jdf.queryExecution().executedPlan().toString()
    assert "/recent/" in plan and "/bars/" not in plan


def test_a_symbol_is_looked_up_in_the_files_that_can_hold_it(spark, folder, make_bars, make_stocks):
    made = SnapshotTables(spark, folder, grain="month").create()
    bars = make_bars(*[bar_row(f"S{i:03}", dt.date(2026, m, 3)) for i in range(200) for m in (6, 7, 8)])
    seed(made, bars, make_stocks(*[(f"S{i:03}",) for i in range(200)]), provider="feed", job_id="seed", at=T0)
    # Two files for each period, as a large period has.
    split = made.bars().drop("trade_month").repartitionByRange(2, "ticker")
    placed = split.withColumn("trade_month", (F.year("trade_date") * 100 + F.month("trade_date")).cast("int"))
    change = snapshots.Change("bars", "two", ["202606", "202607", "202608"], ["202606", "202607", "202608"])
    placed.write.partitionBy("trade_month").parquet(made.path("bars/commit=two"))
    made.commit(made.newest(), [change, *made._index(change)])
    found = made.bars_of("S020", "2026-07-01")
    assert rows(found, "ticker", "trade_date") == [("S020", dt.date(2026, 7, 3)), ("S020", dt.date(2026, 8, 3))]
    assert len(found.inputFiles()) == 2 and len(made.bars().inputFiles()) == 6
    assert made.bars_of("NONE").count() == 0


def test_the_run_log_stays_small(spark, folder):
    made = SnapshotTables(spark, folder).create()
    tickers = spark.createDataFrame([("AAA",), ("BBB",)], "ticker string")
    for job in range(24):
        at = T0 + dt.timedelta(days=job // 8, minutes=job)
        opened = open_runs(tickers, f"job{job}", "feed", at)
        outcome = tickers.selectExpr("ticker", "1L as rows_received", "1L as rows_inserted", "0L as rows_updated", "string(null) as error", "false as failed")
        made.append_runs(opened if job == 23 else opened.unionByName(close_runs(opened, outcome, at)))
    live = made.manifest()["tables"]
    assert len(live["runs"]) < snapshots.RUN_PARTS and len(live["run_states"]) <= 3
    state = current_state(made.runs())
    assert state.count() == 48 and state.where("status = 'running'").count() == 2
    assert latest_run(made.newest_runs()).collect() == latest_run(made.runs()).collect()
    # A folded run can be closed again.
    again = made.runs().where("job_id = 'job1' and ticker = 'AAA'").withColumn("event_seq", F.lit(CLOSED + 1)).withColumn("status", F.lit("failed"))
    made.append_runs(again)
    made.fold_runs()
    assert current_state(made.runs()).where("status = 'failed'").count() == 1
    assert made.runs().where(F.col("event_seq") == OPENED).count() == 2
    folders = len(glob.glob(made.path("runs").removeprefix("file:") + "/commit=*"))
    assert made.vacuum(keep=1) > 0 and current_state(made.runs()).count() == 48
    assert len(glob.glob(made.path("runs").removeprefix("file:") + "/commit=*")) < folders


def test_a_job_that_is_run_again_does_not_read_its_feed_again(tables, feed, monkeypatch):
    late = feed(AAA=[item("2026-08-20", 90), item("2026-08-21")], DDD=[item("2026-08-21")])
    real, staged = SnapshotTables.publish, []

    def stops(self, *args):
        raise OSError("driver lost")

    monkeypatch.setattr(SnapshotTables, "publish", stops)
    with pytest.raises(OSError):
        ingest(tables, late, provider="feed", job_id="late", at=T1)
    monkeypatch.setattr(SnapshotTables, "publish", real)
    write = SnapshotTables.stage
    monkeypatch.setattr(SnapshotTables, "stage", lambda self, rows, job, name: staged.append(name) or write(self, rows, job, name))
    runs = {r.ticker: (r.status, r.rows_inserted, r.rows_updated) for r in ingest(tables, late, provider="feed", job_id="late", at=T1).collect()}
    assert runs == {"AAA": ("succeeded", 1, 1), "DDD": ("succeeded", 1, 0)}
    assert not {"parsed", "repeated", "batch", "identities"} & set(staged) and "outcome" in staged
    agrees(tables)


def test_newest_sessions_after_a_long_restatement(tables, feed):
    """The batch restates more sessions of a symbol than are kept, and an old one of another."""
    days = [dt.date(2026, 5, 1) + dt.timedelta(days=i) for i in range(60)]
    late = feed(AAA=[item(str(day), 50) for day in days], BBB=[item("2026-05-04", 70)])
    ingest(tables, late, provider="feed", job_id="late", at=T1)
    agrees(tables)
