"""Changes of stored tables beside ingest: deletes, and reads of the maintained newest sessions.

All work on :class:`barloom.sources.snapshots.SnapshotTables`. A delete rewrites only the
partitions that hold a deleted row, those that become empty leave the table, and bars, stocks and newest
sessions change in one commit. If another job replaced one of them meanwhile, it is planned again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.latest import latest_row
from barloom.operators.upsert import without_stocks
from barloom.plans.watchlist import newest_of_stored, watchlist
from barloom.schema import BAR_KEY
from barloom.sources.snapshots import RECENT_DEPTH, Change, CommitConflict, SnapshotTables


def _committed(tables: SnapshotTables, job_id: str, plan: Callable[[SnapshotTables], list[Change]]) -> int:
    while True:
        base = tables.pinned()
        try:
            changes = plan(base)
            return base.commit(base.version, changes, job_id) if changes else base.version
        except CommitConflict:
            continue


def _distinct(rows: DataFrame, name: str) -> list[int]:
    """Periods or slots, whose number the calendar or the slot count bounds."""
    return sorted(r[0] for r in rows.select(name).distinct().collect())


def delete_stocks(tables: SnapshotTables, doomed: DataFrame, *, job_id: str) -> int:
    """Delete the given stocks (`ticker`) and all their bars; the version after it.

    Only periods with a bar of theirs are rewritten, the others keep their files. Unknown tickers
    are ignored; if none is known, there is no commit.
    """
    # Written once: its size is known then, so that few stocks needn't shuffle the bars.
    gone = tables.stage(doomed.select("ticker").distinct(), job_id, "gone")

    def plan(base: SnapshotTables) -> list[Change]:
        periods = _distinct(base.bars().join(gone, "ticker", "left_semi"), base.period)
        slots = _distinct(base.stocks().join(gone, "ticker", "left_semi"), "ticker_slot")
        changes = []
        if slots:
            changes.append(base.write_stocks(without_stocks(base.stocks_in(slots), gone), slots))
        held = _distinct(base.recent().join(gone, "ticker", "left_semi").withColumn("slot", base.slot_of(F.col("ticker"))), "slot")
        if held:
            changes.append(base.write_recent(without_stocks(base.recent(held), gone), held))
        if periods:
            changes += base.write_bars(without_stocks(base.bars_in(periods), gone).drop(base.period), periods)
        return changes

    version = _committed(tables, job_id, plan)
    tables.drop_staged(job_id)
    return version


def delete_bars(tables: SnapshotTables, keys: DataFrame, *, job_id: str) -> int:
    """Delete single bars, given by (ticker, trade_date); the version after it.

    The newest sessions of the symbols that lose one are looked up again, newest partitions first.
    """
    gone = keys.select(*BAR_KEY).distinct()

    def plan(base: SnapshotTables) -> list[Change]:
        lost = base.bars().join(gone, BAR_KEY, "left_semi")
        periods = _distinct(lost, base.period)
        if not periods:
            return []
        kept = base.bars_in(periods).join(gone, BAR_KEY, "left_anti")
        touched = base.recent().join(gone, BAR_KEY, "left_semi").select("ticker").distinct()
        touched = base.stage(touched, job_id, "touched")
        slots = _distinct(touched.withColumn("slot", base.slot_of(F.col("ticker"))), "slot")
        changes = base.write_bars(kept.drop(base.period), periods)
        if slots:
            left = base.bars().join(gone, BAR_KEY, "left_anti").select(*base.bars().columns)
            fresh = newest_of_stored(left, touched, RECENT_DEPTH).join(touched, "ticker", "left_semi")
            held = base.recent(slots)
            others = held.join(touched, "ticker", "left_anti").select(*held.columns)
            changes.append(base.write_recent(others.unionByName(fresh.select(*held.columns)), slots))
        return changes

    return _committed(tables, job_id, plan)


def maintained_watchlist(tables: SnapshotTables) -> DataFrame:
    """The watchlist from the newest sessions alone: no bar is read."""
    base = tables.pinned()
    return watchlist(base.recent(), base.stocks())


def maintained_latest_dates(tables: SnapshotTables) -> DataFrame:
    """The newest trade date of every symbol, from the newest sessions alone."""
    return latest_row(tables.recent(), ["trade_date"]).withColumnRenamed("trade_date", "latest_trade_date")
