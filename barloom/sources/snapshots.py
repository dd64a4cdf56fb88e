"""Stored tables with atomic commits over bars, stocks, newest sessions and the run log.

Data folders are never changed once written. A commit writes new folders for the partitions it
touches, and then one manifest, which names the live folder of every partition of every table. The
manifest takes its place by one rename to the next version number, which fails if another writer was faster. So
a reader sees all of a commit or nothing of it, and a job that stops anywhere before the rename has changed
nothing.

Writers don't lock. A commit states the version it was planned on. If others have committed since,
it goes on top of theirs, unless they replaced a partition that it replaces too: then
:class:`CommitConflict` is raised and the job plans again on the newer version. Nothing is lost
either way.

The run log is append-only within a commit. Every `RUN_PARTS` appended parts, the runs that are
over are folded into a state table by day, of which only the touched days are rewritten.

Each commit also writes the least and greatest ticker of its bar files. Files are sorted by ticker, so
:meth:`SnapshotTables.bars_of` opens about one file per period for a symbol. This index is folded like the log.

The manifest holds one short entry for each partition: the calendar, the slots and `RUN_PARTS` bound it.
The file system must rename atomically (HDFS or a mounted POSIX folder); plain object stores don't.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.latest import newest_rows
from barloom.operators.quality import BAR_RULES, assess
from barloom.operators.ranges import in_range, period_of
from barloom.operators.runlog import current_state
from barloom.schema import BAR, BAR_KEY, RUN_EVENT, STORED_STOCK, stored_bar
from barloom.session import shuffles_dropped
from barloom.sources.tables import MarketTables

#: Sessions of each symbol that the newest-sessions table holds: those of a sparkline.
RECENT_DEPTH = 30
RECENT_COLUMNS = [*BAR_KEY, "open", "high", "low", "close", "previous", "volume_shares", "frequency"]
RECENT = T.StructType([*[BAR[name] for name in RECENT_COLUMNS], T.StructField("ticker_slot", T.IntegerType(), False)])
RUN_STATE = T.StructType([*RUN_EVENT.fields, T.StructField("run_day", T.IntegerType(), False)])
#: Which tickers a file of bars holds; `live` names its folder.
FILE_RANGE = T.StructType(
    [
        T.StructField("live", T.StringType(), False),
        T.StructField("period", T.IntegerType(), False),
        T.StructField("file", T.StringType(), False),
        T.StructField("least", T.StringType(), False),
        T.StructField("greatest", T.StringType(), False),
    ]
)
#: Appended parts of the run log, or of the index of files, before they are folded.
RUN_PARTS = 16
#: Times that a commit is put on top of others' before it gives up.
ATTEMPTS = 50


class CommitConflict(RuntimeError):
    """Another commit replaced a partition that this one replaces too."""


class Change(NamedTuple):
    """New rows for partitions of a table. Touched partitions without rows leave the table."""

    table: str
    folder: str
    written: list[str]
    touched: list[str]


def run_day(started_at: Column) -> Column:
    return F.date_format(started_at, "yyyyMMdd").cast("int")


@dataclass(frozen=True)
class SnapshotTables(MarketTables):
    """The bars, stocks, newest sessions and run log of one market, with versions.

    Reads without `version` see the newest commit at the time of the call; a pinned
    object (:meth:`at`) sees its version for ever, until :meth:`vacuum` takes it.
    """

    version: int | None = None
    #: A job is planned again after a crash: what it read may have changed since.
    replans = True

    # --- manifests ---------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = self._list(self.path("manifests"))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def newest(self) -> int:
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no tables under {self.root}: call create() first")
        return found[-1]

    def at(self, version: int | None) -> SnapshotTables:
        return replace(self, version=version)

    def pinned(self) -> SnapshotTables:
        return self if self.version is not None else self.at(self.newest())

    def manifest(self) -> dict:
        version = self.newest() if self.version is None else self.version
        stream = self._fs().open(self._path(self._manifest(version)))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self, version: int) -> str:
        return self.path(f"manifests/v{version:010}.json")

    def _put(self, manifest: dict) -> bool:
        """Put a manifest in place by one rename; False if its version is taken."""
        fs, own = self._fs(), self._path(self.path(f"manifests/.{uuid.uuid4().hex}"))
        target = self._path(self._manifest(manifest["version"]))
        out = fs.create(own, True)
        out.write(json.dumps(manifest, sort_keys=True).encode())
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                # A rename would replace the other's file here; a link is as atomic and doesn't.
                os.link(own.toUri().getPath(), target.toUri().getPath())
                return True
            jvm = self.spark._jvm
            none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf()).rename(own, target, none)
            return True
        except FileExistsError:
            return False
        except Exception as error:
            if "FileAlreadyExistsException" in str(error):
                return False
            raise
        finally:
            fs.delete(own, False)

    # --- reading -----------------------------------------------------------------------

    def create(self) -> SnapshotTables:
        """Version 0, with nothing in it, if there is no version yet."""
        if not self.versions():
            self._fs().mkdirs(self._path(self.path("manifests")))
            self._put({"version": 0, "job": None, "tables": {name: {} for name in ("bars", "files", "stocks", "recent", "runs", "run_states")}})
        return self

    def _live(self, name: str, schema: T.StructType, partition: str | None, keep=None) -> DataFrame:
        """The live partitions of a table; `keep` chooses among them before any folder is listed."""
        entries = self.manifest()["tables"][name].items()
        paths = [
            self.path(f"{name}/commit={folder}" + (f"/{partition}={key}" if partition else ""))
            for key, folder in sorted(entries)
            if keep is None or keep(int(key))
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
        return self.spark.read.schema(whole).option("basePath", self.path(name)).parquet(*paths).drop("commit")

    def bars(self, date_from: dt.date | str | None = None, date_to: dt.date | str | None = None) -> DataFrame:
        """Stored bars. Constant bounds choose the partitions in the manifest, so that others aren't even listed."""
        first, last = (self._period(d) for d in (date_from, date_to))
        keep = lambda p: (first is None or p >= first) and (last is None or p <= last)
        return in_range(self._live("bars", stored_bar(self.grain), self.period, keep), date_from, date_to)

    def _period(self, day: dt.date | str | None) -> int | None:
        if day is None:
            return None
        day = dt.date.fromisoformat(day) if isinstance(day, str) else day
        return {"year": day.year, "month": day.year * 100 + day.month, "day": day.year * 10000 + day.month * 100 + day.day}[self.grain]

    def bars_in(self, periods: list[int]) -> DataFrame:
        wanted = set(periods)
        return self._live("bars", stored_bar(self.grain), self.period, wanted.__contains__)

    def bars_of(self, ticker: str, date_from: dt.date | str | None = None, date_to: dt.date | str | None = None) -> DataFrame:
        """The bars of one symbol from the files that can hold it. Their number, about one per period, reaches the driver."""
        manifest, schema = self.pinned(), stored_bar(self.grain)
        first, last = (self._period(d) for d in (date_from, date_to))
        live = manifest.manifest()["tables"]["bars"]
        hits = manifest.files().where((F.col("least") <= ticker) & (F.col("greatest") >= ticker)).select("live", "period", "file")
        paths = [
            self.path(f"bars/commit={r.live}/{self.period}={r.period}/{r.file}")
            for r in hits.collect()
            if live.get(str(r.period)) == r.live and (first is None or r.period >= first) and (last is None or r.period <= last)
        ]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = T.StructType([*schema.fields, T.StructField("commit", T.StringType())])
        rows = self.spark.read.schema(whole).option("basePath", self.path("bars")).parquet(*sorted(paths)).drop("commit")
        return in_range(rows.where(F.col("ticker") == ticker), date_from, date_to)

    def files(self) -> DataFrame:
        """The index of bar files; it may still list files of folders that are no longer live."""
        return self._live("files", FILE_RANGE, None)

    def stocks(self) -> DataFrame:
        return self._live("stocks", STORED_STOCK, "ticker_slot")

    def stocks_in(self, slots: list[int]) -> DataFrame:
        return self._live("stocks", STORED_STOCK, "ticker_slot", set(slots).__contains__)

    def recent(self, slots: list[int] | None = None) -> DataFrame:
        """The newest sessions of every symbol, newest-first complete: `RECENT_DEPTH` or all it has."""
        return self._live("recent", RECENT, "ticker_slot", None if slots is None else set(slots).__contains__).drop("ticker_slot")

    def runs(self) -> DataFrame:
        """The last event of runs that were folded, and all events of the others."""
        states = self._live("run_states", RUN_STATE, "run_day").drop("run_day")
        return states.unionByName(self._live("runs", RUN_EVENT, None))

    def newest_runs(self) -> DataFrame:
        """Enough of the run log to tell the newest run: unfolded events and the newest folded day."""
        newest = max(map(int, self.manifest()["tables"]["run_states"]), default=0)
        states = self._live("run_states", RUN_STATE, "run_day", newest.__eq__).drop("run_day")
        return states.unionByName(self._live("runs", RUN_EVENT, None))

    # --- writing -----------------------------------------------------------------------

    def write(self, name: str, rows: DataFrame, partition: str | None, order: list[str], touched: list[int] | None = None) -> Change:
        """Write new folders for a table, not live before a commit names them.

        Without `touched`, the partitions that have rows are those that are replaced.
        """
        folder = uuid.uuid4().hex
        path = self.path(f"{name}/commit={folder}")
        with shuffles_dropped(rows.sparkSession):
            if partition is None:
                rows.hint("rebalance").write.parquet(path)
                return Change(name, folder, [folder], [])
            rows.hint("rebalance", partition).sortWithinPartitions(partition, *order).write.partitionBy(partition).parquet(path)
        written = [n.split("=")[1] for n in self._list(path) if n.startswith(f"{partition}=")]
        return Change(name, folder, written, written if touched is None else sorted({*written, *map(str, touched)}))

    def write_bars(self, rows: DataFrame, touched: list[int] | None = None) -> list[Change]:
        """Bars for a commit, and the index of their files. A bar that breaks a rule of the table stops the write."""
        judged = assess(rows, BAR_RULES)
        broken = F.concat(F.lit("a bar breaks a rule of the table: "), F.array_join("reasons", ","), F.lit(" "), F.col("ticker"))
        sound = judged.where(F.when(F.size("reasons") > 0, F.raise_error(broken).cast("boolean")).otherwise(True)).drop("reasons")
        placed = sound.withColumn(self.period, period_of(F.col("trade_date"), self.grain))
        bars = self.write("bars", placed.select(*stored_bar(self.grain).fieldNames()), self.period, BAR_KEY, touched)
        return [bars, *self._index(bars)]

    def _written(self, bars: Change) -> DataFrame:
        """The bars of a folder that may not be live yet."""
        return self.spark.read.schema(stored_bar(self.grain)).parquet(self.path(f"bars/commit={bars.folder}"))

    def _index(self, bars: Change) -> list[Change]:
        if not bars.written:
            return []
        # Hashed to one row for each file and ticker before texts are compared.
        held = self._written(bars).select(F.col(self.period).alias("period"), F.col("_metadata.file_name").alias("file"), "ticker").distinct()
        ranges = held.groupBy("period", "file").agg(
            F.min("ticker").alias("least"), F.max("ticker").alias("greatest")
        )
        return [self.write("files", ranges.select(F.lit(bars.folder).alias("live"), "period", "file", "least", "greatest"), None, [])]

    def write_stocks(self, rows: DataFrame, touched: list[int] | None = None) -> Change:
        placed = rows.withColumn("ticker_slot", self.slot_of(F.col("ticker")))
        return self.write("stocks", placed.select(*STORED_STOCK.fieldNames()), "ticker_slot", ["ticker"], touched)

    def write_recent(self, rows: DataFrame, touched: list[int] | None = None) -> Change:
        """The newest sessions among the rows given."""
        placed = newest_rows(rows.select(*RECENT_COLUMNS), RECENT_DEPTH).withColumn("ticker_slot", self.slot_of(F.col("ticker")))
        return self.write("recent", placed.select(*RECENT.fieldNames()), "ticker_slot", BAR_KEY, touched)

    def write_runs(self, events: DataFrame) -> Change:
        return self.write("runs", events.select(*RUN_EVENT.fieldNames()), None, [])

    def commit(self, base: int, changes: list[Change], job_id: str | None = None) -> int:
        """Make the changes live in one step, on top of what others have committed since `base`; the new version."""
        planned = self.at(base).manifest()["tables"]
        for _ in range(ATTEMPTS):
            manifest = self.at(self.newest()).manifest()
            live = manifest["tables"]
            for change in changes:
                lost = [k for k in change.touched if live[change.table].get(k) != planned[change.table].get(k)]
                if lost:
                    raise CommitConflict(f"{change.table} {', '.join(lost)} changed after version {base}")
            for change in changes:
                for key in change.touched:
                    live[change.table].pop(key, None)
                live[change.table].update(dict.fromkeys(change.written, change.folder))
            version = manifest["version"] + 1
            if self._put({"version": version, "job": job_id, "tables": live}):
                return version
        raise CommitConflict(f"no place among other commits in {ATTEMPTS} attempts")

    def append_runs(self, events: DataFrame) -> None:
        self.commit(self.newest(), [self.write_runs(events)])
        self._fold()

    def _fold(self) -> None:
        live = self.manifest()["tables"]
        if len(live["runs"]) >= RUN_PARTS:
            self.fold_runs()
        if len(live["files"]) >= RUN_PARTS:
            self.fold_files()

    def fold_files(self) -> None:
        """One index of the files of live folders."""
        base = self.pinned()
        live = base.manifest()["tables"]
        named = [F.struct(F.lit(int(p)).alias("period"), F.lit(folder).alias("live")) for p, folder in sorted(live["bars"].items())]
        rows = base.files()
        if named:
            rows = rows.where(F.struct(F.col("period"), F.col("live")).isin(named))
        change = self.write("files", rows.select(*FILE_RANGE.fieldNames()), None, [])._replace(touched=list(live["files"]))
        try:
            self.commit(base.version, [change])
        except CommitConflict:  # another writer folds at the same time
            return

    def fold_runs(self) -> None:
        """Fold the runs that are over into the states of their days; what is still running stays as events."""
        base = self.pinned()
        events = base._live("runs", RUN_EVENT, None)
        over = current_state(events).where(F.col("status") != "running").withColumn("run_day", run_day(F.col("started_at")))
        days = sorted(r.run_day for r in over.select("run_day").distinct().collect())
        known = base._live("run_states", RUN_STATE, "run_day", set(days).__contains__)
        merged = current_state(known.drop("run_day").unionByName(over.select(*RUN_EVENT.fieldNames())))
        states = merged.withColumn("run_day", run_day(F.col("started_at"))).select(*RUN_STATE.fieldNames())
        still = events.join(over.select("run_id"), "run_id", "left_anti").select(*RUN_EVENT.fieldNames())
        rest = self.write("runs", still, None, [])._replace(touched=list(base.manifest()["tables"]["runs"]))
        try:
            self.commit(base.version, [self.write("run_states", states, "run_day", ["run_id"], days), rest])
        except CommitConflict:  # another writer folds at the same time
            return

    # --- what a job needs --------------------------------------------------------------

    def merge_parts(self, job_id: str, periods: list[int]) -> list[list[int]]:
        """All periods of a batch are written at once, in the one folder that a commit names."""
        return [periods]

    def stage_merge(
        self,
        job_id: str,
        batch: DataFrame,
        parts: list[list[int]],
        merged: Callable[[DataFrame, DataFrame], DataFrame],
        stocks: DataFrame,
        slots: list[int],
    ) -> list[Change]:
        """The folders of a planned job. Called on a pinned object, which is what the plan has read."""
        [periods] = parts
        bars = merged(self.bars_in(periods), batch)
        # A held session that the batch restates beyond its own newest ones is not among the newest any more.
        fresh = self.stage(newest_rows(batch.select(*RECENT_COLUMNS), RECENT_DEPTH), job_id, "newest")
        held = self.recent(slots).join(fresh.select(*BAR_KEY), BAR_KEY, "left_anti")
        return [*self.write_bars(bars), self.write_stocks(stocks), self.write_recent(held.unionByName(fresh))]

    def drop_taken(self, job_id: str) -> None:
        """Nothing: a job that is planned again needs what it took."""

    def publish(self, job_id: str, planned: tuple[SnapshotTables, list[Change]], events: DataFrame, done: DataFrame) -> None:
        """All of a job in one commit: bars, stocks, newest sessions, closed runs and the closed job."""
        base, changes = planned
        self.commit(base.version, [*changes, self.write_runs(events.unionByName(done.select(*events.columns)))], job_id)
        self._fold()

    def load(self, bars: DataFrame, stocks: DataFrame, done: DataFrame) -> None:
        """The first load, in one commit."""
        base, held = self.newest(), self.write_bars(bars)
        recent = self._written(held[0]) if held[0].written else bars
        self.commit(base, [*held, self.write_stocks(stocks), self.write_recent(recent), self.write_runs(done)])

    def overwrite_bars(self, bars: DataFrame) -> None:
        raise NotImplementedError("bars, stocks and newest sessions change together: use commit()")

    def overwrite_stocks(self, stocks: DataFrame) -> None:
        raise NotImplementedError("bars, stocks and newest sessions change together: use commit()")

    def vacuum(self, keep: int = 10) -> int:
        """Remove manifests but the newest `keep`, and folders that none of those names; the number of folders.

        Run it while no job is writing: the folders of a job that hasn't committed yet are named by nobody.
        """
        fs, removed = self._fs(), 0
        kept = self.versions()[-keep:]
        live: dict[str, set[str]] = {}
        for version in kept:
            for name, entries in self.at(version).manifest()["tables"].items():
                live.setdefault(name, set()).update(entries.values())
        for version in self.versions():
            if version < kept[0]:
                fs.delete(self._path(self._manifest(version)), False)
        for name, folders in live.items():
            for found in self._list(self.path(name)):
                if found.startswith("commit=") and found[len("commit=") :] not in folders:
                    removed += fs.delete(self._path(self.path(f"{name}/{found}")), True)
        return removed
