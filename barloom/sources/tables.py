"""Stored tables: plain parquet under one root, read with fixed schemas.

Bars are partitioned by year, month or day and sorted by (ticker, trade date)
inside each file, so a date range prunes partitions and a ticker prunes row
groups. A merge rewrites only the periods its batch touches; the finer the
grain, the less a daily batch rewrites. Stocks are partitioned by a hash slot
of the ticker for the same reason.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.ranges import in_range, period_of
from barloom.schema import (
    BAR_COLUMNS,
    PERIOD_COLUMNS,
    RUN_EVENT,
    STORED_STOCK,
    stored_bar,
)
from barloom.session import shuffles_dropped

#: Bytes of a batch whose periods are merged at once; of a larger one, some periods after the others.
MERGED_AT_ONCE = 128 << 20


@dataclass(frozen=True)
class MarketTables:
    """The bars, stocks and run log of one market, stored under ``root``."""

    spark: SparkSession
    root: str
    grain: str = "month"
    #: Partitions of the stocks. Fixed for a table once it holds rows.
    stock_slots: int = 16

    def slot_of(self, ticker: Column) -> Column:
        return F.pmod(F.xxhash64(ticker), F.lit(self.stock_slots)).cast("int")

    @property
    def period(self) -> str:
        """The partition column of the bars."""
        return PERIOD_COLUMNS[self.grain]

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf())

    def _list(self, path: str) -> list[str]:
        """Names of files and folders in a folder; none if it isn't there."""
        fs, folder = self._fs(), self._path(path)
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def create(self) -> MarketTables:
        """Create the empty tables that do not exist yet."""
        for name, schema, partition in (
            ("bars", stored_bar(self.grain), self.period),
            ("stocks", STORED_STOCK, "ticker_slot"),
            ("runs", RUN_EVENT, None),
        ):
            empty = self.spark.createDataFrame([], schema).write.mode("ignore")
            (empty.partitionBy(partition) if partition else empty).parquet(self.path(name))
        return self

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def bars(
        self,
        date_from: dt.date | str | None = None,
        date_to: dt.date | str | None = None,
    ) -> DataFrame:
        """Stored bars; the bounds prune partitions and reach the parquet scan."""
        return in_range(self._read("bars", stored_bar(self.grain)), date_from, date_to)

    def bars_in(self, periods: list[int]) -> DataFrame:
        return self.bars().where(F.col(self.period).isin(periods))

    def stocks(self) -> DataFrame:
        return self._read("stocks", STORED_STOCK)

    def runs(self) -> DataFrame:
        return self._read("runs", RUN_EVENT)

    def touched_periods(self, batch: DataFrame) -> list[int]:
        """The distinct periods of a batch. The calendar bounds their number."""
        rows = batch.select(period_of(F.col("trade_date"), self.grain).alias("p")).distinct()
        return sorted(row.p for row in rows.collect())

    def overwrite_bars(self, bars: DataFrame) -> None:
        """Replace exactly the periods that ``bars`` covers.

        The rebalance spreads a period over as many files as its size needs and
        joins small ones.
        """
        self._overwrite(
            bars.withColumn(self.period, period_of(F.col("trade_date"), self.grain)).select(
                *stored_bar(self.grain).fieldNames()
            ),
            "bars",
            self.period,
            ["ticker", "trade_date"],
        )

    def overwrite_stocks(self, stocks: DataFrame) -> None:
        """Replace exactly the ticker slots that ``stocks`` covers."""
        self._overwrite(
            stocks.withColumn("ticker_slot", self.slot_of(F.col("ticker"))).select(
                *STORED_STOCK.fieldNames()
            ),
            "stocks",
            "ticker_slot",
            ["ticker"],
        )

    def _overwrite(
        self, rows: DataFrame, name: str, partition: str, order: list[str]
    ) -> None:
        with shuffles_dropped(rows.sparkSession):
            (
                rows.hint("rebalance", partition)
                .sortWithinPartitions(partition, *order)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(partition)
                .parquet(self.path(name))
            )

    def append_runs(self, events: DataFrame) -> None:
        events.select(*RUN_EVENT.fieldNames()).write.mode("append").parquet(self.path("runs"))

    def stage(self, rows: DataFrame, job_id: str, name: str, partition: str | None = None) -> DataFrame:
        """Write an intermediate result once and read it back.

        It cuts the plan, outlives lost executors, and a rerun of the job
        overwrites it.
        """
        path = self.path(f"staging/{job_id}/{name}")
        out = rows.write.mode("overwrite").option("compression", "zstd")
        with shuffles_dropped(rows.sparkSession):
            (out.partitionBy(partition) if partition else out).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def overwrite_staged(self, job_id: str) -> None:
        """Write the merged periods and slots of a job from their staged copies, however often.

        A part of the periods goes once it is in the table: a job that is run again writes those that are left.
        """
        schema = T.StructType([f for f in stored_bar(self.grain) if f.name != self.period])
        for part in sorted(self._list(self.path(f"staging/{job_id}/merged_bars"))):
            name = f"merged_bars/{part}"
            if self.has_staged(job_id, name):
                self.overwrite_bars(self.staged(job_id, name, schema))
                self.drop(job_id, [name])
        stocks = self.staged(job_id, "merged_stocks", T.StructType([f for f in STORED_STOCK if f.name != "ticker_slot"]))
        if not stocks.isEmpty():
            self.overwrite_stocks(stocks)

    #: Whether a job that is run again after a crash plans anew instead of writing what it had staged.
    replans = False

    def pinned(self) -> MarketTables:
        """What a plan reads. Plain tables have no versions."""
        return self

    def stocks_in(self, slots: list[int]) -> DataFrame:
        return self.stocks().where(F.col("ticker_slot").isin(slots))

    def merge_parts(self, job_id: str, periods: list[int]) -> list[list[int]]:
        """The periods of a batch in those that are merged at once, by the size of what the job has parsed."""
        size = self._fs().getContentSummary(self._path(self.path(f"staging/{job_id}/parsed"))).getLength()
        n = min(len(periods), max(1, -(-size // MERGED_AT_ONCE)))
        return [periods[i * len(periods) // n : (i + 1) * len(periods) // n] for i in range(n)]

    def stage_merge(
        self,
        job_id: str,
        batch: DataFrame,
        parts: list[list[int]],
        merged: Callable[[DataFrame, DataFrame], DataFrame],
        stocks: DataFrame,
        slots: list[int],
    ) -> None:
        """Stage the merged rows of a job before anything is replaced, one part of the periods after the other."""
        self.drop(job_id, ["merged_bars"])
        for n, periods in enumerate(parts):
            self.stage(merged(self.bars_in(periods), batch.where(F.col("merge_part") == n)), job_id, f"merged_bars/{n:04}")
        self.stage(stocks, job_id, "merged_stocks")

    def drop_taken(self, job_id: str) -> None:
        """Remove what a planned job took from its feed: from here on it needs the merged rows only."""
        self.drop(job_id, ["batch", "identities", "seen", "failures"])

    def publish(self, job_id: str, planned: object, events: DataFrame, done: DataFrame) -> None:
        """Replace bars, then stocks, then log the runs and, as the marker, the job."""
        self.overwrite_staged(job_id)
        self.append_runs(events)
        self.append_runs(done)

    def load(self, bars: DataFrame, stocks: DataFrame, done: DataFrame) -> None:
        """The first load of empty tables."""
        self.overwrite_bars(bars)
        self.overwrite_stocks(stocks)
        self.append_runs(done)

    def drop_staged(self, job_id: str) -> None:
        """Remove what a closed job no longer needs; the rows it did not accept stay for :func:`quarantine`."""
        self.drop(
            job_id,
            ["parsed", "pulled", "repeated", "batch", "identities", "seen", "failures", "newest", "gone", "merged_bars", "merged_stocks", "outcome"],
        )

    def drop(self, job_id: str, names: list[str]) -> None:
        """Remove intermediate results, the mark that one is whole before the rest of it."""
        for name in names:
            path = self.path(f"staging/{job_id}/{name}")
            self._fs().delete(self._path(f"{path}/_SUCCESS"), False)
            self._fs().delete(self._path(path), True)

    def has_staged(self, job_id: str, name: str) -> bool:
        """Whether an intermediate result was written to its end."""
        return self._fs().exists(self._path(self.path(f"staging/{job_id}/{name}/_SUCCESS")))

    def staged(self, job_id: str, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(f"staging/{job_id}/{name}"))


def publish_bucketed(bars: DataFrame, table: str, path: str, buckets: int) -> None:
    """Write a copy of the bars bucketed by ticker, for reads over whole histories.

    Every per-ticker window, aggregate or join on the copy then runs without a
    shuffle. Choose ``buckets`` so that one holds a few hundred megabytes.
    """
    (
        bars.select(*BAR_COLUMNS)
        .repartition(buckets, "ticker")
        .sortWithinPartitions("ticker", "trade_date")
        .write.mode("overwrite")
        .bucketBy(buckets, "ticker")
        .sortBy("ticker", "trade_date")
        .option("path", path)
        .saveAsTable(table)
    )
