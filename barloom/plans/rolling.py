"""Rolling normalised forms of the indicator: z-score and percentile over a moving frame of sessions.

A frame is the last `window` sessions of a symbol, the current one included. The raw series is kept
beside its normalised form. Sessions without a raw value have neither and count for nothing, but take a place
in the frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.functions.frequency import frequency_raw
from barloom.session import with_package

#: Sessions of a frame, and values it needs for a result.
WINDOW, LEAST = 120, 20
#: Least number of parts into which symbols are dealt for sorts of whole series.
PARTS = 256


def raw_series(bars: DataFrame, unit: str = "shares") -> DataFrame:
    """`raw` of every bar, NULL where no trade took place."""
    return bars.select("ticker", "trade_date", frequency_raw(F.col("volume_shares"), F.col("frequency"), unit).alias("raw"))


def rolling_zscore(series: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """`mean`, `deviation` (population) and `zscore` of `raw` in its frame.

    A symbol's sessions are cut into blocks of `window`. A frame is the end of one
    block and the start of the next, so it takes moments that run forward within blocks,
    those that run backward, and one step that joins the two (Chan's formula): constant
    work per row whatever the window, and no difference of large sums, so
    a frame of small values is exact after a large one has left it. All in one shuffle by symbol, into a
    fixed number of parts: the adaptive planner would merge them by the size of the narrow input, and
    the sorts of a task hold several times that.

    A frame of fewer than `least` values has NULLs; one of equal values has
    deviation 0 and a NULL z-score.
    """
    if window < 2 or least < 1:
        raise ValueError("a frame of two sessions and one value at least")
    in_order = W.partitionBy("ticker").orderBy("trade_date")
    place = F.row_number().over(in_order) - 1
    value = F.col("raw")

    def moments(frame) -> Column:
        n = F.count(value).over(frame)
        return F.struct(
            n.cast("double").alias("n"),
            F.avg(value).over(frame).alias("mean"),
            (F.var_pop(value).over(frame) * n).alias("m2"),
            F.min(value).over(frame).alias("low"),
            F.max(value).over(frame).alias("high"),
        )

    # Backward first: forward and the step between blocks then share one sort.
    block = W.partitionBy("ticker", "block").rowsBetween(W.unboundedPreceding, W.currentRow)
    by_block = W.partitionBy("ticker").orderBy("block", "trade_date")
    parts = max(PARTS, int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = series.repartition(parts, "ticker").select("ticker", "trade_date", "raw", F.floor(place / window).alias("block"), (place % window).alias("at"))
    backward = cut.withColumn("backward", moments(block.orderBy(F.desc("trade_date"))))
    both = backward.withColumn("forward", moments(block.orderBy("trade_date"))).withColumn(
        "rest", F.when(F.col("at") < window - 1, F.lag("backward", window - 1).over(by_block))
    )

    def part(name: str, field: str) -> Column:
        return F.coalesce(F.col(name)[field], F.lit(0.0))

    n1, n2 = part("rest", "n"), part("forward", "n")
    n = n1 + n2
    apart = part("forward", "mean") - part("rest", "mean")
    joined = F.when(n > 0, n1 * n2 / n * apart * apart).otherwise(0.0)
    mean = F.when(n1 == 0, F.col("forward.mean")).when(n2 == 0, F.col("rest.mean")).otherwise(part("rest", "mean") + apart * (n2 / n))
    equal = F.least("rest.low", "forward.low") == F.greatest("rest.high", "forward.high")
    enough = n >= least
    found = both.select(
        "ticker",
        "trade_date",
        "raw",
        F.when(enough, F.when(equal, F.least("rest.low", "forward.low")).otherwise(mean)).alias("mean"),
        F.when(enough, F.when(equal, F.lit(0.0)).otherwise(F.sqrt((part("rest", "m2") + part("forward", "m2") + joined) / n))).alias("deviation"),
    )
    return found.withColumn("zscore", F.when(F.col("deviation") > 0, (value - F.col("mean")) / F.col("deviation")))


class Ranks:
    """How many values of a moving frame are at most x: a Fenwick tree over the ranks of a symbol's values."""

    def __init__(self, size: int):
        self.size, self.tree = size, [0] * (size + 1)

    def add(self, rank: int, change: int) -> None:
        while rank <= self.size:
            self.tree[rank] += change
            rank += rank & -rank

    def at_most(self, rank: int) -> int:
        total = 0
        while rank:
            total += self.tree[rank]
            rank &= rank - 1
        return total


def percentiles(values: np.ndarray, window: int, least: int) -> np.ndarray:
    """The percentile of each value in its frame, NaN where there is none.

    The values are sorted once; then each step adds one rank to the tree, takes one out and asks once.
    """
    known = ~np.isnan(values)
    distinct, at = np.unique(values[known], return_inverse=True)
    ranks = np.zeros(len(values), np.int64)
    ranks[known] = at + 1
    tree, inside, out = Ranks(len(distinct)), 0, np.full(len(values), np.nan)
    steps = ranks.tolist()
    for i, rank in enumerate(steps):
        if i >= window and steps[i - window]:
            tree.add(steps[i - window], -1)
            inside -= 1
        if rank:
            tree.add(rank, 1)
            inside += 1
            if inside >= least:
                out[i] = 100.0 * tree.at_most(rank) / inside
    return out


def rolling_percentile(series: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """`percentile`: 100 times the share of the frame's values that are at most the current one.

    Spark has no moving rank, so sorted symbols pass through a task one by one. Work per row is
    bounded by the logarithm of a symbol's length, and so is that of the window. A symbol has
    at most one bar a day, which bounds what a task holds. NULL where the session has no raw value or
    its frame fewer than `least`.
    """
    if window < 1 or least < 1:
        raise ValueError("a frame of one session and one value at least")
    spark = with_package(series.sparkSession)

    def finished(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(parts).combine_chunks()
        values = whole.column("raw").to_numpy().astype(float)
        found = percentiles(values, window, least)
        columns = [whole.column(name).combine_chunks() for name in ("ticker", "trade_date", "raw")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found, mask=np.isnan(found))], names=["ticker", "trade_date", "raw", "percentile"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tickers = batch.column(0).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(tickers[1:] != tickers[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and held[-1].column(0)[0] != batch.column(0)[a]:
                    yield finished(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield finished(held)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_symbol = series.select("ticker", "trade_date", "raw").repartition(parts, "ticker").sortWithinPartitions("ticker", "trade_date")
    return by_symbol.mapInArrow(run, "ticker string, trade_date date, raw double, percentile double")
