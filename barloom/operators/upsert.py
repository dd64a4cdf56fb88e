"""Idempotent merge of a batch into a stored table, as pure DataFrame plans.

Nothing here writes. Keys are unique on both sides of every merge join, so no
key can skew it; a batch that repeats a key is reduced first, by an aggregate
with a partial step.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.schema import BAR_COLUMNS, BAR_KEY, FACTS, STOCK_COLUMNS


def as_instant(value: Column | dt.datetime) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def last_wins(rows: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """One row per key, the one that arrived last, plus ``copies`` seen of the key."""
    payload = [name for name in rows.columns if name not in key and name not in arrival]
    # Arrival first, then the row itself: equal arrivals still give one answer.
    last = F.max(F.struct(*arrival, F.struct(*payload).alias("row")))
    return (
        rows.groupBy(*key)
        .agg(last.alias("last"), F.count("*").alias("copies"))
        .select(*key, "last.row.*", "copies")
    )


def overlay(base: DataFrame, patch: DataFrame, key: list[str]) -> DataFrame:
    """Union by key in which ``patch`` replaces the rows of ``base`` it names."""
    kept = base.join(patch.select(*key), key, "left_anti")
    return kept.unionByName(patch)


def existing_keys(batch: DataFrame, stored: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Distinct batch keys that the table already holds."""
    key = key or BAR_KEY
    return batch.select(*key).distinct().join(stored.select(*key), key, "left_semi")


def new_keys(batch: DataFrame, stored: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Distinct batch keys that the table does not hold yet."""
    key = key or BAR_KEY
    return batch.select(*key).distinct().join(stored.select(*key), key, "left_anti")


def merge_counts(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows received, inserted and updated per ticker.

    Inserted counts distinct new dates; every other row is an update, also one
    that repeats the stored values. ``batch`` comes from :func:`last_wins`.
    """
    # The table is reduced to the batch first, so a small batch can be broadcast to it. Only counts are joined then.
    held = stored.select(*BAR_KEY).join(batch.select(*BAR_KEY), BAR_KEY, "left_semi")
    held = held.groupBy("ticker").agg(F.count("*").alias("held"))
    seen = batch.groupBy("ticker").agg(F.sum("copies").alias("rows_received"), F.count("*").alias("dates"))
    inserted = F.col("dates") - F.coalesce("held", F.lit(0))
    return seen.join(held, "ticker", "left").select(
        "ticker", "rows_received", inserted.alias("rows_inserted"), (F.col("rows_received") - inserted).alias("rows_updated")
    )


def merge_bars(
    stored: DataFrame,
    batch: DataFrame,
    now: Column | dt.datetime,
    coalesce_nulls: bool = False,
) -> DataFrame:
    """Stored bars with the batch merged in by (ticker, trade date).

    A batch row replaces every fact of the stored row, also with NULL, unless
    ``coalesce_nulls`` asks to keep stored optional values. First-insert
    instants stay; ``updated_at`` moves.
    """
    now = as_instant(now)
    old = stored.select(*BAR_COLUMNS, "ingested_at", "created_at", "updated_at").alias("old")
    new = batch.select(*BAR_COLUMNS, F.lit(True).alias("arrived")).alias("new")
    arrived = F.col("new.arrived").isNotNull()

    def merged(name: str) -> Column:
        fresh, kept = F.col(f"new.{name}"), F.col(f"old.{name}")
        if coalesce_nulls:
            fresh = F.coalesce(fresh, kept)
        return F.when(arrived, fresh).otherwise(kept).alias(name)

    return old.join(new, BAR_KEY, "full_outer").select(
        *BAR_KEY,
        *[merged(name) for name in [*FACTS, "source"]],
        F.coalesce("old.ingested_at", now).alias("ingested_at"),
        F.coalesce("old.created_at", now).alias("created_at"),
        F.when(arrived, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )


def inserted_bars(batch: DataFrame, now: Column | dt.datetime) -> DataFrame:
    """What :func:`merge_bars` gives where no bar is stored, without its join."""
    now = as_instant(now)
    return batch.select(*BAR_COLUMNS, *[now.alias(name) for name in ("ingested_at", "created_at", "updated_at")])


def merge_stocks(
    stored: DataFrame,
    batch: DataFrame,
    now: Column | dt.datetime,
    coalesce_nulls: bool = False,
) -> DataFrame:
    """Stored stocks with the batch merged in by ticker; a merged stock is active."""
    now = as_instant(now)
    old = stored.select(*STOCK_COLUMNS, "is_active", "created_at", "updated_at").alias("old")
    new = batch.select(*STOCK_COLUMNS, F.lit(True).alias("arrived")).alias("new")
    arrived = F.col("new.arrived").isNotNull()

    def merged(name: str) -> Column:
        fresh, kept = F.col(f"new.{name}"), F.col(f"old.{name}")
        if coalesce_nulls:
            fresh = F.coalesce(fresh, kept)
        return F.when(arrived, fresh).otherwise(kept).alias(name)

    return old.join(new, "ticker", "full_outer").select(
        "ticker",
        *[merged(name) for name in STOCK_COLUMNS[1:]],
        F.when(arrived, F.lit(True)).otherwise(F.col("old.is_active")).alias("is_active"),
        F.coalesce("old.created_at", now).alias("created_at"),
        F.when(arrived, now).otherwise(F.col("old.updated_at")).alias("updated_at"),
    )


def without_stocks(bars: DataFrame, deleted: DataFrame) -> DataFrame:
    """Bars that remain when the given stocks are deleted."""
    return bars.join(deleted.select("ticker"), "ticker", "left_anti")
