"""Price and volume expressions on exact decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shares in one lot.
SHARES_PER_LOT = 100


def change(close: Column, previous: Column) -> Column:
    """Daily change against the provider's previous close; NULL-propagating."""
    return close - previous


def change_percent(close: Column, previous: Column) -> Column:
    """Daily change in percent; NULL when an input is NULL or previous is zero."""
    return F.try_divide(close - previous, previous) * F.lit(100).cast("decimal(3,0)")


def direction(value: Column) -> Column:
    """``up``, ``down`` or ``flat``; an unknown change counts as flat."""
    return F.when(value > 0, "up").when(value < 0, "down").otherwise("flat")


def candle_direction(open_: Column, close: Column) -> Column:
    """``up`` or ``down``; an unchanged session counts as up."""
    return F.when(close >= open_, "up").otherwise("down")


def lots(shares: Column) -> Column:
    """Shares as lots, exactly. Plain bigint division would give a double."""
    per_lot = F.lit(SHARES_PER_LOT).cast("decimal(3,0)")
    return (shares.cast("decimal(20,0)") / per_lot).cast("decimal(22,2)")
