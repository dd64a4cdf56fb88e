"""The volume-per-trade-count indicator.

The raw series is volume over the cube of the trade count. It is computed in
double: a bigint cube overflows, and decimal division stops at 18 places while
the series runs many orders of magnitude below that.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.prices import SHARES_PER_LOT


def frequency_raw(volume: Column, frequency: Column, unit: str = "shares") -> Column:
    """Raw indicator. NULL when an input is NULL or no trade took place.

    A negative input raises: such rows belong in quarantine, not in a chart.
    """
    if unit not in ("shares", "lots"):
        raise ValueError(f"unknown unit {unit!r}")
    size = volume.cast("double")
    if unit == "lots":
        size = size / F.lit(float(SHARES_PER_LOT))
    raw = F.try_divide(size, F.pow(frequency.cast("double"), F.lit(3.0)))
    negative = (volume < 0) | (frequency < 0)
    return F.when(
        negative, F.raise_error(F.lit("volume and frequency must not be negative")).cast("double")
    ).otherwise(raw)


def frequency_log10(raw: Column) -> Column:
    """Display form of the raw series; NULL where a logarithm has no meaning."""
    return F.when(raw > 0, F.log10(raw))
