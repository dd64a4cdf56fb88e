"""Array expressions for bounded series such as a 30-session sparkline."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_null(values: list[Column]) -> Column:
    """The values that are not NULL, as an array; rows without any build no array."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(*values).isNotNull(), F.array_compact(F.array(*values))).otherwise(none)


def last_of(values: Column) -> Column:
    """Last element; NULL for an empty array."""
    return F.try_element_at(values, F.lit(-1))


def tail_of(values: Column, n: int) -> Column:
    """Last ``n`` elements, or all of them when there are fewer."""
    start = F.greatest(F.size(values) - n + 1, F.lit(1))
    return F.slice(values, start, F.lit(n))


def spread_of(values: Column) -> Column:
    """Distance between the extremes; 1 for a level series, so it can divide."""
    spread = F.array_max(values) - F.array_min(values)
    return F.when(spread == 0, F.lit(1.0)).otherwise(spread)


def scaled_points(values: Column) -> Column:
    """``(position, level)`` per finite value, both scaled to 0..1.

    Fewer than two finite values make no line: the result is then empty.
    """
    bad = (float("nan"), float("inf"), float("-inf"))
    finite = F.filter(values, lambda v: v.isNotNull() & ~v.isin(*bad))
    points = F.when(F.size(finite) >= 2, finite).otherwise(F.slice(finite, 1, 0))
    low, spread = F.array_min(points), spread_of(points)
    return F.transform(
        points,
        lambda v, i: F.struct(
            (i / (F.size(points) - 1)).alias("position"), ((v - low) / spread).alias("level")
        ),
    )
