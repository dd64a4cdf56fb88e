"""Indicator registry and panel.

An indicator is three expressions over a bar: its value, an optional direction
and a filter. The panel evaluates all enabled ones in a single scan of the bars.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frequency import frequency_log10, frequency_raw
from barloom.functions.parsing import finite
from barloom.functions.prices import candle_direction


@dataclass(frozen=True)
class Indicator:
    """One entry of the registry. ``value`` is NULL for a bar the series leaves out."""

    id: str
    label: str
    category: str
    requires: tuple[str, ...]
    value: Callable[[], Column]
    direction: Callable[[], Column] | None = None
    normalization: str | None = None
    default_visible: bool = False


_REGISTRY: dict[str, Indicator] = {}


def register(indicator: Indicator) -> Indicator:
    """Add an indicator; ids are unique."""
    if indicator.id in _REGISTRY:
        raise ValueError(f"indicator {indicator.id!r} exists already")
    _REGISTRY[indicator.id] = indicator
    return indicator


def registered() -> list[Indicator]:
    return list(_REGISTRY.values())


def by_id(indicator_id: str) -> Indicator:
    if indicator_id not in _REGISTRY:
        raise KeyError(f"unknown indicator {indicator_id!r}")
    return _REGISTRY[indicator_id]


def default_ids() -> list[str]:
    return [i.id for i in registered() if i.default_visible]


def _raw() -> Column:
    return frequency_raw(F.col("volume_shares"), F.col("frequency"))


# Ids, labels, categories and normalisation names of the built-in indicators.
VOLUME = register(
    Indicator(
        id="volume",
        label="Volume",
        category="market-data",
        requires=("volume_shares", "open", "close"),
        value=lambda: F.col("volume_shares").cast("double"),
        direction=lambda: candle_direction(F.col("open"), F.col("close")),
        default_visible=True,
    )
)
FREQUENCY = register(
    Indicator(
        id="frequency-analyzer",
        label="Frequency Analyzer",
        category="analytics",
        requires=("volume_shares", "frequency"),
        value=lambda: frequency_log10(finite(_raw())),
        normalization="log10(raw shares)",
    )
)


def panel(bars: DataFrame, enabled: Iterable[str] | None = None) -> DataFrame:
    """Long series ``(ticker, trade_date, indicator, value, direction)``.

    Only the columns the enabled indicators need are read, once for all of them.
    """
    chosen = [by_id(i) for i in dict.fromkeys(default_ids() if enabled is None else enabled)]
    for indicator in chosen:
        lacking = [name for name in indicator.requires if name not in bars.columns]
        if lacking:
            raise ValueError(f"indicator {indicator.id} needs column {lacking[0]}")
    no_text = F.lit(None).cast("string")
    points = [
        F.struct(
            F.lit(i.id).alias("indicator"),
            i.value().alias("value"),
            (i.direction() if i.direction else no_text).alias("direction"),
        )
        for i in chosen
    ]
    shape = "array<struct<indicator:string,value:double,direction:string>>"
    return (
        bars.select("ticker", "trade_date", F.inline(F.array(*points).cast(shape)))
        .where(F.col("value").isNotNull())
    )


def candles(bars: DataFrame) -> DataFrame:
    """Candle series as plain numbers."""
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")]
    return bars.select("ticker", "trade_date", *prices)


def close_line(bars: DataFrame) -> DataFrame:
    """Line series of the close."""
    return bars.select("ticker", "trade_date", F.col("close").cast("double").alias("value"))


def volume_bars(bars: DataFrame) -> DataFrame:
    """Volume series with the direction of the session."""
    return panel(bars, [VOLUME.id]).select("ticker", "trade_date", "value", "direction")


def frequency_series(bars: DataFrame) -> DataFrame:
    """Log series of the frequency indicator; sessions without a positive value are left out."""
    return panel(bars, [FREQUENCY.id]).select("ticker", "trade_date", "value")
