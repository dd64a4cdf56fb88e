"""Validation as named predicates.

``assess`` adds the list of broken rules to every row in one pass; ``split``
turns that into valid rows and quarantine. Nothing is dropped: the two parts
always add up to the input.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.calendar import TIMEFRAMES
from barloom.functions.arrays import non_null
from barloom.functions.parsing import TICKER, TICKER_ANY_CASE
from barloom.schema import BAR_KEY, OPTIONAL_FACTS, PRICE_COLUMNS, REQUIRED_FACTS

# Bounds of a history request and the states of a run.
MIN_ROW_LIMIT, MAX_ROW_LIMIT = 1, 2000
RUN_STATES = ["running", "succeeded", "failed"]

COUNT_COLUMNS = [name for name in REQUIRED_FACTS if name not in PRICE_COLUMNS]


@dataclass(frozen=True)
class Rule:
    """A named fault. ``broken`` gives the predicate that is true for a bad row."""

    name: str
    requires: tuple[str, ...]
    broken: Callable[[], Column]


def _absent_or(name: str, fault: Callable[[Column], Column]) -> Callable[[], Column]:
    return lambda: F.col(name).isNull() | fault(F.col(name))


def _present_and(name: str, fault: Callable[[Column], Column]) -> Callable[[], Column]:
    return lambda: F.col(name).isNotNull() & fault(F.col(name))


def ticker_is_bad(ticker: Column) -> Column:
    return F.coalesce(~ticker.rlike(TICKER), F.lit(True))


def text_is_blank(text: Column) -> Column:
    """True for NULL and for text of white space only; the search ends at the first other character."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


BAR_RULES: list[Rule] = [
    Rule("bad_ticker", ("ticker",), lambda: ticker_is_bad(F.col("ticker"))),
    Rule("no_trade_date", ("trade_date",), lambda: F.col("trade_date").isNull()),
    *[
        Rule(f"{name}_not_positive", (name,), _absent_or(name, lambda c: c <= 0))
        for name in PRICE_COLUMNS
    ],
    Rule(
        "high_too_low",
        ("open", "high", "low", "close"),
        lambda: F.coalesce(F.col("high") < F.greatest("open", "close", "low"), F.lit(False)),
    ),
    Rule(
        "low_too_high",
        ("open", "high", "low", "close"),
        lambda: F.coalesce(F.col("low") > F.least("open", "close", "high"), F.lit(False)),
    ),
    *[
        Rule(f"{name}_negative", (name,), _absent_or(name, lambda c: c < 0))
        for name in COUNT_COLUMNS
    ],
    *[
        Rule(f"{name}_negative", (name,), _present_and(name, lambda c: c < 0))
        for name in OPTIONAL_FACTS
    ],
    Rule("blank_source", ("source",), lambda: text_is_blank(F.col("source"))),
]

COMPANY_NAME = Rule("blank_company_name", ("company_name",), lambda: text_is_blank(F.col("company_name")))

STOCK_RULES: list[Rule] = [
    Rule("bad_ticker", ("ticker",), lambda: ticker_is_bad(F.col("ticker"))),
    COMPANY_NAME,
]

RUN_RULES: list[Rule] = [
    Rule("blank_provider", ("provider",), lambda: text_is_blank(F.col("provider"))),
    Rule(
        "unknown_status",
        ("status",),
        lambda: F.coalesce(~F.col("status").isin(RUN_STATES), F.lit(True)),
    ),
    *[
        Rule(f"{name}_negative", (name,), _absent_or(name, lambda c: c < 0))
        for name in ("rows_received", "rows_inserted", "rows_updated")
    ],
    Rule(
        "finished_before_started",
        ("started_at", "finished_at"),
        _present_and("finished_at", lambda c: c < F.col("started_at")),
    ),
]

REQUEST_RULES: list[Rule] = [
    Rule(
        "bad_ticker",
        ("ticker",),
        lambda: F.coalesce(~F.col("ticker").rlike(TICKER_ANY_CASE), F.lit(True)),
    ),
    Rule(
        "unknown_timeframe",
        ("timeframe",),
        lambda: F.coalesce(~F.col("timeframe").isin(TIMEFRAMES), F.lit(True)),
    ),
    Rule(
        "row_limit_out_of_range",
        ("row_limit",),
        _present_and("row_limit", lambda c: ~c.between(MIN_ROW_LIMIT, MAX_ROW_LIMIT)),
    ),
]


class Split(NamedTuple):
    valid: DataFrame
    quarantine: DataFrame


def assess(rows: DataFrame, rules: list[Rule], known: Column | None = None) -> DataFrame:
    """Add ``reasons``: the names of the broken rules, after any ``known`` ones."""
    present = set(rows.columns)
    for rule in rules:
        lacking = [name for name in rule.requires if name not in present]
        if lacking:
            raise ValueError(f"rule {rule.name} needs column {lacking[0]}")
    found = non_null([F.when(r.broken(), F.lit(r.name)) for r in rules])
    return rows.withColumn("reasons", found if known is None else F.concat(known, found))


def split(assessed: DataFrame) -> Split:
    """Rows without a reason, and rows with their reasons."""
    clean = F.size("reasons") == 0
    return Split(assessed.where(clean).drop("reasons"), assessed.where(~clean))


def reason_counts(assessed: DataFrame) -> DataFrame:
    """How many rows break each rule."""
    return (
        assessed.select(F.explode("reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count("*").alias("n_rows"))
    )


def duplicate_keys(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return (
        rows.groupBy(*(key or BAR_KEY)).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)
    )


def orphans(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Bars of symbols that the stock dimension does not know."""
    return bars.join(stocks.select("ticker"), "ticker", "left_anti")


def check_request(timeframe: str, row_limit: int | None) -> None:
    """Check the arguments of a single request before a plan is built from them."""
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"timeframe must be one of {', '.join(TIMEFRAMES)}")
    if row_limit is not None and not MIN_ROW_LIMIT <= row_limit <= MAX_ROW_LIMIT:
        raise ValueError(f"row limit must lie in {MIN_ROW_LIMIT}..{MAX_ROW_LIMIT}")
