from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import arrays, calendar, frequency, parsing, prices


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(v, kind):
    return F.lit(v).cast(kind)


@pytest.mark.parametrize(
    ("volume", "trades", "unit", "expected"),
    [
        (3000, 2, "shares", 375.0),
        (3000, 10, "shares", 3.0),
        (3000, 0, "shares", None),
        (3000, 10, "lots", 0.03),
        (None, 3, "shares", None),
        (3000, None, "shares", None),
        (9 * 10**18, 3 * 10**9, "shares", 9e18 / 27e27),
    ],
)
def test_frequency_raw(spark, volume, trades, unit, expected):
    got = value(
        spark, frequency.frequency_raw(lit(volume, "bigint"), lit(trades, "bigint"), unit)
    )
    assert got == expected if expected is None else math.isclose(got, expected, rel_tol=1e-12)


def test_frequency_raw_rejects_negative_input(spark):
    for volume, trades in ((-1, 3), (3, -1)):
        with pytest.raises(Exception, match="must not be negative"):
            value(spark, frequency.frequency_raw(lit(volume, "bigint"), lit(trades, "bigint")))
    with pytest.raises(ValueError, match="unit"):
        frequency.frequency_raw(F.lit(1), F.lit(1), unit="tons")


def test_frequency_log10(spark):
    shown = [value(spark, frequency.frequency_log10(lit(x, "double"))) for x in (3, 0, -1, None)]
    assert shown == [math.log10(3), None, None, None]


@pytest.mark.parametrize(
    ("day", "expected"),
    [
        ("2026-08-23", "2026-08-21"),
        ("2026-08-22", "2026-08-21"),
        ("2026-08-21", "2026-08-21"),
        ("2026-08-24", "2026-08-24"),
    ],
)
def test_last_weekday(spark, day, expected):
    assert str(value(spark, calendar.last_weekday(day))) == expected


def test_staleness(spark):
    def stale(latest):
        return value(spark, calendar.is_stale(lit(latest, "date"), "2026-08-23"))

    assert [stale(d) for d in (None, "2026-08-20", "2026-08-21", "2026-09-01")] == [
        True, True, False, False,
    ]


@pytest.mark.parametrize(
    ("timeframe", "days"), [("1M", 31), ("3M", 93), ("6M", 186), ("1Y", 366), ("ALL", None)]
)
def test_window_start(spark, timeframe, days):
    anchor = dt.date(2026, 8, 21)
    start = calendar.window_start(lit(None, "date"), F.lit(timeframe), F.lit(anchor))
    expected = None if days is None else anchor - dt.timedelta(days=days)
    assert value(spark, start) == expected
    explicit = calendar.window_start(lit("2026-01-05", "date"), F.lit(timeframe), F.lit(anchor))
    assert value(spark, explicit) == dt.date(2026, 1, 5)


def test_freshness_badge(spark):
    def badge(stale, mock):
        pair = F.struct(
            calendar.freshness_label(F.lit(stale), F.lit(mock)),
            calendar.freshness_mode(F.lit(stale), F.lit(mock)),
        )
        return tuple(value(spark, pair))

    assert badge(False, True) == ("MOCK DATA", "mock")
    assert badge(True, True) == ("MOCK DATA", "mock")
    assert badge(True, False) == ("STALE", "stale")
    assert badge(False, False) == ("EOD CURRENT", "current")


def test_change_and_direction(spark):
    price = "decimal(18,4)"

    def percent(close, previous):
        return value(spark, prices.change_percent(lit(close, price), lit(previous, price)))

    assert percent("102", "100") == Decimal(2)
    assert percent("102", "0") is None
    assert percent(None, "100") is None
    assert float(percent("1", "3")) == pytest.approx(-200 / 3)
    got = [value(spark, prices.direction(lit(x, "double"))) for x in (2, -2, 0, None)]
    assert got == ["up", "down", "flat", "flat"]
    candle = [
        value(spark, prices.candle_direction(lit(o, price), lit(c, price)))
        for o, c in ((1, 2), (2, 2), (2, 1))
    ]
    assert candle == ["up", "up", "down"]


def test_lots_are_exact(spark):
    assert value(spark, prices.lots(lit(9_223_372_036_854_775_807, "bigint"))) == Decimal(
        "92233720368547758.07"
    )


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("25", 25), ("25.0", None), ("1e3", None), (" 7 ", 7), ("-4", -4), ("", None),
        ("None", None), ("true", None), ("9223372036854775808", None),
    ],
)
def test_integers_are_strict(spark, text, expected):
    assert value(spark, parsing.parse_number(F.lit(text), T.LongType())) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("25.00005", "25.0001"), ("1e3", "1000"), ("NaN", None), ("x", None), ("1e30", None)],
)
def test_decimals_round_to_the_stored_scale(spark, text, expected):
    got = value(spark, parsing.parse_number(F.lit(text), T.DecimalType(18, 4)))
    assert got == (None if expected is None else Decimal(expected))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2026-08-21", "2026-08-21"), ("2026-08-21T17:00:00+07:00", "2026-08-21"),
        ("20260821", "2026-08-21"), ("2026-8-21", None), ("2026-02-30", None),
        ("21/08/2026", None), ("", None),
    ],
)
def test_iso_dates(spark, text, expected):
    got = value(spark, parsing.parse_iso_date(F.lit(text)))
    assert (None if got is None else str(got)) == expected


def test_finite(spark):
    got = [value(spark, parsing.finite(F.lit(x))) for x in ("1.5", "NaN", "Infinity", "x")]
    assert got == [1.5, None, None, None]
    assert value(spark, parsing.finite(lit(None, "string"))) is None


def test_text_helpers(spark):
    assert value(spark, parsing.strip(F.lit("\t a b \n"))) == "a b"
    assert value(spark, parsing.clipped(F.lit("x" * 1200), 1000)) == "x" * 1000
    assert value(spark, parsing.clipped(F.lit(""), 1000)) is None


def test_array_tail_and_last(spark):
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    empty = F.array().cast("array<int>")
    assert value(spark, arrays.last_of(three)) == 3
    assert value(spark, arrays.last_of(empty)) is None
    assert value(spark, arrays.tail_of(three, 2)) == [2, 3]
    assert value(spark, arrays.tail_of(three, 5)) == [1, 2, 3]
    assert value(spark, arrays.tail_of(empty, 5)) == []


def test_scaled_points(spark):
    def points(*values):
        column = F.array(*[F.lit(v) for v in values]).cast("array<double>")
        return [tuple(p) for p in value(spark, arrays.scaled_points(column))]

    assert points(10, 30, 20) == [(0.0, 0.0), (0.5, 1.0), (1.0, 0.5)]
    assert points(5, 5) == [(0.0, 0.0), (1.0, 0.0)]
    assert points(5) == []
    assert points(None, 4, 8) == [(0.0, 0.0), (1.0, 1.0)]
