"""Rolling forms of the indicator, as-of join and missing sessions against plain Python."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pytest
from conftest import bar_row

from barloom.operators.asof import asof_join
from barloom.operators.sessions import missing_sessions
from barloom.plans.rolling import percentiles, rolling_percentile, rolling_zscore

DAY = dt.date(2026, 1, 1)


@pytest.fixture(scope="module")
def values():
    rng = random.Random(4)
    out = {
        "MIX": [rng.choice([None, 1e-57, 3e-40, 2.5, 2.5, 1e6, rng.random()]) for _ in range(400)],
        "EQL": [0.1] * 300,
        "TNY": [1e6] + [1e-30 * (1 + i % 3) for i in range(200)],
        "FEW": [1.0, None, 2.0],
        "NUL": [None] * 30,
    }
    return out


@pytest.fixture(scope="module")
def series(spark, values):
    rows = [(t, DAY + dt.timedelta(days=i), v) for t, own in values.items() for i, v in enumerate(own)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "ticker string, trade_date date, raw double").repartition(5)


@pytest.mark.parametrize("window", [2, 7, 120])
def test_zscores(series, values, window):
    got = {(r.ticker, (r.trade_date - DAY).days): r for r in rolling_zscore(series, window, 2).collect()}
    assert len(got) == sum(map(len, values.values()))
    for ticker, own in values.items():
        for i, v in enumerate(own):
            frame = [x for x in own[max(0, i - window + 1) : i + 1] if x is not None]
            r = got[ticker, i]
            if len(frame) < 2:
                assert r.mean is None and r.deviation is None and r.zscore is None
                continue
            mean = math.fsum(frame) / len(frame)
            deviation = math.sqrt(math.fsum((x - mean) ** 2 for x in frame) / len(frame)) if len(set(frame)) > 1 else 0.0
            assert r.mean == pytest.approx(mean, rel=1e-9) and r.deviation == pytest.approx(deviation, rel=1e-6)
            if deviation == 0 or v is None:
                assert r.zscore is None
            else:
                assert r.zscore == pytest.approx((v - mean) / deviation, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("window", [1, 7, 120])
def test_percentiles(series, values, window):
    got = {(r.ticker, (r.trade_date - DAY).days): r.percentile for r in rolling_percentile(series, window, 1).collect()}
    for ticker, own in values.items():
        for i, v in enumerate(own):
            frame = [x for x in own[max(0, i - window + 1) : i + 1] if x is not None]
            expected = None if v is None else 100 * sum(x <= v for x in frame) / len(frame)
            assert got[ticker, i] == (None if expected is None else pytest.approx(expected))


def test_steps_of_a_percentile_grow_with_the_logarithm():
    from barloom.plans import rolling

    steps = []
    for n in (1000, 16_000):
        count = 0

        class Counted(list):
            def __getitem__(self, i):
                nonlocal count
                count += 1
                return super().__getitem__(i)

        tree = rolling.Ranks(n)
        tree.tree = Counted(tree.tree)
        for rank in range(1, n + 1, 7):
            tree.add(rank, 1)
            tree.at_most(rank)
        steps.append(count / len(range(1, n + 1, 7)))
    assert steps[1] < 1.5 * steps[0] and steps[1] < 4 * math.log2(16_000)
    assert np.isnan(percentiles(np.array([np.nan, 1.0]), 5, 2)).all()


def test_zscore_is_one_shuffle(series):
    frame = rolling_zscore(series, 20, 2)
    assert frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_asof_requests(spark, make_bars):
    rng = random.Random(7)
    bars = {(t, DAY + dt.timedelta(days=rng.randrange(400))): rng.randrange(50, 90) for t in "ABC" for _ in range(60)}
    asked = [(i, rng.choice(["A", "B", "C", "Z", None]), DAY + dt.timedelta(days=rng.randrange(-20, 450))) for i in range(400)]
    hot = DAY + dt.timedelta(days=200)
    asked += [(1000 + i, "A", hot) for i in range(600)] + [(5000, "A", None)]
    frame = make_bars(*[bar_row(t, d, price=p) for (t, d), p in bars.items()])
    requests = spark.createDataFrame([(i, t, d, "kept") for i, t, d in asked], "request_id long, ticker string, day date, note string")
    for grain in ("month", "year", "day"):
        found = asof_join(requests, frame, ["trade_date", "close"], grain=grain)
        got = {r.request_id: r for r in found.collect()}
        assert len(got) == len(asked) and found.columns == ["request_id", "ticker", "day", "note", "trade_date", "close"]
        for i, t, d in asked:
            days = [x for s, x in bars if s == t and d is not None and x <= d]
            assert got[i].trade_date == max(days, default=None)
            assert got[i].close == (bars[t, max(days)] if days else None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    with pytest.raises(ValueError, match="close"):
        asof_join(requests.withColumnRenamed("note", "close"), frame, ["close"])


def test_missing_sessions(spark, make_bars):
    day = lambda d: dt.date(2026, 8, d)
    traded = {"AAA": [3, 4, 5, 6, 7, 10, 11], "BBB": [4, 7, 10], "CCC": [5], "DDD": [11]}
    bars = make_bars(*[bar_row(t, day(d)) for t, days in traded.items() for d in days])
    got = sorted(tuple(r) for r in missing_sessions(bars).collect())
    assert got == [
        ("BBB", day(4), day(7), day(5), day(6), 2),
        ("BBB", day(10), None, day(11), day(11), 1),
        ("CCC", day(5), None, day(6), day(11), 4),
    ]
    assert missing_sessions(bars.where("false")).count() == 0


def test_zscore_sorts_whole_series_three_times_in_a_fixed_number_of_parts(spark):
    series = spark.createDataFrame([("AAA", dt.date(2026, 8, 20), 1.0)], "ticker string, trade_date date, raw double")
    plan = rolling_zscore(series)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 3 and plan.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan
