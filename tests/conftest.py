from __future__ import annotations

import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.schema import BAR, FACTS, STOCK  # noqa: E402
from barloom.session import local_session, working_folder  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # Many tiny plans: the quick compiler pays off more than the optimising one.
    session = local_session(8, shuffle_partitions=4, java_options="-XX:TieredStopAtLevel=1")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder(spark):
    return working_folder(spark, "test")


def bar_row(ticker, day, price=100, **facts):
    """A valid bar as a tuple in schema order; any column can be overridden."""
    close = Decimal(str(price))
    values = {
        "open": close, "high": close + 2, "low": max(close - 2, Decimal(1)), "close": close,
        "previous": close - 1, "volume_shares": 3000, "value_idr": Decimal("5.00"),
        "frequency": 10, "source": "test",
    }
    values.update(facts)
    day = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return (ticker, day, *[values.get(name) for name in FACTS], values["source"])


@pytest.fixture
def make_bars(spark):
    def make(*rows):
        # Nullable, so that a test can also build bars that are not valid.
        schema = type(BAR)([type(f)(f.name, f.dataType, True) for f in BAR.fields])
        return spark.createDataFrame([tuple(r) for r in rows], schema)

    return make


@pytest.fixture
def make_stocks(spark):
    def make(*rows):
        full = [
            (t, *(rest + (f"{t} Ltd", None, None, True)[len(rest):])) for t, *rest in map(tuple, rows)
            for rest in [tuple(rest)]
        ]
        return spark.createDataFrame(full, STOCK)

    return make
