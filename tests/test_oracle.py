"""Every registered query against its SQL twin, and the shape of every plan."""

from __future__ import annotations

import pytest
from conftest import SMALL

from barloom.verify.compare import differences, duck
from barloom.verify.oracle import ORACLE
from barloom.verify.queries import REGISTRY, _instant

# A product of tables, a Python worker, or a sort of everything in one task.
UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython")


@pytest.fixture(scope="module")
def con():
    connection = duck(SMALL)
    yield connection
    connection.close()


def test_every_query_has_a_twin():
    assert set(REGISTRY) == set(ORACLE)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_equals_sql(spark, con, name):
    frame = REGISTRY[name](spark, SMALL)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in UNWANTED if word in plan]
    assert differences(spark, con, SMALL, lambda *_: frame, ORACLE[name]) == []


def test_a_merge_lists_inactive_stocks_again(spark):
    """The smallest tables have no inactive stock."""
    name, folder = "maintained_watchlist", SMALL.replace("0.001", "0.01")
    connection = duck(folder)
    inactive = connection.execute("select count(*) from supplier where s_acctbal < 0").fetchone()[0]
    assert inactive > 0
    assert differences(spark, connection, folder, REGISTRY[name], ORACLE[name]) == []
    connection.close()


def test_instants_are_utc_text_in_the_hour_that_the_clock_shows_twice(spark):
    zone, seconds = spark.conf.get("spark.sql.session.timeZone"), [-1, 0, 1730611800, 1730615400, 253402300799]
    rows = spark.createDataFrame([*enumerate(seconds), (9, None)], "n int, s long").selectExpr("n", "timestamp_seconds(s) as at")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r.at for r in rows.select("n", _instant("at")).orderBy("n").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [
        "1969-12-31 23:59:59", "1970-01-01 00:00:00", "2024-11-03 05:30:00", "2024-11-03 06:30:00",
        "9999-12-31 23:59:59", None,
    ]


@pytest.mark.parametrize("name", ["upsert_merge", "upsert_coalesce_nulls", "upsert_idempotent"])
def test_an_instant_that_a_merged_row_has_again_is_not_made_text_again(spark, name):
    plan = REGISTRY[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    # One text for every row; the two others only where the instant differs from the first.
    assert plan.count("timestampadd(") == 3 and plan.count("ELSE cast(timestampadd(") == 2


@pytest.mark.parametrize("name", ["upsert_merge", "upsert_coalesce_nulls"])
def test_bars_of_a_merge_are_shuffled_by_key_once_and_not_written(spark, name):
    frame = REGISTRY[name](spark, SMALL)
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Line items by symbol, bars by key; the second use of the bars reads what the first has shuffled.
    assert plan.count("ReusedExchange") == 1 and plan.count("FileScan") == 1 and "lineitem" in plan
    assert "ENSURE_REQUIREMENTS" not in plan


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(REGISTRY) <= contract.queries().keys()
    assert set(ORACLE) <= contract.oracle_sql().keys() <= contract.queries().keys()
