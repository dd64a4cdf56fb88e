from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from barloom.operators.quality import BAR_RULES, assess, split
from barloom.sources.payloads import landing_files, read_history, read_summary

BAR = {
    "date": "2026-08-21T00:00:00", "open": 100, "high": "110.5", "low": 90, "close": 105,
    "previous": 99, "volume": 3000, "value": 315000.255, "frequency": 10, "foreignBuyShares": 5,
}
HISTORY = {"code": "bbca", "name": "Bank", "unit": "shares", "items": [BAR]}
ROW = {
    "Date": "2026-08-21", "StockCode": "antm", "StockName": "Mine", "OpenPrice": 100, "High": 110,
    "Low": 90, "Close": 105, "Previous": 99, "Volume": 3000, "Value": 315000, "Frequency": 10,
    "ForeignBuy": 1, "ForeignSell": 2, "NonRegularVolume": 3, "NonRegularValue": 4.5,
    "NonRegularFrequency": 6,
}


def landed(spark, *payloads):
    texts = [p if isinstance(p, str) else json.dumps(p) for p in payloads]
    rows = [(f"p{i}", text) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "payload_id string, payload string")
    return frame.withColumn("arrived_at", F.lit(None).cast("timestamp"))


def without(record, key):
    return {k: v for k, v in record.items() if k != key}


@pytest.mark.parametrize("payload", [HISTORY, {"data": HISTORY}, {"data": HISTORY, "x": 1}])
def test_history_direct_and_wrapped(spark, payload):
    row = read_history(landed(spark, payload), "feed").rows.first()
    assert (row.ticker, row.company_name, str(row.trade_date)) == ("BBCA", "Bank", "2026-08-21")
    assert str(row.high) == "110.5000" and str(row.value_idr) == "315000.26"
    assert (row.volume_shares, row.frequency, row.foreign_buy_shares) == (3000, 10, 5)
    assert row.foreign_sell_shares is None and row.non_regular_frequency is None
    assert (row.source, row.parse_errors, row.sector) == ("feed", [], None)


@pytest.mark.parametrize(
    ("payload", "reason"),
    [
        ("{not json", "malformed_json"),
        ("[1]", "not_an_object"),
        ("null", "not_an_object"),
        ({"data": [HISTORY]}, "data_not_an_object"),
        ({"data": None}, "data_not_an_object"),
        ({**HISTORY, "unit": "lots"}, "unit_not_shares"),
        ({"data": {**HISTORY, "unit": "lots"}}, "unit_not_shares"),
        ({**HISTORY, "items": {}}, "items_not_a_list"),
        ({**HISTORY, "items": None}, "items_not_a_list"),
        (without(HISTORY, "code"), "bad_ticker"),
        ({**HISTORY, "code": None}, "bad_ticker"),
        ({**HISTORY, "code": "TOOLONGTICKER"}, "bad_ticker"),
        ({**HISTORY, "code": "A\n"}, "bad_ticker"),
        ({**HISTORY, "name": " "}, "blank_company_name"),
    ],
)
def test_history_rejects(spark, payload, reason):
    feed = read_history(landed(spark, payload, HISTORY), "feed")
    assert [(r.payload_id, r.reason) for r in feed.rejects.collect()] == [("p0", reason)]
    assert [r.payload_id for r in feed.rows.collect()] == ["p1"]


def test_history_defaults(spark):
    feed = read_history(
        landed(
            spark,
            without(HISTORY, "items"),
            without(HISTORY, "name"),
            {**HISTORY, "name": None},
            {**HISTORY, "unit": None},
        ),
        "feed",
    )
    names = {r.payload_id: r.company_name for r in feed.rows.collect()}
    assert names == {"p1": "BBCA", "p2": "BBCA", "p3": "Bank"}
    assert feed.rejects.count() == 0


def test_elements_that_are_no_objects_are_skipped(spark):
    feed = read_history(landed(spark, {**HISTORY, "items": [1, "x", None, [BAR], BAR]}), "feed")
    assert [r.position for r in feed.rows.collect()] == [4]


@pytest.mark.parametrize(
    ("change", "errors"),
    [
        ({"volume": "25.5"}, ["volume_shares_unreadable"]),
        ({"volume": True}, ["volume_shares_unreadable"]),
        ({"open": "abc"}, ["open_unreadable"]),
        ({"open": None}, ["open_missing"]),
        ({"date": "2026/08/21"}, ["trade_date_unreadable"]),
        ({"foreignBuyShares": "x"}, ["foreign_buy_shares_unreadable"]),
        ({"foreignBuyShares": None}, []),
        ({"close": "nan", "frequency": {}}, ["close_unreadable", "frequency_unreadable"]),
    ],
)
def test_bar_errors(spark, change, errors):
    feed = read_history(landed(spark, {**HISTORY, "items": [{**BAR, **change}]}), "feed")
    assert feed.rows.first().parse_errors == errors


def test_missing_fields_are_named(spark):
    feed = read_history(landed(spark, {**HISTORY, "items": [{}]}), "feed")
    row = feed.rows.first()
    assert row.parse_errors == [
        f"{n}_missing"
        for n in ("trade_date", "open", "high", "low", "close", "previous", "volume_shares",
                  "value_idr", "frequency")
    ]


def test_summary(spark):
    second = without({**ROW, "StockCode": "TLKM"}, "StockName")
    feed = read_summary(landed(spark, {"data": [ROW, 5, None, second]}), "feed")
    rows = {r.ticker: r for r in feed.rows.collect()}
    assert set(rows) == {"ANTM", "TLKM"}
    antm = rows["ANTM"]
    assert (antm.company_name, rows["TLKM"].company_name) == ("Mine", "TLKM")
    assert (antm.foreign_buy_shares, antm.foreign_sell_shares) == (1, 2)
    assert (antm.non_regular_volume_shares, antm.non_regular_frequency) == (3, 6)
    assert str(antm.non_regular_value_idr) == "4.50"
    assert antm.parse_errors == []


@pytest.mark.parametrize(
    ("payload", "reason"),
    [
        ({"data": {}}, "data_not_a_list"),
        ({"data": None}, "data_not_a_list"),
        ("[]", "not_an_object"),
        ("{", "malformed_json"),
    ],
)
def test_summary_rejects(spark, payload, reason):
    assert read_summary(landed(spark, payload), "feed").rejects.first().reason == reason


def test_summary_without_rows_is_empty(spark):
    feed = read_summary(landed(spark, {}, {"data": []}), "feed")
    assert feed.parsed.count() == 0


def test_summary_row_without_code_goes_to_quarantine(spark):
    feed = read_summary(landed(spark, {"data": [without(ROW, "StockCode")]}), "feed")
    bad = split(assess(feed.rows, BAR_RULES, known=F.col("parse_errors"))).quarantine.first()
    assert bad.reasons == ["bad_ticker"]


def test_landing_files_whole_and_by_line(spark, folder):
    texts = [json.dumps(HISTORY), json.dumps({**HISTORY, "code": "ANTM"})]
    frame = spark.createDataFrame([(t,) for t in texts], "value string").coalesce(1)
    frame.write.text(f"{folder}/lines")
    by_line = read_history(landing_files(spark, f"{folder}/lines", one_per_line=True), "feed")
    assert {r.ticker for r in by_line.rows.collect()} == {"BBCA", "ANTM"}
    spark.createDataFrame(
        [(json.dumps(HISTORY, indent=1),)], "value string"
    ).write.text(f"{folder}/whole")
    whole = read_history(landing_files(spark, f"{folder}/whole"), "feed").rows.collect()
    assert [r.ticker for r in whole] == ["BBCA"] and whole[0].arrived_at is not None


def test_payload_is_parsed_once(spark):
    feed = read_history(landed(spark, HISTORY), "feed")
    plan = feed.rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1


def test_fields_of_an_element_are_taken_in_one_step(spark):
    feed = read_history(landed(spark, {"code": "AAA", "items": []}), "feed")
    plan = feed.parsed._jdf.queryExecution().analyzed().toString()
    assert "$.items" in plan and "$.close" not in plan
