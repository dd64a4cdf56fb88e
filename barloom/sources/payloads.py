"""Readers for landed provider payloads.

Two JSON shapes exist. A *history* payload holds one symbol and the list of its
bars; a *summary* payload holds one bar for each of many symbols. Both become
one frame: a typed row per bar, and one row with a ``fault`` for each payload
that could not be read. A job that needs both reads the payloads once.

A bar keeps what went wrong with it in ``parse_errors``; the quality rules add
their own findings later.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.arrays import non_null
from barloom.functions.parsing import parse_iso_date, parse_number, strip
from barloom.functions.variants import computed_once, field, is_object, objects_field, text_field
from barloom.operators.quality import text_is_blank, ticker_is_bad
from barloom.schema import FACTS, OPTIONAL_FACTS, REQUIRED_FACTS, STOCK_COLUMNS

# Provider field names of each bar column.
HISTORY_DATE = "date"
HISTORY_FIELDS = {
    "open": "open",
    "high": "high",
    "low": "low",
    "close": "close",
    "previous": "previous",
    "volume_shares": "volume",
    "value_idr": "value",
    "frequency": "frequency",
    "foreign_buy_shares": "foreignBuyShares",
    "foreign_sell_shares": "foreignSellShares",
}
SUMMARY_DATE, SUMMARY_CODE, SUMMARY_NAME = "Date", "StockCode", "StockName"
SUMMARY_FIELDS = {
    "open": "OpenPrice",
    "high": "High",
    "low": "Low",
    "close": "Close",
    "previous": "Previous",
    "volume_shares": "Volume",
    "value_idr": "Value",
    "frequency": "Frequency",
    "foreign_buy_shares": "ForeignBuy",
    "foreign_sell_shares": "ForeignSell",
    "non_regular_volume_shares": "NonRegularVolume",
    "non_regular_value_idr": "NonRegularValue",
    "non_regular_frequency": "NonRegularFrequency",
}
# Fixed value: the only unit a history payload may declare.
VOLUME_UNIT = "shares"

ARRIVAL = ["arrived_at", "payload_id", "position"]
ROW_COLUMNS = [*ARRIVAL, *STOCK_COLUMNS, "trade_date", *FACTS, "source", "parse_errors"]


@dataclass(frozen=True)
class Feed:
    """What was read from a source: :data:`ROW_COLUMNS` and ``fault``."""

    parsed: DataFrame

    @property
    def rows(self) -> DataFrame:
        """The bars."""
        return self.parsed.where(F.col("fault").isNull()).select(*ROW_COLUMNS)

    @property
    def rejects(self) -> DataFrame:
        """The payloads that could not be read, and why."""
        return self.parsed.where(F.col("fault").isNotNull()).select(
            "payload_id", "arrived_at", "ticker", F.col("fault").alias("reason")
        )


def landing_files(
    spark: SparkSession,
    path: str,
    one_per_line: bool = False,
    streaming: bool = False,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Landed payload files as ``(payload_id, arrived_at, payload)``.

    By default a file is one payload; ``one_per_line`` reads a payload per line.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format("text").option("wholetext", not one_per_line)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    text = reader.load(path)
    payload_id = F.col("_metadata.file_path")
    if one_per_line:
        payload_id = F.concat_ws("#", payload_id, F.hex(F.xxhash64("value")))
    return text.select(
        payload_id.alias("payload_id"),
        F.col("_metadata.file_modification_time").alias("arrived_at"),
        F.col("value").alias("payload"),
    )


def _bar_fields(item: Column, date_field: str, names: dict[str, str]) -> list[Column]:
    """Raw text of each provider field, before conversion."""
    return [
        item[date_field].alias("raw_trade_date"),
        *[item[source].alias(f"raw_{name}") for name, source in names.items()],
    ]


def _typed(rows: DataFrame, names: dict[str, str], source: str) -> DataFrame:
    """Convert the raw text columns and note what is missing or does not convert."""
    values = {"trade_date": parse_iso_date(F.col("raw_trade_date"))}
    for name, kind in FACTS.items():
        values[name] = (
            parse_number(F.col(f"raw_{name}"), kind) if name in names else F.lit(None).cast(kind)
        )
    typed = rows.select("*", *[value.alias(name) for name, value in values.items()])

    def fault(name: str, required: bool) -> Column:
        raw = F.col(f"raw_{name}")
        unreadable = F.when(
            raw.isNotNull() & F.col(name).isNull(), F.lit(f"{name}_unreadable")
        )
        if not required:
            return unreadable
        return F.when(raw.isNull(), F.lit(f"{name}_missing")).otherwise(unreadable)

    faults = [fault("trade_date", True)]
    faults += [fault(name, True) for name in REQUIRED_FACTS]
    faults += [fault(name, False) for name in OPTIONAL_FACTS if name in names]
    readable = F.col("fault").isNull()
    return typed.select(
        *ARRIVAL,
        *STOCK_COLUMNS,
        "trade_date",
        *FACTS,
        strip(F.lit(source)).alias("source"),
        non_null([F.when(readable, fault) for fault in faults]).alias("parse_errors"),
        "fault",
    )


def _explode_objects(docs: DataFrame, keep: list[str]) -> DataFrame:
    """One row per list element that is an object; other elements are skipped.

    A document with a fault keeps one row, without an element.
    """
    readable = F.col("fault").isNull()
    return docs.select(
        *keep,
        "fault",
        F.posexplode_outer(F.when(readable, F.col("items"))).alias("position", "item"),
    ).where(~readable | F.col("item").isNotNull())


def _kind_of_document(doc: Column) -> Column:
    return F.when(doc.isNull(), "malformed_json").when(~is_object(doc), "not_an_object")


def read_history(payloads: DataFrame, source: str) -> Feed:
    """History payloads to rows. The provider gives no sector and no subsector.

    A payload with a bad envelope or identity is rejected as a whole.
    """
    arrival = ["payload_id", "arrived_at"]
    parsed = computed_once(payloads, arrival, doc=F.try_parse_json("payload"))
    doc, data = F.col("doc"), field(F.col("doc"), "data")
    opened = computed_once(
        parsed,
        arrival,
        envelope_fault=F.coalesce(
            _kind_of_document(doc),
            F.when(data.isNotNull() & ~is_object(data), "data_not_an_object"),
        ),
        history=F.coalesce(data, doc),
    )
    history = F.col("history")
    code = F.when(field(history, "code").isNull(), "").otherwise(text_field(history, "code"))
    fields = computed_once(
        opened,
        [*arrival, "envelope_fault"],
        ticker=F.upper(code),
        given_name=text_field(history, "name"),
        unit=text_field(history, "unit"),
        has_items=field(history, "items").isNotNull(),
        items=objects_field(history, "items", [HISTORY_DATE, *HISTORY_FIELDS.values()]),
    ).withColumn("company_name", F.coalesce("given_name", "ticker"))
    checked = fields.withColumn(
        "fault",
        F.coalesce(
            "envelope_fault",
            F.when(F.col("unit") != VOLUME_UNIT, "unit_not_shares"),
            F.when(F.col("has_items") & F.col("items").isNull(), "items_not_a_list"),
            F.when(ticker_is_bad(F.col("ticker")), "bad_ticker"),
            F.when(text_is_blank(F.col("company_name")), "blank_company_name"),
        ),
    )
    no_text = F.lit(None).cast("string")
    named = checked.withColumn("sector", no_text).withColumn("subsector", no_text)
    raw = _explode_objects(named, [*arrival, *STOCK_COLUMNS]).select(
        *ARRIVAL,
        *STOCK_COLUMNS,
        "fault",
        *_bar_fields(F.col("item"), HISTORY_DATE, HISTORY_FIELDS),
    )
    return Feed(_typed(raw, HISTORY_FIELDS, source))


def read_summary(payloads: DataFrame, source: str) -> Feed:
    """Summary payloads to rows, one per symbol of the day."""
    arrival = ["payload_id", "arrived_at"]
    parsed = computed_once(payloads, arrival, doc=F.try_parse_json("payload"))
    doc = F.col("doc")
    docs = computed_once(
        parsed,
        arrival,
        document_fault=_kind_of_document(doc),
        has_rows=field(doc, "data").isNotNull(),
        items=objects_field(doc, "data", [SUMMARY_NAME, SUMMARY_DATE, *SUMMARY_FIELDS.values()], (SUMMARY_CODE,)),
    ).select(
        *arrival,
        F.coalesce(
            "document_fault", F.when(F.col("has_rows") & F.col("items").isNull(), "data_not_a_list")
        ).alias("fault"),
        "items",
    )
    items = _explode_objects(docs, arrival)
    item = F.col("item")
    # Absent code: blank, and so a bad ticker. No code at all where there is no item.
    code = F.when(item.isNotNull() & item[SUMMARY_CODE].isNull(), F.lit("")).otherwise(
        F.try_variant_get(item[SUMMARY_CODE], "$", "string")
    )
    raw = items.select(
        *ARRIVAL,
        "fault",
        F.upper(code).alias("ticker"),
        item[SUMMARY_NAME].alias("given_name"),
        F.lit(None).cast("string").alias("sector"),
        F.lit(None).cast("string").alias("subsector"),
        *_bar_fields(item, SUMMARY_DATE, SUMMARY_FIELDS),
    ).withColumn("company_name", F.coalesce("given_name", "ticker"))
    return Feed(_typed(raw, SUMMARY_FIELDS, source))


def history_payloads(bars: DataFrame, stocks: DataFrame, chunk: Column) -> DataFrame:
    """Bars back to history payloads, one per ticker and ``chunk``.

    ``chunk`` must bound the bars of one payload, as a year does.
    """
    item = F.struct(
        F.col("trade_date").cast("string").alias(HISTORY_DATE),
        *[F.col(name).alias(source) for name, source in HISTORY_FIELDS.items()],
    )
    # Shuffled by ticker, as rows: the lists are made, and the names joined, where that has put them.
    grouped = (
        bars.withColumn("chunk", chunk)
        .repartition("ticker")
        .groupBy("ticker", "chunk")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
    )
    return grouped.join(stocks.select("ticker", "company_name"), "ticker").select(
        F.concat_ws("/", "ticker", "chunk").alias("payload_id"),
        F.lit(None).cast("timestamp").alias("arrived_at"),
        F.to_json(
            F.struct(
                F.col("ticker").alias("code"),
                F.col("company_name").alias("name"),
                F.lit(VOLUME_UNIT).alias("unit"),
                "items",
            )
        ).alias("payload"),
    )


def summary_payloads(bars: DataFrame, stocks: DataFrame, chunk: Column) -> DataFrame:
    """Bars back to summary payloads, one per trade date and ``chunk``.

    ``chunk`` must bound the symbols of one payload; the provider stops at 1000.
    """
    item = F.struct(
        F.col("ticker").alias(SUMMARY_CODE),
        F.col("trade_date").cast("string").alias(SUMMARY_DATE),
        F.col("company_name").alias(SUMMARY_NAME),
        *[F.col(name).alias(source) for name, source in SUMMARY_FIELDS.items()],
    )
    return (
        bars.join(stocks.select("ticker", "company_name"), "ticker")
        .withColumn("chunk", chunk)
        .groupBy("trade_date", "chunk")
        .agg(F.sort_array(F.collect_list(item)).alias("data"))
        .select(
            F.concat_ws("/", "trade_date", "chunk").alias("payload_id"),
            F.lit(None).cast("timestamp").alias("arrived_at"),
            F.to_json(F.struct("data")).alias("payload"),
        )
    )
