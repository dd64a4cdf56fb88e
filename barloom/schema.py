"""Table schemas.

Every reader in the package passes one of these to Spark; nothing is inferred.
Prices are exact decimals, counts are bigint, and the natural key of a bar is
``(ticker, trade_date)``.
"""

from __future__ import annotations

from pyspark.sql import types as T

PRICE = T.DecimalType(18, 4)
VALUE = T.DecimalType(24, 2)

BAR_KEY = ["ticker", "trade_date"]
PRICE_COLUMNS = ["open", "high", "low", "close", "previous"]

# Column name -> type, in table order.
REQUIRED_FACTS: dict[str, T.DataType] = {
    **{name: PRICE for name in PRICE_COLUMNS},
    "volume_shares": T.LongType(),
    "value_idr": VALUE,
    "frequency": T.LongType(),
}
OPTIONAL_FACTS: dict[str, T.DataType] = {
    "foreign_buy_shares": T.LongType(),
    "foreign_sell_shares": T.LongType(),
    "non_regular_volume_shares": T.LongType(),
    "non_regular_value_idr": VALUE,
    "non_regular_frequency": T.LongType(),
}
FACTS: dict[str, T.DataType] = {**REQUIRED_FACTS, **OPTIONAL_FACTS}
BAR_COLUMNS = [*BAR_KEY, *FACTS, "source"]

BAR = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("trade_date", T.DateType(), False),
        *[T.StructField(name, kind, False) for name, kind in REQUIRED_FACTS.items()],
        *[T.StructField(name, kind, True) for name, kind in OPTIONAL_FACTS.items()],
        T.StructField("source", T.StringType(), False),
    ]
)

# Partition column of stored bars by grain. The name tells the grain.
PERIOD_COLUMNS = {"year": "trade_year", "month": "trade_month", "day": "trade_day"}


def stored_bar(grain: str) -> T.StructType:
    """A stored bar adds the audit instants and the partition column."""
    return T.StructType(
        [
            *BAR.fields,
            T.StructField("ingested_at", T.TimestampType(), False),
            T.StructField("created_at", T.TimestampType(), False),
            T.StructField("updated_at", T.TimestampType(), False),
            T.StructField(PERIOD_COLUMNS[grain], T.IntegerType(), False),
        ]
    )


STOCK_COLUMNS = ["ticker", "company_name", "sector", "subsector"]

STOCK = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("company_name", T.StringType(), False),
        T.StructField("sector", T.StringType(), True),
        T.StructField("subsector", T.StringType(), True),
        T.StructField("is_active", T.BooleanType(), False),
    ]
)

STORED_STOCK = T.StructType(
    [
        *STOCK.fields,
        T.StructField("created_at", T.TimestampType(), False),
        T.StructField("updated_at", T.TimestampType(), False),
        T.StructField("ticker_slot", T.IntegerType(), False),
    ]
)

# Append-only: one event when a run opens, one when it closes.
RUN_EVENT = T.StructType(
    [
        T.StructField("run_id", T.StringType(), False),
        T.StructField("job_id", T.StringType(), False),
        T.StructField("event_seq", T.IntegerType(), False),
        T.StructField("provider", T.StringType(), False),
        T.StructField("ticker", T.StringType(), True),
        T.StructField("started_at", T.TimestampType(), False),
        T.StructField("finished_at", T.TimestampType(), True),
        T.StructField("status", T.StringType(), False),
        T.StructField("requested_date", T.DateType(), True),
        T.StructField("rows_received", T.LongType(), False),
        T.StructField("rows_inserted", T.LongType(), False),
        T.StructField("rows_updated", T.LongType(), False),
        T.StructField("error_message", T.StringType(), True),
    ]
)

HISTORY_REQUEST = T.StructType(
    [
        T.StructField("request_id", T.LongType(), False),
        T.StructField("ticker", T.StringType(), False),
        T.StructField("date_from", T.DateType(), True),
        T.StructField("date_to", T.DateType(), True),
        T.StructField("timeframe", T.StringType(), False),
        T.StructField("row_limit", T.IntegerType(), True),
        T.StructField("as_of", T.DateType(), False),
    ]
)
