"""As-of join: for each (symbol, day) request the newest row on or before the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from barloom.operators.joins import SALTS, salted
from barloom.operators.ranges import period_of


def asof_join(requests: DataFrame, rows: DataFrame, columns: list[str], *, grain: str = "month", salts: int = SALTS) -> DataFrame:
    """Requests (`request_id`, `ticker`, `day`) with the given columns of the row as of their day, NULL where there is none.

    `rows` has one row per (ticker, trade_date). There is no range join. Each
    distinct (ticker, day) is answered once: rows and asked days lie in one order by
    (ticker, period, day), and the last row so far is the answer. A day with no row before it
    in its own period takes the carry of the earlier periods, which is worked out on one
    row per (ticker, period). A task so never holds more of a symbol than one period of days, or one row
    per period, however many requests name it.

    The answers go back to the requests by (ticker, day, slice), so that a day
    which half of all requests ask for is spread over `salts` tasks. Requests with a
    NULL ticker or day are kept, without an answer. Other columns of the requests are kept as well, unless they
    bear the name of a column asked for, which is an error.
    """
    clash = sorted(set(columns) & set(requests.columns))
    if clash:
        raise ValueError(f"requests have a column {clash[0]} of their own")
    dealt = salted(requests, salts)
    units = dealt.select("ticker", "day", "slice").where(F.col("ticker").isNotNull() & F.col("day").isNotNull()).distinct()
    asked = units.select("ticker", "day").distinct()

    facts = F.struct(*columns)
    kind = rows.select(facts.alias("f")).schema["f"].dataType
    period = period_of(F.col("day"), grain).alias("period")
    held = rows.select("ticker", F.col("trade_date").alias("day"), F.lit(False).alias("asks"), facts.alias("found"))
    both = held.unionByName(
        asked.select("ticker", "day", F.lit(True).alias("asks"), F.lit(None).cast(kind).alias("found"))
    ).withColumn("period", period)
    # A row of the very day comes before the question.
    so_far = W.partitionBy("ticker", "period").orderBy("day", "asks").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = both.withColumn("near", F.last("found", ignorenulls=True).over(so_far)).where("asks").select("ticker", "day", "period", "near")

    # The last row of each period that has one, and a place for each period that is asked about.
    newest = held.groupBy("ticker", period).agg(F.max_by("found", "day").alias("newest"))
    places = asked.select("ticker", period).distinct()
    earlier = W.partitionBy("ticker").orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        newest.join(places.withColumn("asked", F.lit(True)), ["ticker", "period"], "full_outer")
        .withColumn("carry", F.last("newest", ignorenulls=True).over(earlier))
        .where("asked")
        .select("ticker", "period", "carry")
    )
    answers = near.join(carry, ["ticker", "period"]).select("ticker", "day", F.coalesce("near", "carry").alias("answer"))
    by_slice = units.join(answers, ["ticker", "day"])
    return dealt.join(by_slice, ["ticker", "day", "slice"], "left").select(
        *requests.columns, *[F.col("answer")[name].alias(name) for name in columns]
    )
