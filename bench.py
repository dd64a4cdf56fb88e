"""Headline timings. Prints one JSON line.

Bars are derived from the test tables, seeded and ingested into stored tables,
and read back from there, as a user's would be. Every step runs once to warm
the JVM; writes are then timed once on fresh tables, reads as a median. Read
results go to the noop sink, so every column of every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from barloom.plans import history as hist
from barloom.plans import indicators, ingest, status, watchlist
from barloom.schema import BAR
from barloom.session import local_session, working_folder
from barloom.sources import fixtures, payloads
from barloom.sources.tables import MarketTables
from barloom.verify.queries import AS_OF, CUT, PROVIDER, T0, T1

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def consume(frame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def clock(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    root = working_folder(spark, "bench")
    stocks = fixtures.stocks(spark, SF_DIR)
    seconds = {}

    # The test tables hold no bars: derive them once, timed on its own.
    def derive(name: str) -> None:
        fixtures.bars(spark, SF_DIR).write.parquet(f"{root}/{name}")

    derive("warm")
    seconds["derive_bars"] = clock(lambda: derive("bars"))
    bars = spark.read.schema(BAR).parquet(f"{root}/bars")
    cut = F.lit(CUT).cast("date")
    early, late = bars.where(F.col("trade_date") < cut), bars.where(F.col("trade_date") >= cut)
    landing = f"{root}/landing"
    payloads.history_payloads(late, stocks, F.year("trade_date")).select(
        "payload"
    ).write.text(landing)

    def load(name: str) -> MarketTables:
        """Seed fresh tables and ingest the landed payloads into them."""
        tables = MarketTables(spark, f"{root}/{name}", grain="year").create()
        seconds["seed_load"] = clock(
            lambda: ingest.seed(tables, early, stocks, provider=PROVIDER, job_id="seed", at=T0)
        )
        feed = payloads.read_history(payloads.landing_files(spark, landing, True), PROVIDER)
        seconds["batch_ingest"] = clock(
            lambda: ingest.ingest(tables, feed, provider=PROVIDER, job_id="late", at=T1)
        )
        return tables

    load("first")
    tables = load("second")

    def history(timeframe: str):
        return hist.universe_history(
            tables.bars(), tables.stocks(), as_of=AS_OF, provider=PROVIDER, timeframe=timeframe
        ).bars

    def requested():
        asked = fixtures.order_requests(spark, SF_DIR, AS_OF)
        return hist.history(
            tables.bars(), tables.stocks(), asked, provider=PROVIDER, prune=True
        ).bars

    reads = {
        "watchlist_snapshot": lambda: watchlist.watchlist(tables.bars(), tables.stocks()),
        "history_6m_all": lambda: history("6M"),
        "history_all": lambda: history("ALL"),
        "history_requests": requested,
        "indicator_panel": lambda: indicators.panel(
            tables.bars(), [i.id for i in indicators.registered()]
        ),
        "latest_quote": lambda: watchlist.latest_quotes(tables.bars()),
        "freshness_status": lambda: status.freshness(
            tables.bars(), tables.runs(), as_of=AS_OF, provider=PROVIDER, repository="parquet"
        ),
    }
    for name, build in reads.items():
        consume(build())
        seconds[name] = statistics.median(clock(lambda b=build: consume(b())) for _ in range(RUNS))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "market_data_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": {name: round(value, 3) for name, value in seconds.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
