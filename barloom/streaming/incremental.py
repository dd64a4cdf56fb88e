"""Incremental ingest of newly landed payload files with Structured Streaming.

Every micro-batch is one ingest job whose id comes from the batch number and
the payloads in it, so a replayed batch repeats the same job, and another batch
never passes for it, even if a new checkpoint starts to count again.

The merge accepts bars of any age: a late or restated bar simply replaces the
stored one, so there is no watermark.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.plans.ingest import ingest
from barloom.sources.payloads import Feed, landing_files, read_history
from barloom.sources.tables import MarketTables


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def batch_digest(payloads: DataFrame) -> str:
    """The same for the same payloads, in whatever order they are read."""
    key = F.xxhash64("payload_id", "arrived_at")
    row = payloads.agg(F.bit_xor(key).alias("xor"), F.count("*").alias("n")).first()
    return f"{row.n}-{(row.xor or 0) & (2**64 - 1):016x}"


def start_ingest(
    tables: MarketTables,
    landing: str,
    checkpoint: str,
    *,
    provider: str,
    stream: str,
    one_per_line: bool = False,
    read: Callable[[DataFrame, str], Feed] = read_history,
    files_per_batch: int | None = None,
    clock: Callable[[], dt.datetime] = _utc_now,
    **options,
) -> StreamingQuery:
    """Start a query that ingests all files landed since the last run, then stops."""
    landed = landing_files(
        tables.spark, landing, one_per_line, streaming=True, files_per_batch=files_per_batch
    )

    def ingest_batch(payloads: DataFrame, batch_id: int) -> None:
        ingest(
            tables,
            read(payloads, provider),
            provider=provider,
            job_id=f"{stream}-{batch_id}-{batch_digest(payloads)}",
            at=clock(),
            clock=clock,
            **options,
        )

    return (
        landed.writeStream.foreachBatch(ingest_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
