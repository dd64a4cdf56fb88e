"""Ingestion run log: append-only events, one when a run opens, one when it closes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.parsing import clipped
from barloom.operators.latest import latest_row
from barloom.operators.upsert import as_instant
from barloom.schema import RUN_EVENT

# Fixed value: characters shown of an error message. The log holds all of it.
ERROR_LENGTH = 1000
OPENED, CLOSED = 0, 1
COUNTS = ["rows_received", "rows_inserted", "rows_updated"]


def _conform(events: DataFrame) -> DataFrame:
    return events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RUN_EVENT.fields])


def run_id(job_id: str | Column, ticker: Column) -> Column:
    """The same job and ticker always give the same run, so a replay adds no run."""
    job = job_id if isinstance(job_id, Column) else F.lit(job_id)
    return F.concat_ws("/", job, ticker)


def open_runs(
    tickers: DataFrame,
    job_id: str | Column,
    provider: str,
    started_at: Column | dt.datetime,
    requested_date: Column | dt.date | None = None,
) -> DataFrame:
    """One ``running`` event per ticker, with zero counts."""
    job = job_id if isinstance(job_id, Column) else F.lit(job_id)
    asked = requested_date if isinstance(requested_date, Column) else F.lit(requested_date)
    return _conform(
        tickers.select(
            run_id(job, F.col("ticker")).alias("run_id"),
            job.alias("job_id"),
            F.lit(OPENED).alias("event_seq"),
            F.lit(provider).alias("provider"),
            "ticker",
            as_instant(started_at).alias("started_at"),
            F.lit(None).alias("finished_at"),
            F.lit("running").alias("status"),
            asked.alias("requested_date"),
            *[F.lit(0).alias(name) for name in COUNTS],
            F.lit(None).alias("error_message"),
        )
    )


def close_runs(
    opened: DataFrame,
    outcome: DataFrame,
    finished_at: Column | dt.datetime,
    event_seq: int = CLOSED,
) -> DataFrame:
    """One closing event per opened run; a run that is closed again needs a greater ``event_seq``.

    ``outcome`` holds ticker, counts, error and ``failed``. The counts of a failed
    run are zero.
    """
    failed = F.col("failed")
    kept = opened.select(
        "run_id", "job_id", "provider", "ticker", "started_at", "requested_date"
    )
    return _conform(
        kept.join(outcome, "ticker").select(
            *kept.columns,
            F.lit(event_seq).alias("event_seq"),
            as_instant(finished_at).alias("finished_at"),
            F.when(failed, "failed").otherwise("succeeded").alias("status"),
            *[
                F.when(failed, 0).otherwise(F.coalesce(F.col(name), F.lit(0))).alias(name)
                for name in COUNTS
            ],
            F.nullif("error", F.lit("")).alias("error_message"),
        )
    )


def shown_error(message: Column) -> Column:
    """An error message as a reader sees it."""
    return clipped(message, ERROR_LENGTH)


def current_state(events: DataFrame) -> DataFrame:
    """The last event of each run."""
    columns = [f.name for f in RUN_EVENT.fields if f.name not in ("run_id", "event_seq")]
    return latest_row(events, ["event_seq", *columns], key="run_id", order="event_seq")


def latest_run(events: DataFrame) -> DataFrame:
    """The run that started last, even if still running. Ties go to the greater id."""
    newest = F.struct("started_at", "run_id", "event_seq")
    status = F.struct("provider", "status", "finished_at", "rows_received")
    return events.agg(F.max_by(status, newest).alias("run")).where(
        F.col("run").isNotNull()
    ).select("run.*")
