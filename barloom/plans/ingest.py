"""Batch ingest of all symbols of a feed in one job.

Order of the writes: opening event of the job, staged rows, merged rows and
planned counts, opening run events, bars, stocks, closing run events, closing
event of the job. The last one is the commit marker. Nothing is merged from a
table that is being overwritten: the merged rows are staged first, and a job that
is run again after a crash writes them from there, with the counts planned
before the tables changed. So no stored bar is lost between two partitions, and
nothing is counted twice. A job that throws is closed as failed and may be run
again; a job that succeeded is not repeated.

Tables with versions (:mod:`barloom.sources.snapshots`) take all writes after the opening
events in one commit. If another job has replaced the same partitions meanwhile, the
job is planned again on what that one left.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.calendar import within
from barloom.operators.quality import BAR_RULES, COMPANY_NAME, assess, duplicate_keys, split, ticker_is_bad
from barloom.operators.ranges import period_of
from barloom.operators.runlog import (
    CLOSED,
    OPENED,
    close_runs,
    current_state,
    open_runs,
)
from barloom.operators.upsert import as_instant, inserted_bars, last_wins, merge_bars, merge_counts, merge_stocks
from barloom.schema import BAR_COLUMNS, BAR_KEY, RUN_EVENT, STOCK_COLUMNS
from barloom.sources.payloads import ARRIVAL, Feed
from barloom.sources.providers import pull_window
from barloom.sources.snapshots import CommitConflict
from barloom.sources.tables import MarketTables

OUTCOME = T.StructType(
    [
        T.StructField("ticker", T.StringType(), False),
        T.StructField("rows_received", T.LongType(), True),
        T.StructField("rows_inserted", T.LongType(), True),
        T.StructField("rows_updated", T.LongType(), True),
        T.StructField("error", T.StringType(), True),
        T.StructField("failed", T.BooleanType(), False),
    ]
)
UNKNOWN_TICKER = "?"
#: What a job takes from its feed. With all of it staged, the parsed rows go.
TAKEN = ["quarantined", "seen", "failures", "batch", "identities"]


class IngestError(RuntimeError):
    """Raised in fail-fast mode when any symbol of the batch failed."""


def failures_of(assessed: DataFrame, rejects: DataFrame, whole_payloads: bool) -> DataFrame:
    """One error per symbol that has a rejected payload.

    With ``whole_payloads`` a payload with a bad row counts as rejected too, for
    every symbol in it.
    """
    named = F.coalesce(F.nullif("ticker", F.lit("")), F.lit(UNKNOWN_TICKER)).alias("ticker")
    failures = rejects.select(named, F.col("reason").alias("error"))
    if whole_payloads:
        spoilt = (
            assessed.where(F.size("reasons") > 0)
            .groupBy("payload_id")
            .agg(F.min(F.array_join("reasons", ",")).alias("error"))
        )
        inside = assessed.select("payload_id", named).distinct().join(spoilt, "payload_id")
        failures = failures.unionByName(inside.select("ticker", "error"))
    return failures.groupBy("ticker").agg(F.min("error").alias("error"))


def accepted_rows(assessed: DataFrame, failures: DataFrame, whole_payloads: bool) -> DataFrame:
    """Valid rows. With ``whole_payloads`` a symbol that failed contributes none."""
    valid = split(assessed).valid
    return valid.join(failures, "ticker", "left_anti") if whole_payloads else valid


def key_hash() -> Column:
    return F.xxhash64(*BAR_KEY).alias("key_hash")


def repeated_keys(rows: DataFrame) -> DataFrame:
    """The hashes that more than one row's key has: of all repeated keys, and by chance of two different ones."""
    return duplicate_keys(rows.select(key_hash()), ["key_hash"]).select("key_hash")


def one_each(rows: DataFrame, repeated: DataFrame, arrival: list[str]) -> DataFrame:
    """One row per (ticker, trade date), the last to arrive, with copies.

    Whole rows are shuffled by key only where the key's hash is ``repeated``.
    """
    hashed = rows.select(*arrival, *BAR_COLUMNS, key_hash())
    single = hashed.join(repeated, "key_hash", "left_anti").select(*BAR_COLUMNS, F.lit(1).cast("bigint").alias("copies"))
    several = hashed.join(repeated, "key_hash", "left_semi").select(*arrival, *BAR_COLUMNS)
    return single.unionByName(last_wins(several, BAR_KEY, arrival).select(*single.columns))


def stocks_of(rows: DataFrame) -> DataFrame:
    """The last identity given for each ticker that has a bar in the batch."""
    # Hashed to one row for each payload and identity before rows are compared as a whole.
    *payload, position = ARRIVAL
    last = rows.groupBy(*payload, *STOCK_COLUMNS).agg(F.max(position).alias(position))
    return last_wins(last, ["ticker"], ARRIVAL).select(*STOCK_COLUMNS)


def plan_outcome(
    symbols: DataFrame,
    failures: DataFrame,
    counts: DataFrame,
    tickers: DataFrame | None = None,
) -> DataFrame:
    """One row per symbol of the job: its counts, its error and whether it failed.

    A symbol has failed when it has an error and nothing of it was accepted; an
    error beside accepted rows stays as a message. Rows in quarantine alone are
    no failure.
    """
    named = F.coalesce(F.nullif("ticker", F.lit("")), F.lit(UNKNOWN_TICKER)).alias("ticker")
    seen = symbols.select(named).distinct()
    outcome = counts.join(failures, "ticker", "full_outer").join(seen, "ticker", "full_outer")
    if tickers is not None:
        absent = F.when(F.col("found").isNull(), F.lit("no payload for ticker"))
        wanted = tickers.select(F.upper("ticker").alias("ticker")).distinct()
        # A payload whose ticker can't be read may be anyone's: it is reported whatever was asked for.
        unknown = outcome.where(ticker_is_bad(F.col("ticker"))).select("ticker")
        outcome = (
            wanted.unionByName(unknown)
            .join(outcome.withColumn("found", F.lit(True)), "ticker", "left")
            .withColumn("error", F.coalesce(absent, "error"))
        )
    failed = F.col("error").isNotNull() & F.col("rows_received").isNull()
    return outcome.withColumn("failed", failed).select(*OUTCOME.fieldNames())


def _asked_for(
    parsed: DataFrame,
    tickers: DataFrame | None,
    date_from: dt.date | None,
    date_to: dt.date | None,
) -> DataFrame:
    """Bars of the requested symbols and dates; faults are kept whatever their date, or if no ticker could be read."""
    if tickers is not None:
        wanted = tickers.select(F.upper("ticker").alias("ticker"), F.lit(True).alias("wanted")).distinct()
        parsed = (
            parsed.join(wanted, "ticker", "left")
            .where(F.col("wanted") | ticker_is_bad(F.col("ticker")))
            .drop("wanted")
        )
    day = F.col("trade_date")
    start, end = F.lit(date_from).cast("date"), F.lit(date_to).cast("date")
    return parsed.where(F.col("fault").isNotNull() | day.isNull() | within(day, start, end))


def ingest(
    tables: MarketTables,
    feed: Feed,
    *,
    provider: str,
    job_id: str,
    at: dt.datetime,
    clock: Callable[[], dt.datetime] | None = None,
    tickers: DataFrame | None = None,
    date_from: dt.date | None = None,
    date_to: dt.date | None = None,
    limit: int | None = None,
    whole_payloads: bool = False,
    fail_fast: bool = False,
    coalesce_nulls: bool = False,
) -> DataFrame:
    """Validate a feed, merge it into the tables and log one run per symbol.

    Returns the runs of the job. ``whole_payloads`` fails a symbol for one bad row;
    ``fail_fast`` also raises, after logging, when a symbol failed. ``clock`` gives
    the instant at which the job ends, which is ``at`` without it.
    """
    finish = clock or (lambda: at)
    log = tables.runs().where(F.col("job_id") == job_id)
    job = log.where(F.col("ticker").isNull()).agg(
        F.max("event_seq").alias("seq"),
        F.bool_or(F.col("status") == "succeeded").alias("done"),
        F.min("started_at").alias("since"),
    ).first()
    if not job.done:
        if job.seq is None:
            tables.append_runs(_job_event(tables, job_id, provider, at, date_to, OPENED, "running"))
        resume = not log.where(F.col("ticker").isNotNull()).isEmpty()
        try:
            closing = (job.seq or OPENED) + 1
            _run(
                tables, feed, provider, job_id, at, finish, tickers, date_from, date_to, limit,
                whole_payloads, coalesce_nulls, resume, closing,
            )
            tables.drop_staged(job_id)
        except Exception as error:
            _close_as_failed(tables, job_id, provider, at, date_to, closing, finish(), error)
            raise
    runs = runs_of(tables, job_id)
    if fail_fast:
        failed = runs.where(F.col("status") == "failed").orderBy("ticker").first()
        if failed is not None:
            raise IngestError(f"{failed.ticker}: {failed.error_message}")
    return runs


def runs_of(tables: MarketTables, job_id: str) -> DataFrame:
    """The runs of a job's symbols, without the run of the job itself."""
    log = tables.runs().where((F.col("job_id") == job_id) & F.col("ticker").isNotNull())
    return current_state(log)


def _job_event(
    tables, job_id, provider, at, date_to, seq, status, finished=None, received=None, error=None
) -> DataFrame:
    """An event of the job as a whole: a run without a ticker."""
    none = tables.spark.range(1).select(F.lit(None).cast("string").alias("ticker"))
    opened = open_runs(none, f"{job_id}", provider, at, date_to)
    return opened.select(
        F.lit(f"{job_id}/").alias("run_id"),
        *[c for c in opened.columns if c not in ("run_id", "event_seq", "status", "finished_at", "rows_received", "error_message")],
        F.lit(seq).cast("int").alias("event_seq"),
        F.lit(status).alias("status"),
        F.lit(finished).cast("timestamp").alias("finished_at"),
        F.lit(received or 0).cast("bigint").alias("rows_received"),
        F.lit(error).cast("string").alias("error_message"),
    )


def _close_as_failed(tables, job_id, provider, at, date_to, seq, finished, error) -> None:
    """Closing events with zero counts for every run that is still open, and for the job."""
    text = f"{type(error).__name__}: {error}"
    state = runs_of(tables, job_id).where(F.col("status") == "running")
    outcome = state.select(
        "ticker",
        *[F.lit(0).cast("bigint").alias(name) for name in ("rows_received", "rows_inserted", "rows_updated")],
        F.lit(text).alias("error"),
        F.lit(True).alias("failed"),
    )
    tables.append_runs(
        close_runs(runs_of(tables, job_id), outcome, finished, seq).unionByName(
            _job_event(tables, job_id, provider, at, date_to, seq, "failed", finished, error=text).select(
                *RUN_EVENT.fieldNames()
            )
        )
    )


def _run(
    tables, feed, provider, job_id, at, finish, tickers, date_from, date_to, limit,
    whole_payloads, coalesce_nulls, resume, closing,
) -> None:
    while True:
        base, changes = tables.pinned(), None
        if resume and not tables.replans:  # all that is needed was staged before the runs were opened
            outcome = tables.staged(job_id, "outcome", OUTCOME)
        else:
            outcome, changes = _plan(
                base, feed, job_id, at, tickers, date_from, date_to, limit, whole_payloads, coalesce_nulls, resume
            )
            opened = open_runs(outcome.select("ticker"), job_id, provider, at, date_to)
            if resume:
                opened = opened.join(runs_of(tables, job_id).select("run_id"), "run_id", "left_anti")
            tables.append_runs(opened)
        events = close_runs(runs_of(tables, job_id), outcome, finish(), closing)
        done = _job_event(tables, job_id, provider, at, date_to, closing, "succeeded", finish())
        try:
            return tables.publish(job_id, (base, changes), events, done)
        except CommitConflict:
            resume = True


def _plan(
    tables, feed, job_id, at, tickers, date_from, date_to, limit, whole_payloads, coalesce_nulls, resume
) -> tuple[DataFrame, object]:
    """Stage the merged periods, the merged stocks and, last, the outcome of every symbol; it, and what to publish.

    A job whose runs were opened has staged all that it took from its feed; that doesn't depend on the tables
    and is not worked out again. The bars lie on disk in as few copies as a rerun allows: the parsed rows go when all is
    taken from them, the batch once it is merged.
    """
    taken = resume and all(tables.has_staged(job_id, name) for name in TAKEN)

    def first(rows: DataFrame, name: str) -> DataFrame:
        return rows if taken else tables.stage(rows, job_id, name)

    def stage(rows: DataFrame, name: str, *partition: str) -> DataFrame:
        return tables.staged(job_id, name, rows.schema) if taken else tables.stage(rows, job_id, name, *partition)

    asked = _asked_for(feed.parsed, tickers, date_from, date_to)
    rules = [*BAR_RULES, COMPANY_NAME]
    parsed = first(assess(asked, rules, known=F.col("parse_errors")), "parsed")
    stage(not_accepted(parsed), "quarantined")
    assessed = parsed.where(F.col("fault").isNull())
    if limit is not None:
        assessed = first(pull_window(assessed, limit=limit), "pulled")
    seen = stage(assessed.select("ticker").distinct(), "seen")
    failures = stage(failures_of(assessed, Feed(parsed).rejects, whole_payloads), "failures")
    accepted = accepted_rows(assessed, failures, whole_payloads)
    parts = [] if taken else tables.merge_parts(job_id, tables.touched_periods(accepted))
    single = one_each(accepted, first(repeated_keys(accepted), "repeated"), ARRIVAL)
    batch = stage(single.withColumn("merge_part", merge_part(tables, parts)), "batch", "merge_part")
    if taken:
        parts = tables.merge_parts(job_id, tables.touched_periods(batch))
    stored = tables.bars_in([period for part in parts for period in part])
    # Only the slots of the batch are read and rewritten.
    fresh = stage(stocks_of(accepted).withColumn("ticker_slot", tables.slot_of(F.col("ticker"))), "identities")
    tables.drop(job_id, ["parsed", "pulled", "repeated"])
    slots = [r.ticker_slot for r in fresh.select("ticker_slot").distinct().collect()]
    changes = tables.stage_merge(
        job_id,
        batch,
        parts,
        lambda held, rows: inserted_bars(rows, at) if held.isEmpty() else merge_bars(held, rows, at, coalesce_nulls),
        merge_stocks(tables.stocks_in(slots), fresh, at, coalesce_nulls),
        slots,
    )
    counts = merge_counts(batch, stored)
    outcome = tables.stage(plan_outcome(seen, failures, counts, tickers), job_id, "outcome")
    tables.drop_taken(job_id)
    return outcome, changes


def merge_part(tables: MarketTables, parts: list[list[int]]) -> Column:
    """The number of the part of periods in which a row is merged; parts are in order."""
    period = period_of(F.col("trade_date"), tables.grain)
    return sum(((period >= part[0]).cast("int") for part in parts[1:]), F.lit(0))


def not_accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("fault").isNotNull() | (F.size("reasons") > 0))


def quarantine(tables: MarketTables, job_id: str) -> DataFrame:
    """The rows a job did not accept, each with its reasons; a rejected payload is one row with its fault."""
    # Parsed rows go only when those that weren't accepted have been written for themselves.
    held = "parsed" if tables.has_staged(job_id, "parsed") else "quarantined"
    rows = not_accepted(tables.spark.read.parquet(tables.path(f"staging/{job_id}/{held}")))
    faulty = F.col("fault").isNotNull()
    reasons = F.when(faulty, F.array("fault")).otherwise(F.col("reasons"))
    rows = rows.withColumn("reasons", reasons)
    return split(rows).quarantine.drop("parse_errors", "fault")


def seed(
    tables: MarketTables,
    bars: DataFrame,
    stocks: DataFrame,
    *,
    provider: str,
    job_id: str,
    at: dt.datetime,
    clock: Callable[[], dt.datetime] | None = None,
) -> None:
    """First load of empty tables. Logs one succeeded run with the rows received.

    Bars that break a rule go to quarantine, and of a repeated key one stays, the
    greatest row. A table that holds bars of another job is not seeded again. A seed that
    succeeded is not repeated; one that was interrupted starts over.
    """
    log = tables.runs().where(F.col("job_id") == job_id)
    if not log.where(F.col("status") == "succeeded").isEmpty():
        return
    if log.isEmpty():
        if not tables.bars().isEmpty() or not tables.stocks().isEmpty():
            raise IngestError("only empty tables can be seeded")
        tables.append_runs(_job_event(tables, job_id, provider, at, None, OPENED, "running"))
    now = as_instant(at)
    none = F.array().cast("array<string>")
    judged = assess(bars.select(*BAR_COLUMNS), BAR_RULES)
    judged = judged.withColumns({"parse_errors": none, "fault": F.lit(None).cast("string")})
    parsed = tables.stage(judged, job_id, "parsed")
    tables.stage(not_accepted(parsed), job_id, "quarantined")
    valid = split(parsed.drop("parse_errors", "fault")).valid
    received = valid.count()
    held = one_each(valid, tables.stage(repeated_keys(valid), job_id, "repeated"), [])
    done = _job_event(
        tables, job_id, provider, at, None, CLOSED, "succeeded", (clock or (lambda: at))(), received
    )
    instants = [now.alias(name) for name in ("ingested_at", "created_at", "updated_at")]
    tables.load(
        held.select(*BAR_COLUMNS, *instants),
        stocks.select(*STOCK_COLUMNS, "is_active", *instants[1:]),
        done,
    )
    tables.drop(job_id, ["parsed", "repeated"])
