"""The same questions as :mod:`barloom.verify.queries`, in SQL for DuckDB."""

from __future__ import annotations

AS_OF = "date '2001-11-04'"
EXPECTED = "date '2001-11-02'"
CUT, OVERLAP = "date '1999-01-01'", "date '1998-07-01'"

BARS = """
trades as (
  select concat('S', cast(l_suppkey as varchar)) as ticker,
         cast(l_shipdate as date) as trade_date,
         cast(l_extendedprice as decimal(18,4)) as price,
         cast(l_quantity as bigint) * 100 as qty,
         row_number() over (partition by l_suppkey, l_shipdate
           order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as ra,
         row_number() over (partition by l_suppkey, l_shipdate
           order by l_orderkey desc, l_linenumber desc, l_partkey desc,
                    l_extendedprice desc, l_quantity desc) as rd
  from lineitem),
daily as (
  select ticker, trade_date,
         max(case when ra = 1 then price end) as open, max(price) as high, min(price) as low,
         max(case when rd = 1 then price end) as close,
         cast(sum(qty) as bigint) as volume_shares,
         cast(sum(price * qty) as decimal(24,2)) as value_idr,
         count(*) as frequency
  from trades group by ticker, trade_date),
bars as (
  select ticker, trade_date, open, high, low, close,
         coalesce(lag(close) over (partition by ticker order by trade_date), open) as previous,
         volume_shares, value_idr, frequency,
         volume_shares // 5 as foreign_buy_shares, volume_shares // 6 as foreign_sell_shares,
         'fixture' as source
  from daily)"""

EARLY_BARS = BARS.replace("bars as (", "all_bars as (") + f""",
bars as (select * from all_bars where trade_date < {CUT})"""

RESTATED = BARS.replace("bars as (", "all_bars as (") + f""",
bars as (
  select * replace (case when trade_date >= {OVERLAP} then previous + 1 else previous end as previous)
  from (select *, max(trade_date) over (partition by ticker) as newest from all_bars)
  where not (trade_date = newest and cast(substr(ticker, 2) as bigint) % 7 = 0))"""

# A merge makes the stocks of its batch active, as `stock_upsert` has it.
MERGED_STOCKS = f"""
merged_stocks as (
  select * replace (is_active or ticker in (select ticker from all_bars where trade_date >= {OVERLAP}) as is_active)
  from stocks)"""

GAPPED = """
gapped as (
  select ticker, trade_date,
         case when volume_shares % 700 = 0 then null
              when same then 700 / pow(3::double, 3)
              else volume_shares / pow(cast(frequency as double), 3) end as raw
  from (select *, cast(substr(ticker, 2) as bigint) % 5 = 0 as same from bars))"""

STOCKS = """
stocks as (
  select concat('S', cast(s_suppkey as varchar)) as ticker, s_name as company_name,
         n_name as sector, r_name as subsector, s_acctbal >= 0 as is_active
  from supplier join nation on s_nationkey = n_nationkey
                join region on n_regionkey = r_regionkey)"""

CUSTOMER_STOCKS = """
customer_stocks as (
  select concat('S', cast(c_custkey as varchar)) as ticker, c_name as company_name,
         n_name as sector, c_mktsegment as subsector, c_acctbal >= 0 as is_active
  from customer join nation on c_nationkey = n_nationkey)"""

INTRADAY = """
ticks as (
  select concat('U', cast(user_id as varchar)) as ticker, cast(ts as date) as trade_date,
         cast(value + 1 as decimal(18,4)) as price,
         row_number() over (partition by user_id, cast(ts as date)
           order by ts, event_id, value) as ra,
         row_number() over (partition by user_id, cast(ts as date)
           order by ts desc, event_id desc, value desc) as rd
  from events),
intraday_daily as (
  select ticker, trade_date,
         max(case when ra = 1 then price end) as open, max(price) as high, min(price) as low,
         max(case when rd = 1 then price end) as close,
         cast(count(*) * 100 as bigint) as volume_shares,
         cast(sum(price) * 100 as decimal(24,2)) as value_idr, count(*) as frequency
  from ticks group by ticker, trade_date),
intraday as (
  select *, coalesce(lag(close) over (partition by ticker order by trade_date), open) as previous
  from intraday_daily)"""

REQUESTS = f"""
requests as (
  select o_orderkey as request_id, concat('s', cast(o_custkey as varchar)) as ticker,
         case when o_orderstatus = 'P' then cast(o_orderdate as date) - 45 end as date_from,
         case when o_orderstatus in ('P', 'F') then cast(o_orderdate as date) end as date_to,
         case substr(o_orderpriority, 1, 1) when '1' then '1M' when '2' then '3M'
              when '3' then '6M' when '4' then '1Y' else 'ALL' end as timeframe,
         case when o_orderstatus = 'P' then cast(o_orderkey % 9 + 1 as integer) end as row_limit,
         {AS_OF} as as_of
  from orders)"""

DIRTY = """
keyed as (
  select *, datediff('day', date '1992-01-01', trade_date) * 7
            + cast(substr(ticker, 2) as bigint) * 13 as k
  from bars),
spoilt as (
  select case when k % 107 = 0 then lower(ticker) else ticker end as ticker, trade_date, open,
         case when k % 101 = 0 then low - 1 else high end as high, low,
         case when k % 109 = 0 then 0 else close end as close,
         case when k % 131 <> 0 then previous end as previous,
         case when k % 97 = 0 then -1 else volume_shares end as volume_shares, value_idr,
         case when k % 103 = 0 then 0 else frequency end as frequency,
         case when k % 137 = 0 then -5 else foreign_buy_shares end as foreign_buy_shares,
         foreign_sell_shares,
         case when k % 113 = 0 then ' ' || chr(9) || ' ' else source end as source,
         unnest(case when k % 127 = 0 then [1, 2] else [1] end) as copy
  from keyed),
assessed as (
  select *, concat_ws(',',
    case when not regexp_full_match(ticker, '[A-Z0-9]{1,12}') then 'bad_ticker' end,
    case when open is null or open <= 0 then 'open_not_positive' end,
    case when high is null or high <= 0 then 'high_not_positive' end,
    case when low is null or low <= 0 then 'low_not_positive' end,
    case when close is null or close <= 0 then 'close_not_positive' end,
    case when previous is null or previous <= 0 then 'previous_not_positive' end,
    case when high < greatest(open, close, low) then 'high_too_low' end,
    case when low > least(open, close, high) then 'low_too_high' end,
    case when volume_shares < 0 then 'volume_shares_negative' end,
    case when value_idr < 0 then 'value_idr_negative' end,
    case when frequency < 0 then 'frequency_negative' end,
    case when foreign_buy_shares < 0 then 'foreign_buy_shares_negative' end,
    case when foreign_sell_shares < 0 then 'foreign_sell_shares_negative' end,
    case when length(trim(source, ' ' || chr(9))) = 0 then 'blank_source' end) as reasons
  from spoilt)"""

UPSERT = f"""
stored as (select * from bars where trade_date < {CUT}),
restated as (
  select ticker, trade_date, open, high, low, close, previous,
         volume_shares + 100 * case when frequency >= 2 then 2 else 1 end as volume_shares,
         frequency, foreign_buy_shares, cast(null as bigint) as foreign_sell_shares, source,
         case when frequency >= 2 then 2 else 1 end as copies
  from bars where trade_date >= {OVERLAP})"""

RUNS = """
runs as (
  select concat('nightly/', s.ticker) as run_id, 'landing' as provider, s.ticker,
         case when s.is_active then 'succeeded' else 'failed' end as status,
         date '2001-11-04' as requested_date,
         case when s.is_active then coalesce(n, 0) else 0 end as rows_received,
         case when s.is_active then coalesce(n, 0) else 0 end as rows_inserted,
         cast(0 as bigint) as rows_updated,
         case when not s.is_active then repeat(company_name, 80) end
           as error_message,
         '2024-01-01 08:00:00' as started_at,
         strftime(timestamp '2024-01-01 08:00:00'
                  + to_seconds(cast(length(company_name) as integer)),
                  '%Y-%m-%d %H:%M:%S') as finished_at
  from stocks s
  left join (select ticker, count(*) as n from bars group by ticker) c using (ticker))"""


def _with(*parts: str) -> str:
    return "with " + ",".join(parts) + "\n"


MONEY_DOUBLES = ", ".join(
    f"cast({c} as double) as {c}"
    for c in ("open", "high", "low", "close", "previous", "value_idr")
)
PRICE_DOUBLES = ", ".join(
    f"cast({c} as double) as {c}" for c in ("open", "high", "low", "close", "previous")
)
RAW = "volume_shares / pow(cast(frequency as double), 3)"
RAW_LOTS = "(volume_shares / 100.0::double) / pow(cast(frequency as double), 3)"
VIEW = f"""trade_date, {MONEY_DOUBLES}, volume_shares,
  cast(cast(volume_shares as decimal(20,0)) / 100 as double) as volume_lots, frequency,
  round({RAW}, 6) as raw_shares, round({RAW_LOTS}, 6) as raw_lots"""
PERCENT = "round((close - previous) / cast(previous as double) * 100, 6)"
DIRECTION = """case when close > previous then 'up' when close < previous then 'down'
  else 'flat' end"""
LOG = f"round(log10({RAW}), 6)"

LATEST = """
ranked as (select *, row_number() over (partition by ticker order by trade_date desc) as rn
           from bars),
newest as (select * from ranked where rn = 1)"""


def _watchlist(stocks: str) -> str:
    return f"""
select s.ticker, company_name, sector, cast(close as double) as latest_close,
       cast(close - previous as double) as change, {PERCENT} as change_percent,
       {DIRECTION} as direction, trade_date as latest_trade_date,
       least(coalesce(n, 0), 30) as n_points
from {stocks} s left join newest n1 using (ticker)
left join (select ticker, count(*) as n from bars group by ticker) c using (ticker)
where is_active"""


def _history(where: str, limit: int | None = None) -> str:
    cut = f"where rn <= {limit}" if limit else ""
    return (
        _with(BARS, STOCKS)
        + f""", windowed as (
  select *, row_number() over (partition by ticker order by trade_date desc) as rn
  from (select *, max(trade_date) over (partition by ticker) as last from bars) where {where})
select ticker, company_name, {VIEW} from windowed join stocks using (ticker) {cut}"""
    )


def _header(stocks: str, days: int) -> str:
    return f"""
, latest as (select ticker, max(trade_date) as last from bars group by ticker),
span as (
  select ticker, min(trade_date) as first_date, max(trade_date) as last_date, count(*) as n
  from bars join latest using (ticker) where trade_date >= last - {days} group by ticker)
select s.ticker, company_name,
       coalesce(first_date, coalesce(l.last, {AS_OF}) - {days}) as date_from,
       last_date as date_to, last_date as latest_trade_date,
       last_date is null or last_date < {EXPECTED} as is_stale, false as is_mock,
       'landing' as source, coalesce(n, 0) as n_bars
from {stocks} s left join latest l using (ticker) left join span using (ticker)"""


RESOLVED = f"""
latest as (select ticker, max(trade_date) as last from bars group by ticker),
resolved as (
  select r.request_id, upper(r.ticker) as ticker, company_name, date_to, row_limit,
         case when date_from is not null then date_from
              when timeframe = 'ALL' then null
              else coalesce(date_to, l.last, as_of) - case timeframe when '1M' then 31
                when '3M' then 93 when '6M' then 186 else 366 end end as start
  from requests r join stocks s on s.ticker = upper(r.ticker)
  left join latest l on l.ticker = upper(r.ticker)),
answer as (
  select q.request_id, company_name, row_limit, b.*,
         row_number() over (partition by request_id order by trade_date desc) as rn
  from resolved q join bars b on b.ticker = q.ticker
    and (start is null or trade_date >= start) and (date_to is null or trade_date <= date_to)),
kept as (select * from answer where row_limit is null or rn <= row_limit)"""

REQUEST_HEADER = f"""
, span as (
  select request_id, min(trade_date) as first_date, max(trade_date) as last_date, count(*) as n
  from kept group by request_id)
select request_id, ticker, company_name, coalesce(first_date, start) as date_from,
       coalesce(last_date, date_to) as date_to, last_date as latest_trade_date,
       last_date is null or last_date < {EXPECTED} as is_stale, false as is_mock,
       'landing' as source, coalesce(n, 0) as n_bars
from resolved left join span using (request_id)"""

MERGE = """,
arrivals as (
  select ticker, trade_date, open, high, low, close, previous, volume_shares, frequency,
         foreign_buy_shares, foreign_sell_shares, 0 as fresh from stored
  union all
  select ticker, trade_date, open, high, low, close, previous, volume_shares, frequency,
         foreign_buy_shares, foreign_sell_shares, 1 from restated),
newest_first as (
  select *, row_number() over day as place, min(fresh) over day as oldest,
         max(case when fresh = 0 then foreign_sell_shares end) over day as stored_sells
  from arrivals
  window day as (partition by ticker, trade_date order by fresh desc
                 rows between unbounded preceding and unbounded following))
select ticker, trade_date, {prices}, volume_shares, frequency, foreign_buy_shares,
  {sells} as foreign_sell_shares, 'fixture' as source,
  case when oldest = 0 then '{t0}' else '{t1}' end as ingested_at,
  case when oldest = 0 then '{t0}' else '{t1}' end as created_at,
  case when fresh = 1 then '{t1}' else '{t0}' end as updated_at
from newest_first where place = 1"""


def _merge(sells: str) -> str:
    times = {"t0": "2024-01-01 08:00:00", "t1": "2024-01-02 08:00:00"}
    return _with(BARS, UPSERT) + MERGE.format(prices=PRICE_DOUBLES, sells=sells, **times)


DAMAGE = """
parts as (
  select concat(ticker, '/', cast(year(trade_date) as varchar)) as payload_id,
         (cast(substr(ticker, 2) as bigint) + year(trade_date)) % 9 as kind, *
  from bars)"""

COUNTS = f"""
select ticker, 'succeeded' as status, count(*) as rows_received,
       count(*) filter (trade_date >= {CUT}) as rows_inserted,
       count(*) filter (trade_date < {CUT}) as rows_updated,
       cast(null as varchar) as error_message
from bars where trade_date >= {OVERLAP}"""


def _pull(where: str, n: int) -> str:
    return (
        _with(BARS)
        + f"""select ticker, trade_date, cast(close as double) as close from (
  select *, row_number() over (partition by ticker order by trade_date desc) as rn
  from bars where {where}) where rn <= {n}"""
    )


PARSED = f"""
select ticker, company_name, trade_date, {MONEY_DOUBLES}, volume_shares, frequency,
       foreign_buy_shares, foreign_sell_shares, {{volume}} as non_regular_volume_shares,
       cast(null as bigint) as non_regular_frequency, {{value}} as non_regular_value_idr,
       'landing' as source, cast(0 as bigint) as n_errors
from bars join stocks using (ticker)"""

SPARK_LINE = """
line as (
  select ticker, row_number() over (partition by ticker order by trade_date) - 1 as position,
         cast(close as double) as close,
         count(*) over (partition by ticker) as n,
         min(cast(close as double)) over (partition by ticker) as low,
         max(cast(close as double)) over (partition by ticker) as high
  from ranked join stocks using (ticker) where is_active and rn <= 30)"""

FRESH = f"""{EXPECTED} as expected_trade_date,
  last is null or last < {EXPECTED} as is_stale, false as is_mock,
  case when last is null or last < {EXPECTED} then 'STALE' else 'EOD CURRENT' end as label,
  case when last is null or last < {EXPECTED} then 'stale' else 'current' end as mode"""

ORACLE: dict[str, str] = {
    "watchlist_snapshot": _with(BARS, STOCKS, LATEST) + _watchlist("stocks"),
    "watchlist_stocks_without_bars": _with(BARS, CUSTOMER_STOCKS, LATEST)
    + _watchlist("customer_stocks"),
    "watchlist_search": _with(BARS, STOCKS, LATEST)
    + """select s.ticker, company_name, cast(close as double) as latest_close
from stocks s left join newest using (ticker)
where is_active and (contains(lower(ticker), 'r#00000000')
                     or contains(lower(company_name), 'r#00000000'))""",
    "watchlist_search_count": _with(STOCKS)
    + """select count(*) as n_symbols from stocks
where contains(lower(ticker), 's1') or contains(lower(company_name), 's1')""",
    "sparkline_points": _with(BARS, STOCKS, LATEST, SPARK_LINE)
    + "select ticker, position, close from line",
    "sparkline_normalized": _with(BARS, STOCKS, LATEST, SPARK_LINE)
    + """select ticker, position as idx, round(position / cast(n - 1 as double), 6) as position,
  round((close - low) / case when high = low then 1 else high - low end, 6) as level
from line where n >= 2""",
    "sparkline_range": _with(BARS, STOCKS, LATEST, SPARK_LINE)
    + """select distinct ticker, low, high,
  round(case when high = low then 1 else high - low end, 4) as spread from line""",
    "sparkline_tail": _with(BARS, CUSTOMER_STOCKS, LATEST)
    + """select s.ticker, max(case when rn = 1 then cast(close as double) end) as last_close,
  count(rn) as n_tail, max(cast(close as double)) as tail_high
from customer_stocks s left join (select * from ranked where rn <= 5) r using (ticker)
where is_active group by s.ticker""",
    "latest_quote": _with(BARS, LATEST)
    + f"""select ticker, trade_date, cast(close as double) as close,
  cast(previous as double) as previous, cast(high as double) as high,
  cast(low as double) as low, volume_shares, frequency,
  cast(close - previous as double) as change, {PERCENT} as change_percent,
  {DIRECTION} as direction from newest""",
    "daily_change": _with(BARS)
    + f"""select ticker, trade_date, cast(close - previous as double) as change,
  {PERCENT} as change_percent, {DIRECTION} as direction from bars""",
    "history_1m": _history("trade_date >= last - 31"),
    "history_3m": _history("trade_date >= last - 93"),
    "history_6m_all": _history("trade_date >= last - 186"),
    "history_1y": _history("trade_date >= last - 366"),
    "history_all": _history("true"),
    "history_limit_n": _history("trade_date >= last - 366", limit=5),
    "history_from_to": _history("trade_date between date '1998-03-01' and date '1998-06-30'"),
    "history_to_anchor": _history(
        "trade_date <= date '1999-12-31' and trade_date >= date '1999-12-31' - 93"
    ),
    "history_header": _with(BARS, STOCKS) + _header("stocks", 31),
    "history_header_without_bars": _with(BARS, CUSTOMER_STOCKS) + _header("customer_stocks", 93),
    "history_requests": _with(BARS, STOCKS, REQUESTS, RESOLVED)
    + f"select request_id, ticker, company_name, {VIEW} from kept",
    "history_requests_header": _with(BARS, STOCKS, REQUESTS, RESOLVED) + REQUEST_HEADER,
    "history_not_found": _with(STOCKS, REQUESTS)
    + """select request_id, upper(ticker) as ticker, timeframe from requests r
where not exists (select 1 from stocks s where s.ticker = upper(r.ticker))""",
    "result_window_3m": _with(BARS)
    + """select ticker, trade_date, cast(close as double) as close
from (select *, max(trade_date) over (partition by ticker) as last from bars)
where trade_date >= last - 93""",
    "intraday_window_1m": _with(INTRADAY)
    + f"""select ticker, trade_date, {MONEY_DOUBLES}, volume_shares, frequency
from (select *, max(trade_date) over (partition by ticker) as last from intraday)
where trade_date >= last - 31""",
    "frequency_indicator": _with(BARS)
    + f"select ticker, trade_date, round({RAW}, 6) as raw from bars",
    "frequency_indicator_lots": _with(BARS)
    + f"select ticker, trade_date, round({RAW_LOTS}, 6) as raw from bars",
    "frequency_log10_scaled": _with(BARS)
    + f"select ticker, trade_date, {LOG} as value from bars where volume_shares > 0",
    "indicator_panel": _with(BARS)
    + f"""select ticker, trade_date, 'volume' as indicator,
  cast(volume_shares as double) as value,
  case when close >= open then 'up' else 'down' end as direction from bars
union all
select ticker, trade_date, 'frequency-analyzer', {LOG}, null from bars
where volume_shares > 0""",
    "indicator_panel_default": _with(BARS)
    + """select ticker, trade_date, 'volume' as indicator,
  cast(volume_shares as double) as value,
  case when close >= open then 'up' else 'down' end as direction from bars""",
    "volume_direction": _with(BARS)
    + """select ticker, trade_date, cast(volume_shares as double) as value,
  case when close >= open then 'up' else 'down' end as direction from bars""",
    "candles": _with(BARS)
    + """select ticker, trade_date, cast(open as double) as open, cast(high as double) as high,
  cast(low as double) as low, cast(close as double) as close from bars""",
    "close_line": _with(BARS)
    + "select ticker, trade_date, cast(close as double) as value from bars",
    "latest_trade_date": "select max(cast(l_shipdate as date)) as latest_trade_date from lineitem",
    "latest_trade_date_by_ticker": """
select concat('S', cast(l_suppkey as varchar)) as ticker,
       max(cast(l_shipdate as date)) as latest_trade_date from lineitem group by 1""",
    "freshness_status": _with(BARS, STOCKS, RUNS)
    + f""", final as (select max(trade_date) as last from bars),
newest_run as (select * from runs order by started_at desc, run_id desc limit 1)
select last as latest_trade_date, {FRESH}, 'landing' as provider, 'parquet' as repository,
       (select provider from newest_run) as ingestion_provider,
       (select status from newest_run) as ingestion_status,
       (select finished_at from newest_run) as ingestion_finished_at,
       (select rows_received from newest_run) as ingestion_rows_received
from final""",
    "freshness_by_ticker": _with(BARS, CUSTOMER_STOCKS)
    + f"""select ticker, last as latest_trade_date, {FRESH} from customer_stocks
left join (select ticker, max(trade_date) as last from bars group by ticker) using (ticker)""",
    "freshness_intraday": """
select concat('U', cast(user_id as varchar)) as ticker,
       max(cast(ts as date)) as latest_trade_date, date '2024-01-26' as expected_trade_date,
       max(cast(ts as date)) < date '2024-01-26' as is_stale, true as is_mock,
       'MOCK DATA' as label, 'mock' as mode
from events group by 1""",
    "summary_as_of": _with(BARS, STOCKS)
    + f"""select ticker, company_name, trade_date, {MONEY_DOUBLES}, volume_shares, frequency,
  foreign_buy_shares, foreign_sell_shares
from (select *, row_number() over (partition by ticker order by trade_date desc) as rn
      from bars where trade_date <= date '1998-09-05') join stocks using (ticker) where rn = 1""",
    "stock_detail": _with(STOCKS, CUSTOMER_STOCKS)
    + """select ticker, company_name, sector, subsector from stocks s
where exists (select 1 from customer_stocks c where c.ticker = s.ticker)""",
    "bars_with_stock": _with(BARS, STOCKS)
    + """select ticker, trade_date, company_name, sector, subsector,
  cast(close as double) as close from bars join stocks using (ticker)""",
    "bars_of_active_stocks": _with(BARS, STOCKS)
    + """select ticker, trade_date, cast(close as double) as close from bars
where ticker in (select ticker from stocks where is_active)""",
    "source_pull_window": _pull(
        "trade_date between date '1998-03-01' and date '1999-12-31'", 40
    ),
    "source_default_pull": _with(BARS)
    + "select ticker, trade_date, cast(close as double) as close from bars",
    "provider_conversions": """
select o_orderkey, cast(o_orderdate as date) as iso_date, cast(o_orderdate as date) as basic_date,
  cast(null as date) as other_date, o_custkey as whole, cast(null as bigint) as not_whole,
  o_totalprice as price,
  case when o_orderstatus not in ('P', 'F') then cast(o_custkey as double) end as finite,
  substr(o_orderpriority, 1, 4) as label from orders""",
    "quality_reasons": _with(BARS, DIRTY)
    + """select ticker, trade_date, cast(copy as bigint) as copy, reasons from assessed
where reasons <> ''""",
    "quality_valid": _with(BARS, DIRTY)
    + """select ticker, trade_date, cast(copy as bigint) as copy, cast(close as double) as close,
  volume_shares, frequency from assessed where reasons = ''""",
    "quality_summary": _with(BARS, DIRTY)
    + """select reason, count(*) as n_rows from (
  select unnest(string_split(reasons, ',')) as reason from assessed where reasons <> '')
group by reason""",
    "duplicate_keys": _with(BARS, DIRTY)
    + """select ticker, trade_date, count(*) as n_rows from spoilt
group by ticker, trade_date having count(*) > 1""",
    "orphan_bars": _with(BARS, DIRTY, STOCKS)
    + """select ticker, trade_date, cast(copy as bigint) as copy from spoilt
where ticker not in (select ticker from stocks)""",
    "request_violations": _with(REQUESTS)
    + """select request_id, reasons from (
  select request_id, concat_ws(',',
    case when request_id % 17 = 0 then 'bad_ticker' end,
    case when request_id % 19 = 0 then 'unknown_timeframe' end,
    case when (row_limit - 3) * 400 not between 1 and 2000
         then 'row_limit_out_of_range' end) as reasons from requests) where reasons <> ''""",
    "history_rejected_requests": _with(REQUESTS)
    + """select request_id, reasons from (
  select request_id, concat_ws(',',
    case when request_id % 17 = 0 then 'bad_ticker' end,
    case when request_id % 19 = 0 then 'unknown_timeframe' end,
    case when (row_limit - 3) * 400 not between 1 and 2000
         then 'row_limit_out_of_range' end) as reasons from requests) where reasons <> ''""",
    "stock_violations": """
select concat('S', cast(c_custkey as varchar)) as ticker, 'blank_company_name' as reasons
from customer where c_custkey % 5 = 0 or c_custkey % 7 = 0""",
    "run_log_violations": """
select run_id, reasons from (
  select o_orderkey as run_id, concat_ws(',',
    case when substr(o_orderpriority, 1, 1) = '5' then 'blank_provider' end,
    case when o_orderstatus = 'P' then 'unknown_status' end,
    case when o_custkey < 5 then 'rows_received_negative' end,
    case when o_custkey < 7 then 'rows_inserted_negative' end,
    case when substr(o_orderpriority, 1, 1) = '1' then 'finished_before_started' end) as reasons
  from orders) where reasons <> ''""",
    "upsert_merge": _merge("foreign_sell_shares"),
    "upsert_coalesce_nulls": _merge("coalesce(foreign_sell_shares, stored_sells)"),
    "upsert_idempotent": _merge("foreign_sell_shares"),
    "upsert_stats": _with(BARS, UPSERT)
    + """select r.ticker, cast(sum(copies) as bigint) as rows_received,
  count(*) filter (s.ticker is null) as rows_inserted,
  cast(sum(copies) as bigint) - count(*) filter (s.ticker is null) as rows_updated
from restated r left join stored s on s.ticker = r.ticker and s.trade_date = r.trade_date
group by r.ticker""",
    "upsert_new_keys": _with(BARS, UPSERT)
    + """select ticker, trade_date from restated
except select ticker, trade_date from stored""",
    "upsert_existing_keys": _with(BARS, UPSERT)
    + """select ticker, trade_date from restated
intersect select ticker, trade_date from stored""",
    "union_last_wins": _with(BARS, UPSERT)
    + """select ticker, trade_date, volume_shares from restated
union all
select ticker, trade_date, volume_shares from stored s where not exists (
  select 1 from restated r where r.ticker = s.ticker and r.trade_date = s.trade_date)""",
    "stock_upsert": _with(STOCKS, CUSTOMER_STOCKS)
    + """select coalesce(c.ticker, s.ticker) as ticker,
  coalesce(c.company_name, s.company_name) as company_name,
  case when c.ticker is not null then c.sector else s.sector end as sector,
  case when c.ticker is null then s.subsector end as subsector,
  c.ticker is not null or s.is_active as is_active,
  case when s.ticker is not null then '2024-01-01 08:00:00' else '2024-01-02 08:00:00' end
    as created_at,
  case when c.ticker is not null then '2024-01-02 08:00:00' else '2024-01-01 08:00:00' end
    as updated_at
from stocks s full outer join customer_stocks c on c.ticker = s.ticker""",
    "cascade_delete": _with(BARS, STOCKS)
    + """select ticker, trade_date, cast(close as double) as close from bars
where ticker not in (select ticker from stocks where not is_active)""",
    "payload_history_parse": _with(BARS, STOCKS)
    + PARSED.format(volume="cast(null as bigint)", value="cast(null as double)"),
    "payload_summary_parse": _with(BARS, STOCKS)
    + PARSED.format(volume="volume_shares // 7", value="cast(value_idr as double)"),
    "payload_rejects": _with(BARS, DAMAGE)
    + """select distinct payload_id, case kind when 0 then 'malformed_json'
  when 1 then 'not_an_object' when 2 then 'data_not_an_object' when 3 then 'unit_not_shares'
  when 4 then 'items_not_a_list' else 'bad_ticker' end as reason
from parts where kind <= 5""",
    "payload_survivors": _with(BARS, DAMAGE)
    + """select payload_id, trade_date, cast(close as double) as close
from parts where kind > 5""",
    "ingest_run_log": _with(BARS, STOCKS, RUNS) + "select * from runs",
    "latest_ingestion": _with(BARS, STOCKS, RUNS)
    + """select provider, status, rows_received, finished_at
from runs order by started_at desc, run_id desc limit 1""",
    "batch_ingest": _with(BARS) + COUNTS + " group by ticker",
    "batch_ingest_whole_payloads": _with(BARS)
    + f""", counted as ({COUNTS}
    and not (ticker like '%0' and year(trade_date) = 2000) group by ticker),
spoilt as (select distinct ticker from bars where ticker like '%0' and year(trade_date) = 2000)
select ticker, case when s.ticker is null then 'succeeded' else 'failed' end as status,
       case when s.ticker is null then rows_received else 0 end as rows_received,
       case when s.ticker is null then rows_inserted else 0 end as rows_inserted,
       case when s.ticker is null then rows_updated else 0 end as rows_updated,
       case when s.ticker is not null then 'volume_shares_negative' end as error_message
from counted full outer join spoilt s using (ticker)""",
    "seed_load": _with(BARS)
    + f"""select 'seed' as job_id, 'succeeded' as status, count(*) as rows_received,
  cast(0 as bigint) as rows_inserted, cast(0 as bigint) as rows_updated
from bars""",
    "ingest_asked_for": _with(BARS, DAMAGE)
    + """select distinct payload_id, case kind when 0 then 'malformed_json'
  when 1 then 'not_an_object' when 2 then 'data_not_an_object' when 3 then 'unit_not_shares'
  when 4 then 'items_not_a_list' else 'bad_ticker' end as reason
from parts where kind <= 5""",
    "symbol_history": _with(BARS, STOCKS)
    + f"""select ticker, company_name, {VIEW} from bars join stocks using (ticker)
where ticker = (select min(ticker) from stocks)""",
    "stored_scan": _with(BARS)
    + """select ticker, trade_date, cast(close as double) as close,
  cast(year(trade_date) as bigint) as trade_year
from bars where trade_date between date '1998-03-01' and date '1998-06-30'""",
    "stored_watchlist": _with(BARS, STOCKS, LATEST) + _watchlist("stocks"),
    "stored_history_3m": _with(BARS, STOCKS)
    + f""", windowed as (
  select * from (select *, max(trade_date) over (partition by ticker) as last from bars)
  where trade_date >= last - 93)
select ticker, company_name, {VIEW} from windowed join stocks using (ticker)""",
    "stored_history_requests": _with(BARS, STOCKS, REQUESTS, RESOLVED) + REQUEST_HEADER,
    "stored_freshness": _with(BARS)
    + f"""select max(trade_date) as latest_trade_date, {EXPECTED} as expected_trade_date,
  max(trade_date) < {EXPECTED} as is_stale, false as is_mock,
  case when max(trade_date) < {EXPECTED} then 'STALE' else 'EOD CURRENT' end as label,
  case when max(trade_date) < {EXPECTED} then 'stale' else 'current' end as mode,
  'landing' as provider, 'parquet' as repository, 'landing' as ingestion_provider,
  'succeeded' as ingestion_status, '2024-01-01 08:00:00' as ingestion_finished_at,
  count(*) as ingestion_rows_received from bars""",
    "stream_ingest": _with(BARS)
    + f"""select ticker, trade_date, {PRICE_DOUBLES},
  case when trade_date >= {OVERLAP} then volume_shares + 100 else volume_shares end
    as volume_shares, frequency, 'landing' as source from bars""",
    "ingest_snapshot_read": _with(BARS)
    + f""", moments as (select unnest(['before', 'stopped', 'after']) as moment),
seen as (
  select moment, ticker, trade_date,
         volume_shares + case when moment = 'after' and trade_date >= {OVERLAP} then 100 else 0 end
           as volume_shares
  from bars, moments where moment = 'after' or trade_date < {CUT}),
fed as (select distinct ticker from bars where trade_date >= {OVERLAP})
select moment, s.ticker, count(*) as n_bars, cast(sum(volume_shares) as bigint) as volume_shares,
       case when fed.ticker is null or moment = 'before' then null
            when moment = 'stopped' then 'failed' else 'succeeded' end as status
from seen s left join fed on fed.ticker = s.ticker group by moment, s.ticker, fed.ticker""",
    "stored_cascade_delete": _with(BARS, STOCKS)
    + """select ticker, company_name, n_bars, latest_trade_date, least(n_bars, 30) as n_recent
from stocks left join (
  select ticker, count(*) as n_bars, max(trade_date) as latest_trade_date from bars group by ticker)
using (ticker) where is_active""",
    "maintained_watchlist": _with(RESTATED, STOCKS, MERGED_STOCKS, LATEST) + _watchlist("merged_stocks"),
    "maintained_latest_dates": _with(RESTATED)
    + "select ticker, max(trade_date) as latest_trade_date from bars group by ticker",
    "run_log_compacted": _with(BARS, STOCKS, RUNS) + "select * from runs",
    "stored_symbol_lookup": _with(BARS, STOCKS)
    + """select ticker, trade_date, cast(close as double) as close, volume_shares from bars
where ticker = (select max(ticker) from stocks) and trade_date >= date '1998-03-01'""",
    "indicator_rolling_zscore": _with(BARS, GAPPED)
    + """, framed as (
  select *, avg(raw) over frame as m, stddev_pop(raw) over frame as d, count(raw) over frame as n,
         min(raw) over frame as low, max(raw) over frame as high
  from gapped
  window frame as (partition by ticker order by trade_date rows between 119 preceding and current row))
select ticker, trade_date, round(raw, 6) as raw,
       case when n >= 20 then round(case when low = high then low else m end, 6) end as mean,
       case when n >= 20 then round(case when low = high then 0 else d end, 6) end as deviation,
       case when n >= 20 and low < high then round((raw - m) / d, 6) end as zscore
from framed""",
    "indicator_rolling_percentile": _with(BARS, GAPPED)
    + """, placed as (
  select *, row_number() over (partition by ticker order by trade_date) as place from gapped)
select a.ticker, a.trade_date, round(a.raw, 6) as raw,
       case when a.raw is not null and count(b.raw) >= 20
            then round(100.0::double * count(*) filter (b.raw <= a.raw) / count(b.raw), 6) end as percentile
from placed a join placed b on a.ticker = b.ticker and b.place between a.place - 119 and a.place
group by a.ticker, a.trade_date, a.raw""",
    "asof_requests": _with(BARS)
    + """, asked as (
  select o_orderkey as request_id, concat('S', cast(o_custkey as varchar)) as ticker,
         cast(o_orderdate as date) as day from orders)
select request_id, a.ticker, day, trade_date, cast(close as double) as close, volume_shares
from asked a asof left join bars b on a.ticker = b.ticker and a.day >= b.trade_date""",
    "missing_sessions": _with(BARS)
    + """, calendar as (
  select trade_date, row_number() over (order by trade_date) as session
  from (select distinct trade_date from bars)),
placed as (
  select ticker, trade_date as last_traded, session,
         lead(trade_date) over (partition by ticker order by trade_date) as next_traded,
         coalesce(lead(session) over (partition by ticker order by trade_date),
                  (select max(session) + 1 from calendar)) as next_session
  from bars join calendar using (trade_date))
select ticker, last_traded, next_traded, f.trade_date as first_missed, l.trade_date as last_missed,
       next_session - p.session - 1 as n_missed
from placed p join calendar f on f.session = p.session + 1
join calendar l on l.session = next_session - 1
where next_session - p.session > 1""",
}
