"""SQL text of the domain tables, used by the defining SQL of the queries."""

EV = """ev as (
 select event_id, user_id, event_type, value, epoch_us(ts) as ts_us,
        cast(regexp_extract(props, '"k": (\\d+)', 1) as bigint) as k
 from events)"""

QUOTES = EV + """, quotes as (
 select 'm' || user_id as market_slug, event_id, ts_us,
        2e-2 + 96e-2 * value / 500e0 as mid, 1e-2 + 1e-2 * (event_id % 5) as spread,
        (2e-2 + 96e-2 * value / 500e0) - (1e-2 + 1e-2 * (event_id % 5)) / 2e0 as best_bid,
        (2e-2 + 96e-2 * value / 500e0) + (1e-2 + 1e-2 * (event_id % 5)) / 2e0 as best_ask, k
 from ev where event_type in ('view', 'click'))"""

TRADES_ONLY = """trades as (
 select 'm' || user_id as market_slug, event_id, ts_us,
        2e-2 + 96e-2 * value / 500e0 as price, k as size,
        case when event_type = 'purchase' then 'BUY' else 'SELL' end as taker_side
 from ev where event_type in ('purchase', 'signup'))"""

TRADES = EV + ", " + TRADES_ONLY

QT = QUOTES + ", " + TRADES_ONLY

GAPS_ONLY = """gaps as (
 select event_id, 'm' || user_id as market_slug, ts_us as start_us,
        ts_us + k * 60000000 as end_us
 from ev where event_type = 'error')"""

GAPS = EV + ", " + GAPS_ONLY

SNAP = """snap0 as (
 select 'm' || l_partkey as market_id, p_brand as event_cluster, p_type as category,
        l_orderkey || '|' || l_linenumber || '|' || l_suppkey || '|'
          || cast(round(l_extendedprice * 100) as bigint) as rid,
        epoch_us(l_shipdate) as ts_us,
        (l_quantity - 5e-1) / 50e0 as model_p,
        2e-2 + 9e-1 * (l_partkey % 89) / 89e0 as bid,
        (2e-2 + 9e-1 * (l_partkey % 89) / 89e0) + 1e-2 + l_discount / 2e0 as ask,
        l_quantity as bid_size, 51e0 - l_quantity as ask_size,
        l_extendedprice as liquidity, l_extendedprice * l_quantity / 100e0 as volume,
        l_quantity * l_quantity as hours, l_tax as fee_rate, l_linestatus = 'O' as filled,
        case l_returnflag when 'R' then 1 when 'A' then 0 end as outcome
 from lineitem join part on l_partkey = p_partkey),
snap as (
 select *, (bid + ask) / 2e0 as mid, ask - bid as spread,
        ts_us + cast(hours * 36e8 as bigint) as resolved_us,
        model_p - ask - fee_rate * ask * (1e0 - ask) as net_edge
 from snap0)"""

FC = """known as (
 select l_partkey as pk, max(epoch_us(l_shipdate)) + 30 * 86400000000 as label_us
 from lineitem group by 1),
fc as (
 select 'm' || l_partkey as market_id, p_brand as cluster, epoch_us(l_shipdate) as predicted_us,
        l_orderkey || '|' || l_linenumber || '|' || l_suppkey || '|'
          || cast(round(l_extendedprice * 100) as bigint) as rid,
        case when l_partkey % 3 < 2 then label_us end as label_known_us,
        (l_quantity - 5e-1) / 50e0 as p,
        case l_partkey % 3 when 0 then 0 when 1 then 1 end as outcome
 from lineitem join part on l_partkey = p_partkey join known on pk = l_partkey)"""

# One row per side and level, numbered from the best level.
LEVELS = QUOTES + """, lv as (
 select * from (
  select market_slug, event_id, ts_us, mid, 'bid' as side, i,
         round(best_bid - 1e-2 * i, 6) as price, 1e0 + (event_id + i) % 50 as size
  from quotes, range(5) r(i)
  union all
  select market_slug, event_id, ts_us, mid, 'ask', i,
         round(best_ask + 1e-2 * i, 6), 1e0 + (event_id + i + 7) % 50
  from quotes, range(5) r(i)) where price > 0 and price < 1)"""

FILLS = """fills as (
 select l_orderkey as order_id, 'm' || l_partkey as token_id, 's' || l_suppkey as strategy,
        l_orderkey || '|' || l_linenumber || '|' || l_suppkey || '|'
          || cast(round(l_extendedprice * 100) as bigint) as rid,
        epoch_us(l_shipdate) as ts_us,
        case when l_linestatus = 'O' then 'BUY' else 'SELL' end as side,
        l_quantity as shares, (l_quantity - 5e-1) / 50e0 as price,
        (l_quantity - 5e-1) / 50e0 * l_quantity as notional, l_tax as fee_rate,
        l_discount as slippage,
        case l_returnflag when 'R' then 1e0 - (l_quantity - 5e-1) / 50e0
             when 'A' then -((l_quantity - 5e-1) / 50e0) else 0e0 end as pnl_per_share
 from lineitem)"""

LOAD = """load_rows as (
 select cast(floor(epoch_us(o_orderdate) / 86400000000) as bigint) as day, o_orderkey % 24 as hour,
        o_orderkey as doc_id, o_totalprice as mw
 from orders)"""

DOCS = """docs as (
 select doc_id, text, lang, source,
        1704067200000000 + doc_id * 600000000 as published_us,
        1704067200000000 + doc_id * 600000000 + (n_chars % 977) * 1000000 as retrieved_us
 from documents)"""
