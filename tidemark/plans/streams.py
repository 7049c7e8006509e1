"""Batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import books, drift, pairs
from tidemark.operators import sequences as sq
from tidemark.operators.asof import asof_join
from tidemark.operators.ordered import nearest_rank, running
from tidemark.plans.bindings import DOCS, EV, QT
from tidemark.plans.feeds import RAW
from tidemark.plans.flow import CORR, PAIRS, daily_returns
from tidemark.plans.market import BOOK
from tidemark.plans.pit import DAY, HOUR
from tidemark.plans.registry import query, r6, s6
from tidemark.plans.scores import six
from tidemark.sources import rawlog
from tidemark.sources import tables as tb

SPACE = 48 * HOUR
PH_LIMIT = 300.0
SPACED = """ek as (select user_id || '|' || event_type as ky, ts_us, event_id from ev),
acc(ky, t) as (select ky, min(ts_us) from ek group by 1 union all
 select a.ky, (select min(e.ts_us) from ek e where e.ky = a.ky and e.ts_us >= a.t + {w}) from acc a where a.t is not null)"""


@query("t01_message_dedup", f"""with recursive {EV}, {SPACED.format(w=SPACE)} select event_id from ek join acc on ek.ky = acc.ky and ek.ts_us = acc.t""")
def t01(spark, sf):
    """First message of each payload; repeats inside the window after it are dropped."""
    ev = tb.event_rows(spark, sf).select("event_id", "ts_us", F.md5(F.concat_ws("|", "user_id", "event_type")).alias("payload_hash"))
    return sq.accept_spaced(ev, ["payload_hash"], "ts_us", "event_id", SPACE).where("accepted").select("event_id")


@query("t02_claim_dedup", f"""with recursive {DOCS}, ek as (select source || lang as ky, retrieved_us as ts_us, doc_id from docs),
acc(ky, t) as (select ky, min(ts_us) from ek group by 1 union all select a.ky, (select min(e.ts_us) from ek e where e.ky = a.ky and e.ts_us >= a.t + {6 * HOUR}) from acc a where a.t is not null)
select doc_id, exists (select 1 from acc where acc.ky = ek.ky and acc.t = ek.ts_us) as accepted from ek""")
def t02(spark, sf):
    claims = tb.documents(spark, sf).select("doc_id", "retrieved_us", F.concat("source", "lang").alias("claim_id"))
    return sq.accept_spaced(claims, ["claim_id"], "retrieved_us", "doc_id", 6 * HOUR).select("doc_id", "accepted")


@query("t04_late_book_rejection", f"""with {EV}, r as (select *, max(ts_us) over (partition by user_id order by ts_us + k * 600000000, event_id rows between unbounded preceding and 1 preceding) mx from ev)
select event_id, ts_us < mx as late from r where mx is not null""")
def t04(spark, sf):
    ev = tb.event_rows(spark, sf).withColumn("arrived", F.col("ts_us") + F.col("k") * 600_000_000)
    out = running(ev, ["user_id"], "arrived", ["event_id"], {"mx": ("max_before", F.col("ts_us"))})
    return out.where("mx is not null").select("event_id", (F.col("ts_us") < F.col("mx")).alias("late"))


WS = EV + """, ws as (select event_id, 'm' || user_id as ticker, ts_us, k, case event_type when 'view' then 'snapshot' else 'delta' end as kind,
  ts_us // 86400000000 as session, row_number() over (partition by ts_us // 86400000000 order by ts_us, event_id) as rn from ev where event_type in ('view', 'click')),
wsq as (select *, rn + rn // 97 as seq from ws),
wl as (select *, lag(session) over w as ps, lag(seq) over w as pq from wsq window w as (order by ts_us, event_id)),
we as (select *, coalesce(ps = session and seq <> pq + 1, false) as sequence_gap, sum(case when ps is not null and (ps <> session or seq <> pq + 1) then 1 else 0 end) over (order by ts_us, event_id) as epoch from wl),
wg as (select *, sum(case kind when 'snapshot' then 1 else 0 end) over (partition by ticker order by ts_us, event_id) as segment from we)"""


def ws_rows(spark, sf):
    """Feed messages: a view is a five-level snapshot, a click a delta of ``k - 50`` on a yes level."""
    c = F.col
    ev = tb.event_rows(spark, sf).where("event_type in ('view', 'click')").select(
        "event_id", F.concat(F.lit("m"), c("user_id")).alias("ticker"), "ts_us", "k",
        F.when(c("event_type") == "view", "snapshot").otherwise("delta").alias("kind"),
        F.floor(c("ts_us") / F.lit(DAY)).cast("bigint").alias("session"), F.lit("c1").alias("connection"),
    )
    ev = running(ev, ["session"], "ts_us", ["event_id"], {"rn": ("count", None)})
    steps = F.sequence(F.lit(0), F.lit(4))

    def prices(top):
        return F.transform(steps, lambda i: (F.lit(top) - i) / F.lit(100.0))

    def sizes(shift):
        return F.transform(steps, lambda i: (F.lit(1.0) + (c("event_id") + i + F.lit(shift)) % 50))

    return ev.select(
        "event_id", "ticker", "ts_us", "kind", "session", "connection",
        (c("rn") + F.floor(c("rn") / 97)).cast("bigint").alias("seq"),
        prices(40).alias("yes_px"), sizes(0).alias("yes_sz"), prices(55).alias("no_px"), sizes(7).alias("no_sz"),
        F.lit("yes").alias("side"), ((F.lit(40) - c("k") % 5) / F.lit(100.0)).alias("price"),
        (c("k") - F.lit(50)).cast("double").alias("delta"),
    )


@query("w17_sequence_gap_epochs", f"""with {WS} select event_id, sequence_gap, cast(epoch as bigint) as epoch from we""")
def w17(spark, sf):
    return sq.gap_epochs(ws_rows(spark, sf), ["connection"], "ts_us", ["event_id"]).select("event_id", "sequence_gap", "epoch")


LEVEL_FOLD = ", ".join(
    f"""list_reduce(list_concat([case when kind = 'snapshot' then 1e0 + (event_id + {i}) % 50 else first_value(1e0 + (event_id + {i}) % 50) over g end],
 coalesce(list(k - 50e0) filter (where kind = 'delta' and k % 5 = {i}) over g, [])), lambda a, x: case when a + x < 0 then a else a + x end) as s{i}"""
    for i in range(5)
)
TOPS = " ".join(f"when s{i} > 0 then {40 - i} / 100e0" for i in range(5))


@query("t05_book_reconstruction", f"""with {WS}, b as (select *, {LEVEL_FOLD}, first_value(epoch) over g as e0, first_value(event_id) over g as snap_id from wg where segment > 0
 window g as (partition by ticker, segment order by ts_us, event_id rows between unbounded preceding and current row)),
c as (select *, case {TOPS} end as bid, s0 + s1 + s2 + s3 + s4 as bd, (select sum(1e0 + (snap_id + i + 7) % 50) from range(5) r(i)) as ad,
 lag(s0 + s1 + s2 + s3 + s4) over (partition by ticker, segment order by ts_us, event_id) as pbd from b),
d as (select *, kind = 'delta' and k <> 50 and bd = pbd as rejected from c),
e as (select *, max(cast(rejected as int)) over (partition by ticker, segment order by ts_us, event_id) = 1 as dirty from d)
select event_id, ticker, {s6('bid')} as best_bid, {s6('1e0 - 55e-2')} as best_ask, {s6('bd')} as bid_depth, {s6('ad')} as ask_depth, {s6('(bid + (1e0 - 55e-2)) / 2')} as mid,
 {s6('case when bid is not null then ((1e0 - 55e-2) * bd + bid * ad) / (bd + ad) end')} as microprice, {s6('(bd - ad) / (bd + ad)')} as imbalance, epoch = e0 and not dirty as gap_clean, rejected from e""")
def t05(spark, sf):
    """Rebuild of a feed that delivers some frames twice."""
    rows = ws_rows(spark, sf)
    return six(books.rebuild_books(rows.unionByName(rows.where("event_id % 13 = 0")), ["connection"], "ts_us"))


@query("t09_page_hinkley_drift", f"""with recursive {EV}, o as (select user_id as key, value as x, row_number() over (partition by user_id order by ts_us, event_id) as i from ev),
ph(key, i, n, total, cum, low, drift) as (
 select key, i - 1, 0, 0e0, 0e0, 0e0, false from o where i = 1 union all
 select key, i, case when hit then 0 else n end, case when hit then 0e0 else total end, case when hit then 0e0 else cum end, case when hit then 0e0 else low end, hit from (
  select *, n >= 30 and cum - low > {PH_LIMIT} as hit from (select *, case when n >= 30 then least(low0, cum) else low0 end as low from (
   select p.key, o.i, p.n + 1 as n, p.total + o.x as total, p.low as low0, case when p.n + 1 >= 30 then p.cum + o.x - (p.total + o.x) / (p.n + 1) - 5e-3 else p.cum end as cum
   from ph p join o on o.key = p.key and o.i = p.i + 1))))
select key, count(*) as n, count(*) filter (where drift) as drifts from ph where i > 0 group by 1""")
def t09(spark, sf):
    """Page-Hinkley test of every market's event values."""
    ev = tb.event_rows(spark, sf).select(F.col("user_id").alias("key"), "ts_us", "event_id", "value")
    out = drift.detect_changes(ev, "key", "ts_us", ["event_id"], "value", lambda x, s: drift.page_hinkley(x, s, PH_LIMIT), lambda: drift.START)
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("drift").alias("drifts"))


@query("t09_adaptive_window_drift")
def t09b(spark, sf):
    """Adaptive-window test of every market's event values; tests compare it with a plain window."""
    ev = tb.event_rows(spark, sf).select(
        F.col("user_id").alias("key"), "ts_us", "event_id", (F.col("value") / F.lit(500.0)).alias("v")
    )
    out = drift.detect_changes(ev, "key", "ts_us", ["event_id"], "v", drift.adaptive_window, list)
    return out.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if("drift").alias("drifts"))


@query("t10_provider_watermark", f"""with {DOCS} select source, max(published_us) as watermark_us, count(*) as n from docs group by 1""")
def t10(spark, sf):
    return tb.documents(spark, sf).groupBy("source").agg(
        F.max("published_us").alias("watermark_us"), F.count(F.lit(1)).alias("n")
    )


@query("t11_receive_lag_statistics", f"""with {EV}, l as (select (ts_us + k * 1000000) // {6 * HOUR} as win, k, row_number() over (partition by (ts_us + k * 1000000) // {6 * HOUR} order by k) rn,
 count(*) over (partition by (ts_us + k * 1000000) // {6 * HOUR}) n from ev)
select win, max(n) as n, {s6('avg(k)')} as mean_lag, max(k) filter (where rn = least(n, floor(n * 95e-2) + 1)) as p95 from l group by 1""")
def t11(spark, sf):
    win = F.floor((F.col("ts_us") + F.col("k") * 1_000_000) / F.lit(6 * HOUR)).cast("bigint")
    rows = tb.event_rows(spark, sf).select(win.alias("win"), "k")
    ranks = nearest_rank(rows, ["win"], "k", {"p95": lambda n: F.least(n, F.floor(n * F.lit(0.95)) + 1)})
    return ranks.join(rows.groupBy("win").agg(r6(F.avg("k")).alias("mean_lag")), "win")


@query("t12_stream_table_reconciliation", f"""with {BOOK}, lo as (select market_slug, arg_max(event_id, (ts_us, event_id)) e from bb where ts_us <= 1706400000000000 group by 1),
re as (select market_slug, arg_max(event_id, (ts_us, event_id)) e from bb group by 1),
a as (select lo.market_slug, l.side, l.price, l.size from lo join lv l on l.event_id = lo.e), b as (select re.market_slug, l.side, l.price, l.size from re join lv l on l.event_id = re.e),
d as (select coalesce(a.market_slug, b.market_slug) as market_slug, abs(coalesce(a.size, 0) - coalesce(b.size, 0)) as df from a full join b on a.market_slug = b.market_slug and a.side = b.side and a.price = b.price)
select market_slug, count(*) filter (where df > 0) as differing, max(df) = 0 as matches from d group by 1""")
def t12(spark, sf):
    from tidemark.streaming.jobs import compare_books

    books = tb.books(spark, sf)
    at = F.struct("ts_us", "event_id")

    def latest(rows):
        return rows.groupBy("market_slug").agg(F.max_by(F.struct("bids", "asks"), at).alias("b")).select("market_slug", "b.*")

    return compare_books(latest(books.where("ts_us <= 1706400000000000")), latest(books))


@query("t13_fill_quote_match", f"""with {QT} select t.event_id, count(*) as quotes, arg_max(q.event_id, (q.ts_us, q.event_id)) as last_quote from trades t
 join quotes q on t.market_slug = q.market_slug and q.ts_us between t.ts_us - {12 * HOUR} and t.ts_us + {12 * HOUR} group by 1""")
def t13(spark, sf):
    """Quotes around each fill: two as-of probes of a running count instead of an interval join."""
    c = F.col
    half = 12 * HOUR
    order = c("event_id")
    quotes = tb.quotes(spark, sf).select("market_slug", "event_id", c("ts_us").alias("q_us"))
    counted = running(quotes, ["market_slug"], "q_us", ["event_id"], {"n": ("count", None)})
    fills = tb.trades(spark, sf).select("event_id", "market_slug", (c("ts_us") - half).alias("lo"), (c("ts_us") + half).alias("hi"))
    before = asof_join(fills, counted, ["market_slug"], "lo", "q_us", ["n"], "b0", strict=True, tie=order)
    both = asof_join(before, counted, ["market_slug"], "hi", "q_us", ["n", "event_id"], "b1", tie=order)
    n = F.coalesce("b1.n", F.lit(0)) - F.coalesce("b0.n", F.lit(0))
    return both.select("event_id", n.alias("quotes"), c("b1.event_id").alias("last_quote")).where("quotes > 0")


@query("t15_correlation_tracker", f"""with {QT}, {PAIRS}, {CORR}, n as (select *, row_number() over (partition by a, b order by day desc) rn from al)
select a, b, count(*) as n, {s6('corr(ra, rb)')} as correlation from n where rn <= 8 group by 1, 2 having count(*) = 8""")
def t15(spark, sf):
    """Correlation of every pair of an event over its eight newest common days."""
    out = pairs.latest_correlations(daily_returns(spark, sf), 8)
    return out.select("a", "b", "n", r6(F.when(~F.isnan("correlation"), F.col("correlation"))).alias("correlation"))


@query("t16_raw_sink_dedup", f"""with {RAW} select day, source, count(*) as n, min(seq) as first_seq from raw group by 1, 2""")
def t16(spark, sf):
    env = rawlog.envelopes(spark, sf)
    unique = env.unionByName(env).dropDuplicates(["source", "seq", "sha256"])
    return unique.groupBy("day", "source").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
