"""Receipts, point-in-time joins, versions and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import asof, intervals
from tidemark.operators.ordered import islands, rolling, running
from tidemark.plans.bindings import EV, FC, FILLS, GAPS, LOAD, QT, QUOTES, SNAP
from tidemark.plans.registry import query, r6, s6
from tidemark.plans.scores import six
from tidemark.sources import receipts as rc
from tidemark.sources import tables as tb

AS_OF = 1_705_276_800_000_000  # 2024-01-15
HOUR, DAY = tb.HOUR_US, tb.DAY_US

REC = EV + """, rec as (
 select event_id as id, 'm' || user_id as entity_id, ts_us + k * 1000000 as received_us,
  case when event_type <> 'signup' then ts_us end as source_us, k, event_type,
  '{"event":' || event_id || ',"k":' || k || ',"type":"' || event_type || '"}' as payload,
  case when event_type in ('view', 'click') then 'book'
       when event_type in ('purchase', 'signup') then 'trade' else 'gap' end as kind
 from ev)"""
SEEN = f"received_us <= {AS_OF} and (source_us is null or source_us <= {AS_OF})"


@query("s01_receipt_log", f"""with {REC}
select id, kind, entity_id, received_us, source_us, payload, sha256(payload) as sha256,
 1 as schema_version from rec""")
def s01(spark, sf):
    return rc.receipts(spark, sf)


@query("s02_receipt_replay", f"""with {REC}
select id, kind, received_us from rec where {SEEN} and kind = 'trade'""")
def s02(spark, sf):
    return rc.ordered_replay(rc.receipts(spark, sf, until=AS_OF), AS_OF, "trade").select("id", "kind", "received_us")


@query("k03_replay_order", f"""with {REC}
select id, row_number() over (order by received_us, id) as seq from rec where {SEEN}""")
def k03(spark, sf):
    rows = rc.replay(rc.receipts(spark, sf, until=AS_OF), AS_OF).withColumn("g", F.lit(1))
    return running(rows, ["g"], "received_us", ["id"], {"seq": ("count", None)}).select("id", "seq")


@query("s04_import_order_check", f"""with {REC}, m as (
 select *, max(received_us) over (order by id rows between unbounded preceding and 1 preceding) as mx from rec)
select kind, count(*) as n, count(*) filter (where received_us < mx) as reversals from m group by 1""")
def s04(spark, sf):
    return rc.out_of_order(rc.receipts(spark, sf)).groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("reversal").alias("reversals")
    )


@query("s07_payload_integrity", f"""with {REC}
select kind, count(*) as n, count(*) filter (where cast('0x' || substr(md5(payload), 1, 8) as bigint) % 97 = 0) as mismatches from rec group by 1""")
def s07(spark, sf):
    """Stored payloads of which some were changed afterwards: the scan must count exactly those."""
    return rc.verify(rc.altered(rc.receipts(spark, sf)))


@query("s31_typed_views", f"""with {REC}
select kind, event_type as type, count(*) as n, cast(sum(k) as bigint) as sum_k,
 count(distinct entity_id) as entities from rec group by 1, 2""")
def s31(spark, sf):
    rec = rc.receipts(spark, sf)
    out = None
    for kind in ("book", "trade", "gap"):
        part = rc.typed_view(rec, kind).groupBy("type").agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"),
            F.countDistinct("entity_id").alias("entities"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("j01_latest_record", f"""with {REC}, r as (
 select *, row_number() over (partition by kind, entity_id
  order by coalesce(source_us, received_us) desc, received_us desc, id desc) rn from rec where {SEEN})
select kind, entity_id, id, payload from r where rn = 1""")
def j01(spark, sf):
    return asof.latest(
        rc.receipts(spark, sf, until=AS_OF), ["kind", "entity_id"], "source_us", "received_us", "id", AS_OF,
        ["id", "payload"],
    )


@query("j02_asof_quote_per_trade", f"""with {QT}
select t.event_id, t.market_slug, q.event_id as quote_id, {s6('q.mid')} as mid,
 t.ts_us - q.ts_us as age_us
from trades t asof left join quotes q on t.market_slug = q.market_slug and t.ts_us >= q.ts_us""")
def j02(spark, sf):
    q = tb.quotes(spark, sf).withColumn("q_us", F.col("ts_us"))
    out = asof.asof_join(
        tb.trades(spark, sf), q, ["market_slug"], "ts_us", "q_us", ["event_id", "mid", "q_us"],
        tie=F.col("event_id"),
    )
    return out.select(
        "event_id", "market_slug", F.col("asof.event_id").alias("quote_id"),
        r6("asof.mid").alias("mid"), (F.col("ts_us") - F.col("asof.q_us")).alias("age_us"),
    )


def race(spark, sf):
    q = tb.quotes(spark, sf).withColumn("q_us", F.col("ts_us"))
    both = asof.neighbours(
        tb.trades(spark, sf), q, ["market_slug"], "ts_us", "q_us", ["best_bid", "best_ask"],
        tie=F.col("event_id"),
    ).where("prev is not null and next is not null")
    buy = F.col("taker_side") == "BUY"
    pre = F.when(buy, F.col("prev.best_ask")).otherwise(F.col("prev.best_bid"))
    post = F.when(buy, F.col("next.best_ask")).otherwise(F.col("next.best_bid"))
    stale = F.abs(F.col("price") - pre) <= 0.005
    moved = F.when(buy, post - pre).otherwise(pre - post) >= 0.001
    return both.select("market_slug", "event_id", stale.alias("stale"), (stale & moved).alias("race"))


@query("j03_quote_race", f"""with {QT}, a as (
 select t.*, q.best_bid pb, q.best_ask pa from trades t
  asof join quotes q on t.market_slug = q.market_slug and t.ts_us >= q.ts_us),
b as (select a.*, q.best_bid nb, q.best_ask na from a
  asof join quotes q on a.market_slug = q.market_slug and a.ts_us < q.ts_us),
c as (select case when taker_side = 'BUY' then abs(price - pa) else abs(price - pb) end <= 0.005 as stale,
  case when taker_side = 'BUY' then na - pa else pb - nb end >= 0.001 as moved from b)
select count(*) as total_fills, count(*) filter (where stale) as stale_fills,
 count(*) filter (where stale and moved) as race_fills,
 {s6('count(*) filter (where stale and moved) / count(*)')} as fraction from c""")
def j03(spark, sf):
    n = F.count(F.lit(1))
    return race(spark, sf).agg(
        n.alias("total_fills"), F.count_if("stale").alias("stale_fills"),
        F.count_if("race").alias("race_fills"), r6(F.count_if("race") / n).alias("fraction"),
    )


def logit(p):
    return F.ln(p / (F.lit(1.0) - p))


HORIZONS = [1, 6, 24]
STABLE = 72


@query("j04_incorporation_curve", f"""with {QT}, pr as (
 select event_id, market_slug, unnest([0, 1, 6, 24, 72]) as h, ts_us from trades),
atq as (select p.event_id, p.h, case when q.mid > 0 and q.mid < 1 then ln(q.mid / (1e0 - q.mid)) end as l
 from pr p asof left join quotes q on p.market_slug = q.market_slug and p.ts_us + p.h * {HOUR} >= q.ts_us),
w as (select event_id, max(l) filter (where h = 0) l0, max(l) filter (where h = 72) ls,
 max(l) filter (where h = 1) l1, max(l) filter (where h = 6) l6, max(l) filter (where h = 24) l24
 from atq group by 1)
select event_id, {", ".join(f"case when abs(ls - l0) < 1e-12 then 0e0 else {s6(f'(l{h} - l0) / (ls - l0)')} end as r_{h}h" for h in HORIZONS)}
from w where l0 is not null and ls is not null""")
def j04(spark, sf):
    q = tb.quotes(spark, sf).withColumn("q_us", F.col("ts_us"))
    probes = asof.at_horizons(
        tb.trades(spark, sf).select("market_slug", "event_id", "ts_us"), "ts_us",
        [0, *HORIZONS, STABLE], HOUR,
    )
    at = asof.asof_join(probes, q, ["market_slug"], "target_us", "q_us", ["mid"], tie=F.col("event_id"))
    value = logit(F.col("asof.mid"))
    wide = at.groupBy("event_id").agg(
        *[F.max(F.when(F.col("horizon") == h, value)).alias(f"l{h}") for h in [0, *HORIZONS, STABLE]]
    ).where("l0 is not null").where(F.col(f"l{STABLE}").isNotNull())
    move = F.col(f"l{STABLE}") - F.col("l0")
    return wide.select(
        "event_id",
        *[
            F.when(F.abs(move) < 1e-12, 0.0)
            .otherwise(r6((F.col(f"l{h}") - F.col("l0")) / F.nullif(move, F.lit(0.0))))
            .alias(f"r_{h}h")
            for h in HORIZONS
        ],
    )


def near_sql(horizons) -> str:
    """SQL of the quote nearest to each trade at each horizon (hours)."""
    return QT + f""", pr as (
 select t.*, h as horizon, t.ts_us + h * {HOUR} as target from trades t, (select unnest({list(horizons)}) as h)),
b as (select p.*, q.event_id bid_, q.ts_us bts, q.mid bm from pr p
 asof left join quotes q on p.market_slug = q.market_slug and p.target >= q.ts_us),
n as (select b.*, q.event_id nid, q.ts_us nts, q.mid nm from b
 asof left join quotes q on b.market_slug = q.market_slug and b.target < q.ts_us),
pick as (select *, case when bts is not null and (nts is null or target - bts <= nts - target)
  then 'b' when nts is not null then 'n' end as w from n),
near as (select event_id, market_slug, horizon, price, taker_side, size,
  case w when 'b' then bid_ else nid end as quote_id, case w when 'b' then bm else nm end as mid,
  abs(target - case w when 'b' then bts else nts end) as gap_us from pick),
tol as (select *, gap_us <= 12 * {HOUR} as ok from near)"""


NEAR = near_sql((1, 6, 24))


def nearest_quotes(spark, sf, horizons=(1, 6, 24), tol_hours=12):
    q = tb.quotes(spark, sf).withColumn("q_us", F.col("ts_us"))
    probes = asof.at_horizons(tb.trades(spark, sf), "ts_us", list(horizons), HOUR)
    return asof.nearest_join(
        probes, q, ["market_slug"], "target_us", "q_us", ["event_id", "mid"],
        F.lit(tol_hours * HOUR), tie=F.col("event_id"),
    )


@query("j05_nearest_within_tolerance", f"""with {NEAR}
select event_id, horizon, case when ok then quote_id end as quote_id,
 case when ok then {s6('mid')} end as mid, case when ok then gap_us end as gap_us from tol""")
def j05(spark, sf):
    return nearest_quotes(spark, sf).select(
        "event_id", "horizon", F.col("near.event_id").alias("quote_id"), r6("near.mid").alias("mid"),
        F.abs(F.col("target_us") - F.col("near.q_us")).alias("gap_us"),
    )


@query("j06_delayed_execution", f"""with {QT}, pr as (
 select t.*, dl from trades t, (select unnest([0, 1, 6, 24]) as dl)),
a as (select p.*, q.best_ask, q.best_bid from pr p asof left join quotes q
  on p.market_slug = q.market_slug and p.ts_us + p.dl * {HOUR} >= q.ts_us)
select dl as delay_hours, count(*) as n, count(best_ask) as matched,
 {s6("avg(case when taker_side = 'BUY' then best_ask - price else price - best_bid end)")} as slippage
from a group by 1""")
def j06(spark, sf):
    q = tb.quotes(spark, sf).withColumn("q_us", F.col("ts_us"))
    probes = asof.at_horizons(tb.trades(spark, sf), "ts_us", [0, 1, 6, 24], HOUR)
    out = asof.asof_join(probes, q, ["market_slug"], "target_us", "q_us", ["best_bid", "best_ask"], tie=F.col("event_id"))
    slip = F.when(F.col("taker_side") == "BUY", F.col("asof.best_ask") - F.col("price")).otherwise(
        F.col("price") - F.col("asof.best_bid")
    )
    return out.groupBy(F.col("horizon").alias("delay_hours")).agg(
        F.count(F.lit(1)).alias("n"), F.count("asof.best_ask").alias("matched"),
        r6(F.avg(slip)).alias("slippage"),
    )


@query("j07_candle_close", f"""with {QT}, cd as (
 select market_slug, ts_us // {HOUR} as hr, (ts_us // {HOUR} + 1) * {HOUR} as end_us,
  arg_max(best_bid, (ts_us, event_id)) bid, arg_max(best_ask, (ts_us, event_id)) ask from quotes group by all),
pr as (select t.*, h from trades t, (select unnest([12, 6, 1]) as h)),
a as (select p.event_id, p.h, c.bid, c.ask, p.ts_us - p.h * {HOUR} - c.end_us as age from pr p
 asof left join cd c on p.market_slug = c.market_slug and p.ts_us - p.h * {HOUR} >= c.end_us)
select event_id, h as horizon, case when age <= 6 * {HOUR} then {s6('bid')} end as bid,
 case when age <= 6 * {HOUR} then {s6('ask')} end as ask from a""")
def j07(spark, sf):
    bar = F.floor(F.col("ts_us") / F.lit(HOUR)).cast("bigint")
    candles = tb.quotes(spark, sf).groupBy("market_slug", bar.alias("hr")).agg(
        F.max_by(F.struct(F.col("best_bid").alias("bid"), F.col("best_ask").alias("ask")), F.struct("ts_us", "event_id")).alias("q")
    ).select("market_slug", "hr", "q.*").withColumn("end_us", (F.col("hr") + 1) * HOUR)
    probes = asof.at_horizons(tb.trades(spark, sf), "ts_us", [-12, -6, -1], HOUR)
    out = asof.asof_join(probes, candles, ["market_slug"], "target_us", "end_us", ["bid", "ask", "end_us"], tie=F.col("hr"))
    fresh = F.col("target_us") - F.col("asof.end_us") <= 6 * HOUR
    return out.select(
        "event_id", (-F.col("horizon")).alias("horizon"),
        F.when(fresh, r6("asof.bid")).alias("bid"), F.when(fresh, r6("asof.ask")).alias("ask"),
    )


VER = QUOTES + """, h as (
 select *, sha256(cast(cast(round(spread * 100) as bigint) as varchar)) as hash from quotes),
l as (select *, lag(hash) over (partition by market_slug order by ts_us, event_id) ph from h),
ver as (select market_slug, event_id, ts_us as valid_from, hash as content_hash,
  lead(ts_us) over (partition by market_slug order by ts_us, event_id) as valid_until
  from l where ph is null or ph <> hash)"""


def metadata_versions(spark, sf):
    content = F.round(F.col("spread") * 100).cast("bigint").cast("string")
    return asof.versions(tb.quotes(spark, sf), ["market_slug"], "ts_us", ["event_id"], content).select(
        "market_slug", "event_id", "valid_from", "content_hash", "valid_until"
    )


@query("j23_metadata_versions", f"with {VER} select * from ver")
def j23(spark, sf):
    return metadata_versions(spark, sf)


@query("j23_metadata_as_of", f"""with {VER}, trades as (
 select 'm' || user_id as market_slug, event_id, ts_us from ev where event_type in ('purchase', 'signup'))
select t.event_id, v.event_id as version_id, v.content_hash from trades t
 asof left join ver v on t.market_slug = v.market_slug and t.ts_us >= v.valid_from""")
def j23b(spark, sf):
    ver = metadata_versions(spark, sf).withColumnRenamed("event_id", "version_id")
    out = asof.asof_join(
        tb.trades(spark, sf), ver, ["market_slug"], "ts_us", "valid_from",
        ["version_id", "content_hash", "valid_until"], tie=F.col("version_id"),
    )
    return out.select("event_id", "asof.version_id", "asof.content_hash")


VINT = LOAD + """, vint as (
 select doc_id, day as publish_day, day + doc_id % 7 as delivery_day, mw as peak from load_rows),
act as (select day, max(mw) as actual from load_rows group by 1)"""
AS_OF_DAY = 10_500


def vintages(spark, sf, until_day=None):
    """Forecast vintages: published on one day for a delivery day up to six days later."""
    return tb.daily_load(spark, sf, until_day).select(
        "doc_id", F.col("day").alias("publish_day"),
        (F.col("day") + F.col("doc_id") % 7).alias("delivery_day"), F.col("mw").alias("peak"),
    )


def actual_peaks(spark, sf):
    return tb.daily_load(spark, sf).groupBy("day").agg(F.max("mw").alias("actual"))


@query("j20_residuals_by_lead", f"""with {VINT}
select delivery_day - publish_day as lead, count(*) as n, {s6('avg(actual - peak)')} as bias,
 {s6('stddev_samp(actual - peak)')} as spread
from vint join act on delivery_day = day where delivery_day - publish_day between 0 and 6 group by 1""")
def j20(spark, sf):
    v, a = vintages(spark, sf), actual_peaks(spark, sf)
    lead = F.col("delivery_day") - F.col("publish_day")
    return six(
        v.join(a, v["delivery_day"] == a["day"]).where(lead.between(0, 6))
        .groupBy(lead.alias("lead")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.col("actual") - F.col("peak")).alias("bias"),
            F.stddev_samp(F.col("actual") - F.col("peak")).alias("spread"),
        )
    )


@query("j21_latest_vintage_as_of", f"""with {VINT}, r as (select *, row_number() over (
 partition by delivery_day order by publish_day desc, doc_id desc) rn from vint where publish_day <= {AS_OF_DAY})
select delivery_day, publish_day, doc_id, peak from r where rn = 1""")
def j21(spark, sf):
    return vintages(spark, sf, AS_OF_DAY).where(F.col("publish_day") <= AS_OF_DAY).groupBy("delivery_day").agg(
        F.max_by(F.struct("publish_day", "doc_id", "peak"), F.struct("publish_day", "doc_id")).alias("r")
    ).select("delivery_day", "r.*")


@query("w18_revision_selection", f"""with {VINT}, r as (select *, row_number() over (
  partition by delivery_day order by publish_day desc, doc_id desc) as rn,
  row_number() over (partition by delivery_day order by publish_day, doc_id) as fn,
  count(*) over (partition by delivery_day) as revisions from vint)
select l.delivery_day, l.doc_id as latest_doc, l.peak as latest_peak, f.doc_id as first_doc,
 f.peak as first_peak, l.revisions from r l join r f on l.delivery_day = f.delivery_day
where l.rn = 1 and f.fn = 1""")
def w18(spark, sf):
    at = F.struct("publish_day", "doc_id")
    return vintages(spark, sf).groupBy("delivery_day").agg(
        F.max_by("doc_id", at).alias("latest_doc"), F.max_by("peak", at).alias("latest_peak"),
        F.min_by("doc_id", at).alias("first_doc"), F.min_by("peak", at).alias("first_peak"),
        F.count(F.lit(1)).alias("revisions"),
    )


@query("w13_per_market_row_cap", f"""with {SNAP}, r as (select *, row_number() over (
 partition by market_id order by ts_us, rid) rn from snap)
select market_id, count(*) as kept, count(*) filter (where filled) as tradable from r where rn <= 20 group by 1""")
def w13(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("market_id").orderBy("ts_us", "rid")
    # a rank limit is pushed below the shuffle, so a hot market sends 20 rows per task
    capped = tb.snapshots(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 20")
    return capped.groupBy("market_id").agg(
        F.count(F.lit(1)).alias("kept"), F.count_if("filled").alias("tradable")
    )


@query("w15_duplicate_keys", """select l_orderkey as order_id, l_linenumber as line, count(*) as copies,
 min(l_extendedprice) as first_price from lineitem group by 1, 2 having count(*) > 1""")
def w15(spark, sf):
    return tb.load(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line")
    ).agg(
        F.count(F.lit(1)).alias("copies"), F.min("l_extendedprice").alias("first_price")
    ).where("copies > 1")


@query("w01_canonical_forecasts", f"""with {FC}, f as (
 select market_id, arg_min(p, (predicted_us, rid)) as p, min(predicted_us) as predicted_us,
  min(label_known_us) as label_known_us, max(outcome) as outcome,
  count(distinct cluster) > 1 as cluster_conflict, count(distinct outcome) > 1 as label_conflict
 from fc group by 1)
select f.*, exists (select 1 from fc where fc.market_id = f.market_id
  and fc.predicted_us = f.predicted_us and fc.p <> f.p) as forecast_conflict from f""")
def w01(spark, sf):
    return canonical(tb.forecasts(spark, sf)).drop("cluster")


def canonical(fc):
    """Earliest forecast per market with conflict flags; instants are pre-aggregated."""
    instants = fc.groupBy("market_id", "predicted_us").agg(
        F.min_by("p", "rid").alias("p"), F.min("p").alias("lo"), F.max("p").alias("hi"),
        F.min("label_known_us").alias("known"), F.min("outcome").alias("y0"),
        F.max("outcome").alias("y1"), F.min("cluster").alias("c0"), F.max("cluster").alias("c1"),
    )
    first = F.min_by(F.struct("p", "lo", "hi"), F.col("predicted_us"))
    return instants.groupBy("market_id").agg(
        first.alias("f"), F.min("predicted_us").alias("predicted_us"),
        F.min("known").alias("label_known_us"), F.max("y1").alias("outcome"),
        (F.min("c0") != F.max("c1")).alias("cluster_conflict"), F.min("c0").alias("cluster"),
        F.coalesce(F.min("y0") != F.max("y1"), F.lit(False)).alias("label_conflict"),
    ).select(
        "market_id", "f.p", "predicted_us", "label_known_us", "outcome", "cluster",
        "cluster_conflict", "label_conflict", (F.col("f.lo") != F.col("f.hi")).alias("forecast_conflict"),
    )


@query("j15_holding_periods", f"""with {FILLS}, l as (
 select token_id, side, ts_us, lag(side) over w as ps, lag(ts_us) over w as pt from fills
 window w as (partition by token_id order by ts_us, rid)),
h as (select (ts_us - pt) / 1e6 as s from l where side = 'SELL' and ps = 'BUY')
select count(*) as n, {s6('avg(s)')} as average_seconds, {s6('max(s)')} as max_seconds,
 {s6('min(s)')} as min_seconds from h""")
def j15(spark, sf):
    prev = F.struct(F.col("side").alias("side"), F.col("ts_us").alias("ts"))
    rows = running(
        tb.fills(spark, sf).select("token_id", "side", "ts_us", "rid"), ["token_id"], "ts_us", ["rid"],
        {"p": ("lag", prev)},
    ).where("side = 'SELL' and p.side = 'BUY'")
    s = (F.col("ts_us") - F.col("p.ts")) / F.lit(1e6)
    return six(rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg(s).alias("average_seconds"),
        F.max(s).alias("max_seconds"), F.min(s).alias("min_seconds"),
    ))


@query("j25_decision_context", f"""with {QUOTES}
select event_id, count(*) over p as preceding, count(*) over f as following,
 {s6('avg(mid) over p')} as mean_before, {s6('avg(mid) over f')} as mean_after from quotes
window p as (partition by market_slug order by ts_us, event_id rows between 5 preceding and 1 preceding),
 f as (partition by market_slug order by ts_us, event_id rows between 1 following and 5 following)""")
def j25(spark, sf):
    def context(df, w):
        back, ahead = w.rowsBetween(-5, -1), w.rowsBetween(1, 5)
        return df.withColumns({
            "preceding": F.count(F.lit(1)).over(back), "following": F.count(F.lit(1)).over(ahead),
            "mean_before": F.avg("mid").over(back), "mean_after": F.avg("mid").over(ahead),
        })

    q = tb.quotes(spark, sf).select("market_slug", "event_id", "ts_us", "mid")
    return six(
        rolling(q, ["market_slug"], "ts_us", ["event_id"], 5, context, after=5).select(
            "event_id", "preceding", "following", "mean_before", "mean_after"
        )
    )


UNION = GAPS + """, g1 as (select *, max(end_us) over (partition by market_slug order by start_us, event_id
  rows between unbounded preceding and 1 preceding) mx from gaps where end_us > start_us),
g2 as (select *, sum(case when mx is null or start_us > mx then 1 else 0 end) over (
  partition by market_slug order by start_us, event_id) as isle from g1),
uni as (select market_slug, min(start_us) as start_us, max(end_us) as end_us from g2 group by market_slug, isle)"""


@query("w14_interval_union", f"with {UNION} select market_slug, start_us, end_us from uni")
def w14(spark, sf):
    return intervals.union_intervals(tb.gaps(spark, sf), ["market_slug"], "start_us", "end_us")


W0, W1 = 1_704_240_000_000_000, 1_706_400_000_000_000  # 2024-01-03 .. 2024-01-28


@query("a53_observed_coverage", f"""with {UNION}, c as (
 select market_slug, greatest(start_us, {W0}) s, least(end_us, {W1}) e from uni)
select market_slug, count(*) as gaps, cast(sum(e - s) as bigint) as unobserved_us,
 {s6(f'greatest(0, 1 - sum(e - s) / {float(W1 - W0)!r}::double)')} as coverage from c where e > s group by 1""")
def a53(spark, sf):
    return six(intervals.coverage(tb.gaps(spark, sf), ["market_slug"], "start_us", "end_us", W0, W1))


@query("j13_gap_overlap", f"""with {UNION}, lu as (
 select 'm' || user_id as market_slug, event_id as window_id, ts_us as ws, ts_us + 6 * {HOUR} as we
 from ev where event_type in ('view', 'click'))
select window_id, cast(coalesce(sum(least(we, end_us) - greatest(ws, start_us)) filter (where start_us is not null), 0) as bigint) as overlap_us
from lu left join uni on lu.market_slug = uni.market_slug and ws < end_us and start_us < we group by 1""")
def j13(spark, sf):
    windows = tb.quotes(spark, sf).select(
        "market_slug", F.col("event_id").alias("window_id"), F.col("ts_us").alias("ws"),
        (F.col("ts_us") + 6 * HOUR).alias("we"),
    )
    out = intervals.covered_time(
        windows, tb.gaps(spark, sf), ["market_slug"], "ws", "we", "start_us", "end_us", "overlap_us"
    )
    return out.select("window_id", "overlap_us")


@query("j13_interval_subtraction", f"""with {UNION}, lu as (
 select 'm' || user_id as market_slug, event_id as id, ts_us as ws, ts_us + 6 * {HOUR} as we
 from ev where event_type in ('view', 'click')),
cov as (select id, sum(least(we, end_us) - greatest(ws, start_us)) as c from lu join uni using (market_slug)
 where ws < end_us and start_us < we group by 1)
select id, cast(we - ws - coalesce(c, 0) as bigint) as open_us from lu left join cov using (id)
where we - ws - coalesce(c, 0) > 0""")
def j13b(spark, sf):
    windows = tb.quotes(spark, sf).select(
        "market_slug", F.col("event_id").alias("id"), F.col("ts_us").alias("ws"),
        (F.col("ts_us") + 6 * HOUR).alias("we"),
    )
    parts = intervals.subtract(
        windows, tb.gaps(spark, sf), ["market_slug"], "id", 6 * HOUR, "ws", "we", "start_us", "end_us"
    )
    return parts.groupBy("id").agg(F.sum(F.col("we") - F.col("ws")).alias("open_us"))


@query("j14_outage_pairing", f"""with {EV}, e as (
 select user_id, event_id, ts_us, case event_type when 'error' then 1 else -1 end st
 from ev where event_type in ('error', 'signup')),
w as (select *, sum(st) over (partition by user_id order by ts_us, event_id) s from e),
m as (select *, min(s) over (partition by user_id order by ts_us, event_id
  rows between unbounded preceding and 1 preceding) mn from w),
k as (select * from m where st = 1 or s >= least(0, coalesce(mn, 0))),
n as (select *, sum(case st when 1 then 1 else 0 end) over x no_, sum(case st when -1 then 1 else 0 end) over x nc
 from k window x as (partition by user_id order by ts_us, event_id))
select 'm' || o.user_id as market_slug, o.ts_us as gap_start, c.ts_us as gap_end
from n o left join n c on o.user_id = c.user_id and c.st = -1 and c.nc = o.no_ where o.st = 1""")
def j14(spark, sf):
    ev = tb.event_rows(spark, sf).withColumn("market_slug", F.concat(F.lit("m"), F.col("user_id")))
    out = intervals.pair_fifo(
        ev, ["market_slug"], "ts_us", ["event_id"],
        F.col("event_type") == "error", F.col("event_type") == "signup", ["ts_us"],
    )
    return out.select("market_slug", F.col("open_ts_us").alias("gap_start"), F.col("close_ts_us").alias("gap_end"))


@query("a69_collection_gaps", f"""with {EV}, l as (
 select user_id, ts_us, lead(ts_us) over (partition by user_id order by ts_us, event_id) - ts_us as g from ev)
select 'm' || user_id as market_slug, count(*) as n, max(g) as largest_us, arg_max(ts_us, g) as starts_us
from l group by 1""")
def a69(spark, sf):
    ev = tb.event_rows(spark, sf).withColumn("market_slug", F.concat(F.lit("m"), F.col("user_id")))
    nxt = running(ev, ["market_slug"], "ts_us", ["event_id"], {"nx": ("lead", F.col("ts_us"))})
    gap = F.col("nx") - F.col("ts_us")
    return nxt.groupBy("market_slug").agg(
        F.count(F.lit(1)).alias("n"), F.max(gap).alias("largest_us"),
        F.max_by("ts_us", gap).alias("starts_us"),
    )


@query("t06_stale_feed", f"""with {EV}, l as (
 select user_id, ts_us, lead(ts_us) over (partition by user_id order by ts_us, event_id) as nx from ev)
select 'm' || user_id as market_slug, ts_us + 12 * {HOUR} as stale_from, nx as stale_until from l
where nx - ts_us > 12 * {HOUR}""")
def t06(spark, sf):
    ev = tb.event_rows(spark, sf).withColumn("market_slug", F.concat(F.lit("m"), F.col("user_id")))
    nxt = running(ev, ["market_slug"], "ts_us", ["event_id"], {"nx": ("lead", F.col("ts_us"))})
    return nxt.where(F.col("nx") - F.col("ts_us") > 12 * HOUR).select(
        "market_slug", (F.col("ts_us") + 12 * HOUR).alias("stale_from"), F.col("nx").alias("stale_until")
    )


@query("t07_activity_sessions", f"""with {EV}, l as (
 select *, lag(ts_us) over (partition by user_id order by ts_us, event_id) p from ev),
s as (select *, sum(case when p is null or ts_us - p > 6 * {HOUR} then 1 else 0 end) over (
 partition by user_id order by ts_us, event_id) as sid from l)
select 'm' || user_id as market_slug, cast(sid as bigint) as session, min(ts_us) as start_us,
 max(ts_us) as end_us, count(*) as n from s group by all""")
def t07(spark, sf):
    ev = tb.event_rows(spark, sf).withColumn("market_slug", F.concat(F.lit("m"), F.col("user_id")))
    fresh = F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev") > 6 * HOUR)
    return islands(
        ev, ["market_slug"], "ts_us", ["event_id"], F.col("ts_us"), fresh, "session"
    ).groupBy(
        "market_slug", "session"
    ).agg(
        F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count(F.lit(1)).alias("n")
    )
