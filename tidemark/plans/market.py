"""Book features, depth walks, eligibility, edge arithmetic and sizing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import book as bk
from tidemark.functions import pricing as pr
from tidemark.plans.bindings import DOCS, LEVELS, QUOTES, SNAP, TRADES
from tidemark.plans.pit import AS_OF, DAY, HOUR
from tidemark.plans.registry import fee5, query, r6, s6
from tidemark.plans.scores import six
from tidemark.sources import tables as tb

# One row per book, also for a book whose levels all fall outside (0, 1).
BOOK = LEVELS + """, bb as (
 select event_id, market_slug, ts_us,
  arg_min(price, i) filter (where side = 'bid') bb, arg_min(price, i) filter (where side = 'ask') ba,
  arg_min(size, i) filter (where side = 'bid') bs, arg_min(size, i) filter (where side = 'ask') as_,
  arg_max(price, i) filter (where side = 'bid') lb, arg_max(price, i) filter (where side = 'ask') la,
  count(*) filter (where side = 'bid') nb, count(*) filter (where side = 'ask') na,
  coalesce(sum(size) filter (where side = 'bid'), 0) bd, coalesce(sum(size) filter (where side = 'ask'), 0) ad,
  sum(size * size) filter (where side = 'bid') bq, sum(size * size) filter (where side = 'ask') aq
 from (select distinct event_id, market_slug, ts_us from quotes) left join lv using (event_id, market_slug, ts_us) group by all)"""


@query("f05_book_features", f"""with {BOOK}, m as (select *, (bb + ba) / 2e0 as mid, ba - bb as sp from bb)
select event_id, {s6('mid')} as midpoint, {s6('bb')} as best_bid, {s6('ba')} as best_ask, {s6('sp')} as spread,
 {s6('sp / mid')} as relative_spread, {s6('sp / mid * 10000')} as spread_bps,
 {s6('(ba * bs + bb * as_) / (bs + as_)')} as microprice, {s6('bd')} as bid_depth, {s6('ad')} as ask_depth,
 {s6('case when bd + ad = 0 then 0 else (bd - ad) / (bd + ad) end')} as imbalance,
 {s6('case when bd + ad = 0 then 0 else (bd - ad) / (bd + ad) end')} as depth_imbalance_10,
 {s6('case when nb >= 2 then abs(lb - bb) / greatest(bd, 1) end')} as bid_slope,
 {s6('case when na >= 2 then abs(la - ba) / greatest(ad, 1) end')} as ask_slope,
 {s6('bq / (bd * bd)')} as bid_concentration, {s6('aq / (ad * ad)')} as ask_concentration from m""")
def f05(spark, sf):
    feats = bk.features(F.col("bids"), F.col("asks"))
    return six(
        tb.books(spark, sf).select("event_id", *[c.alias(n) for n, c in feats.items()])
    )


@query("k04_top_levels", f"""with {LEVELS}
select event_id, side, {s6('sum(price * size) / sum(size)')} as vwap_top5, {s6('sum(size)')} as size_top5
from (select *, row_number() over (partition by event_id, side order by i) rn from lv) where rn <= 5 group by 1, 2""")
def k04(spark, sf):
    def side(name, col):
        best = bk.top(F.col(col), 5)
        cash = F.aggregate(best, F.lit(0.0), lambda a, x: a + x["price"] * x["size"])
        size = bk.depth(F.col(col), 5)
        return F.struct(F.lit(name).alias("side"), cash.alias("cash"), size.alias("size"))

    out = tb.books(spark, sf).select(
        "event_id", F.explode(F.array(side("bid", "bids"), side("ask", "asks"))).alias("s")
    ).where("s.size > 0")
    return out.select(
        "event_id", "s.side", r6(F.col("s.cash") / F.col("s.size")).alias("vwap_top5"),
        r6("s.size").alias("size_top5"),
    )


WALK = LEVELS + """, w0 as (
 select l.*, k + 1e0 as need, coalesce(sum(size) over (partition by event_id, side order by i
  rows between unbounded preceding and 1 preceding), 0) as before
 from lv l join (select event_id, k from quotes) using (event_id)),
w as (select *, greatest(0, least(size, need - before)) as q from w0)"""


@query("f02_depth_walk", f"""with {WALK}
select event_id, {s6('coalesce(sum(q), 0)')} as filled, {s6('coalesce(sum(q * price), 0)')} as notional,
 {s6('coalesce(sum(' + fee5('q * 2e-2 * price * (1e0 - price)') + '), 0)')} as fees,
 cast(count(*) filter (where q > 0) as int) as levels,
 {s6('sum(q * price) / sum(q)')} as vwap, {s6('sum(q * price) / sum(q) - arg_min(price, i)')} as slippage
from (select distinct event_id from quotes) left join (select * from w where side = 'ask') using (event_id) group by 1""")
def f02(spark, sf):
    w = bk.walk(F.col("asks"), F.col("k") + 1, F.lit(0.02))
    return six(tb.books(spark, sf).select("event_id", w.alias("w")).select("event_id", "w.*"))


NOTIONALS = [10, 50, 100, 500]


@query("f04_capacity_curve", LEVELS.join(["with ", ""]) + f""", best as (
 select event_id, arg_min(price, i) as b from lv where side = 'ask' group by 1),
n as (select event_id, b, n, round(n / b, 2) as need from best, (select unnest({NOTIONALS}) as n)),
w0 as (select l.event_id, n.n, n.b, need, price, size, i, mid, coalesce(sum(size) over (
  partition by l.event_id, n.n order by i rows between unbounded preceding and 1 preceding), 0) as before
 from lv l join n using (event_id) where side = 'ask'),
w as (select *, greatest(0, least(size, need - before)) as q from w0),
c as (select event_id, n, max(need) need, max(b) b, sum(q) f, sum(q * price) / sum(q) v,
 sum({fee5('q * 2e-2 * price * (1e0 - price)')}) fees, max(mid) mid from w group by 1, 2)
select n as notional, count(*) as n, {s6('avg(f / need)')} as fill_fraction, {s6('avg(v)')} as vwap,
 {s6('avg(v - b)')} as slippage, {s6('avg(mid + 1e-1 - v - fees / f - (v - b))')} as remaining_edge
from c group by 1""")
def f04(spark, sf):
    sizes = F.explode(F.array(*[F.lit(n) for n in NOTIONALS])).alias("notional")
    best = bk.best(F.col("asks"))
    rows = tb.books(spark, sf).select("mid", "asks", sizes).withColumn(
        "need", F.round(F.col("notional") / best, 2)
    ).where("need > 0")
    rows = rows.withColumn("w", bk.walk(F.col("asks"), F.col("need"), F.lit(0.02)))
    edge = (
        F.col("mid") + F.lit(0.1) - F.col("w.vwap") - F.col("w.fees") / F.col("w.filled")
        - F.col("w.slippage")
    )
    return six(rows.groupBy("notional").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("w.filled") / F.col("need")).alias("fill_fraction"),
        F.avg("w.vwap").alias("vwap"), F.avg("w.slippage").alias("slippage"),
        F.avg(edge).alias("remaining_edge"),
    ))


@query("f03_fees", f"""with {SNAP}
select rid, market_id, {s6(fee5('bid_size * fee_rate * ask * (1e0 - ask)'))} as level_fee,
 {s6('ceil(round(fee_rate * bid_size * ask * (1e0 - ask) * 100, 9)) / 100')} as order_fee,
 {s6('fee_rate * ask * (1e0 - ask)')} as per_contract from snap""")
def f03(spark, sf):
    q, p, r = F.col("bid_size"), F.col("ask"), F.col("fee_rate")
    return six(tb.snapshots(spark, sf).select(
        "rid", "market_id", bk.taker_fee(q, p, r).alias("level_fee"),
        bk.order_fee_cents(q, p, r).alias("order_fee"), bk.fee_per_contract(p, r).alias("per_contract"),
    ))


P01_SQL = f"""with {SNAP}, r as (select concat_ws(',',
 case when not filled then 'inactive_or_closed' end,
 case when fee_rate = 0 then 'orders_unavailable' end,
 case when ts_us > 883612800000000 then 'future_metadata' end,
 case when liquidity < 5000 then 'liquidity_missing_or_low' end,
 case when volume < 1000 then 'volume_missing_or_low' end,
 case when resolved_us <= 883612800000000 then 'deadline_missing_or_elapsed' end) as reasons from snap)
select reasons, count(*) as n from r group by 1"""
NOW_98 = 883_612_800_000_000


def market_reasons(now_us, min_liquidity=5000.0, min_volume=1000.0):
    """All reasons why a market row is not eligible, in rule order."""
    c = F.col
    rules = [
        (~c("filled"), "inactive_or_closed"),
        (c("fee_rate") == 0, "orders_unavailable"),
        (c("ts_us") > now_us, "future_metadata"),
        (c("liquidity").isNull() | (c("liquidity") < min_liquidity), "liquidity_missing_or_low"),
        (c("volume").isNull() | (c("volume") < min_volume), "volume_missing_or_low"),
        (c("resolved_us").isNull() | (c("resolved_us") <= now_us), "deadline_missing_or_elapsed"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(r)) for cond, r in rules]))


@query("p01_market_eligibility", P01_SQL)
def p01(spark, sf):
    reasons = F.concat_ws(",", market_reasons(NOW_98))
    return tb.snapshots(spark, sf).groupBy(reasons.alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


def book_reasons(now_us, max_age_us=10 * DAY, max_spread=0.04, min_depth=100.0):
    c = F.col
    spread = bk.best(c("asks")) - bk.best(c("bids"))
    rules = [
        (c("ts_us") > now_us, "future_book"),
        (F.lit(now_us) - c("ts_us") > max_age_us, "stale_book"),
        (spread.isNull(), "one_sided_book"),
        (spread <= 0, "locked_or_crossed_book"),
        (F.round(spread, 9) > max_spread, "spread_too_wide"),
        (F.least(bk.depth(c("bids")), bk.depth(c("asks"))) < min_depth, "insufficient_depth"),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(r)) for cond, r in rules]))


@query("p02_book_eligibility", f"""with {BOOK}, r as (select concat_ws(',',
 case when ts_us > {AS_OF} then 'future_book' end,
 case when {AS_OF} - ts_us > {10 * DAY} then 'stale_book' end,
 case when ba - bb is null then 'one_sided_book' end,
 case when ba - bb <= 0 then 'locked_or_crossed_book' end,
 case when round(ba - bb, 9) > 0.04 then 'spread_too_wide' end,
 case when least(bd, ad) < 100 then 'insufficient_depth' end) as reasons from bb)
select reasons, count(*) as n from r group by 1""")
def p02(spark, sf):
    reasons = F.concat_ws(",", book_reasons(AS_OF))
    return tb.books(spark, sf).groupBy(reasons.alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


SCORE = ("3e-1 * ln(1e0 + liquidity) + 25e-2 * ln(1e0 + volume) - 2e-1 * spread * 100"
         " + 15e-2 * least(ln(1e0 + bid_size + ask_size) / 10e0, 1e0) + case when filled then 1e-1 else 0 end")


@query("p03_quality_ranking", f"""with {SNAP}, s as (
 select market_id, avg({SCORE}) as score from snap group by 1 having avg({SCORE}) >= 5)
select market_id, {s6('score')} as score, row_number() over (order by round(score, 6) desc, market_id desc) as rank from s""")
def p03(spark, sf):
    from tidemark.operators.ordered import running

    c = F.col
    depth = F.least(F.ln(F.lit(1.0) + c("bid_size") + c("ask_size")) / F.lit(10.0), F.lit(1.0))
    score = (
        F.lit(0.30) * F.ln(F.lit(1.0) + c("liquidity")) + F.lit(0.25) * F.ln(F.lit(1.0) + c("volume"))
        - F.lit(0.20) * c("spread") * F.lit(100.0) + F.lit(0.15) * depth
        + F.when(c("filled"), 0.1).otherwise(0.0)
    )
    per = tb.snapshots(spark, sf).groupBy("market_id").agg(r6(F.avg(score)).alias("score"))
    rows = per.where("score >= 5").withColumn("g", F.lit(1))
    return running(rows, ["g"], "score", ["market_id"], {"rank": ("count", None)}, descending=True).drop("g")


@query("p08_signal_class", f"""with {SNAP}
select case when abs(model_p - mid) > 0.15 and fee_rate / 8e-2 > 0.7 then 'REQUIRE_REVIEW'
  when abs(model_p - 0.5) < 0.05 or abs(model_p - mid) > 0.5 then 'REJECT' else 'ACTIONABLE' end as class,
 count(*) as n, {s6('avg(abs(model_p - mid))')} as disagreement from snap group by 1""")
def p08(spark, sf):
    c = F.col
    gap = F.abs(c("model_p") - c("mid"))
    label = (
        F.when((gap > 0.15) & (c("fee_rate") / F.lit(0.08) > 0.7), "REQUIRE_REVIEW")
        .when((F.abs(c("model_p") - F.lit(0.5)) < 0.05) | (gap > 0.5), "REJECT")
        .otherwise("ACTIONABLE")
    )
    return six(tb.snapshots(spark, sf).groupBy(label.alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap).alias("disagreement")
    ))


@query("p13_tradable_state_filter", """with s as (
 select l_partkey as pk, case l_returnflag when 'A' then 'open' when 'R' then 'closed' else null end as state from lineitem)
select 'm' || pk as market_id, count(*) as kept from s
where state is null or state in ('open', 'preopen') or state not in ('open', 'preopen', 'closed', 'halted', 'expired')
group by 1""")
def p13(spark, sf):
    # States that allow trading and all states the venue documents.
    tradable = ["open", "preopen"]
    known = [*tradable, "closed", "halted", "expired"]
    state = F.when(F.col("l_returnflag") == "A", "open").when(F.col("l_returnflag") == "R", "closed")
    rows = tb.load(spark, sf, "lineitem").select(
        F.concat(F.lit("m"), F.col("l_partkey")).alias("market_id"), state.alias("state")
    )
    keep = F.col("state").isNull() | F.col("state").isin(tradable) | ~F.col("state").isin(known)
    return rows.where(keep).groupBy("market_id").agg(F.count(F.lit(1)).alias("kept"))


@query("p12_freshness_class", f"""with {QUOTES}, g as (
 select market_slug, max(ts_us) as last_us from quotes group by 1)
select case when {AS_OF + 14 * DAY} - last_us <= {DAY} then 'LIVE' when {AS_OF + 14 * DAY} - last_us <= {3 * DAY} then 'DELAYED'
 else 'STALE' end as state, count(*) as markets from g group by 1""")
def p12(spark, sf):
    last = tb.quotes(spark, sf).groupBy("market_slug").agg(F.max("ts_us").alias("last_us"))
    age = F.lit(AS_OF + 14 * DAY) - F.col("last_us")
    state = F.when(age <= DAY, "LIVE").when(age <= 3 * DAY, "DELAYED").otherwise("STALE")
    return last.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("markets"))


@query("p14_jurisdiction_rules", """with r as (
 select n_nationkey, case when r_name in ('AMERICA', 'EUROPE') then 'allowed'
  when r_name = 'ASIA' then 'review' else 'blocked' end as rule from nation join region on n_regionkey = r_regionkey)
select rule, count(*) as customers, round(sum(c_acctbal), 2) as balance
from customer join r on c_nationkey = n_nationkey group by 1""")
def p14(spark, sf):
    # Access rule of each jurisdiction group.
    rules = spark.createDataFrame(
        [("AMERICA", "allowed"), ("EUROPE", "allowed"), ("ASIA", "review")], "r_name string, rule string"
    )
    region = tb.load(spark, sf, "region").join(rules, "r_name", "left")
    nation = tb.load(spark, sf, "nation").join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", F.coalesce("rule", F.lit("blocked")).alias("rule"))
    return tb.load(spark, sf, "customer").join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    ).groupBy("rule").agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query("p16_executable_venue_split", f"""with {TRADES}
select taker_side = 'BUY' as executable, count(*) as n, count(distinct market_slug) as markets from trades group by 1""")
def p16(spark, sf):
    return tb.trades(spark, sf).groupBy((F.col("taker_side") == "BUY").alias("executable")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("market_slug").alias("markets")
    )


@query("p17_resolvable_horizons", f"""with {QUOTES}, d as (
 select market_slug, lead(ts_us) over (partition by market_slug order by ts_us, event_id) - ts_us as g from quotes),
c as (select market_slug, avg(g) / 36e8 as cadence from d group by 1)
select market_slug, {s6('cadence')} as cadence_hours, h as horizon_hours from c, (select unnest([1, 6, 24, 72, 168]) as h)
where h >= cadence""")
def p17(spark, sf):
    from tidemark.operators.ordered import running

    nxt = running(tb.quotes(spark, sf), ["market_slug"], "ts_us", ["event_id"], {"nx": ("lead", F.col("ts_us"))})
    cad = nxt.groupBy("market_slug").agg(
        (F.avg(F.col("nx") - F.col("ts_us")) / F.lit(3.6e9)).alias("cadence")
    )
    horizons = F.array(*[F.lit(h) for h in (1, 6, 24, 72, 168)])
    return cad.select(
        "market_slug", r6("cadence").alias("cadence_hours"), F.explode(horizons).alias("horizon_hours"), "cadence"
    ).where("horizon_hours >= cadence").drop("cadence")


@query("f06_temporal_features", """select event_id, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as weekday,
 isodow(ts) >= 6 as weekend, round((1706745600000000 - epoch_us(ts)) / 1e6, 6) + 0e0 as seconds_left,
 round(1e0 / (1e0 + (1706745600000000 - epoch_us(ts)) / 864e8), 6) + 0e0 as urgency from events""")
def f06(spark, sf):
    deadline = 1_706_745_600_000_000  # 2024-02-01
    left = F.lit(deadline) - F.col("ts_us")
    at = F.timestamp_micros("ts_us")
    return tb.event_rows(spark, sf).select(
        "event_id", F.hour(at).alias("hour"), F.weekday(at).alias("weekday"),
        (F.weekday(at) >= 5).alias("weekend"), r6(left / F.lit(1e6)).alias("seconds_left"),
        r6(F.lit(1.0) / (F.lit(1.0) + left / F.lit(8.64e10))).alias("urgency"),
    )


@query("f07_market_features", f"""with {SNAP}
select market_id, rid, {s6('ln(1e0 + liquidity)')} as log_liquidity, {s6('ln(1e0 + volume)')} as log_volume,
 {s6('volume / nullif(liquidity, 0)')} as turnover, fee_rate > 0 as has_fees from snap""")
def f07(spark, sf):
    c = F.col
    return six(tb.snapshots(spark, sf).select(
        "market_id", "rid", F.ln(F.lit(1.0) + c("liquidity")).alias("log_liquidity"),
        F.ln(F.lit(1.0) + c("volume")).alias("log_volume"),
        (c("volume") / F.nullif(c("liquidity"), F.lit(0.0))).alias("turnover"),
        (c("fee_rate") > 0).alias("has_fees"),
    ))


BAYES = "greatest(1e-2, least(99e-2, {p}))"


@query("f09_logit_and_bayes", f"""with {SNAP}, x as (select market_id, rid, mid, model_p,
 case when mid > 0 and mid < 1 then ln(mid / (1e0 - mid)) end as l0, ln(model_p / (1e0 - model_p)) as l1,
 greatest(135e-3, least(739e-2, exp(2e0 * greatest(-1e0, least(1e0, model_p - mid))))) as lr,
 {BAYES.format(p='mid')} as pr from snap)
select market_id, rid, {s6('l0')} as logit_mid, {s6('l1 - l0')} as logit_delta,
 {s6('1e0 / (1e0 + exp(-l1))')} as back,
 {s6(BAYES.format(p='pr * greatest(1e-2, least(100e0, lr)) / (pr * greatest(1e-2, least(100e0, lr)) + (1e0 - pr))'))} as posterior
from x""")
def f09(spark, sf):
    c = F.col
    l0, l1 = pr.logit(c("mid")), pr.logit(c("model_p"))
    return six(tb.snapshots(spark, sf).select(
        "market_id", "rid", l0.alias("logit_mid"), (l1 - l0).alias("logit_delta"),
        pr.sigmoid(l1).alias("back"),
        pr.bayes(c("mid"), pr.feature_ratio(c("model_p") - c("mid"))).alias("posterior"),
    ))


EV10 = """ed as (select *, model_p >= mid as yes,
  case when model_p >= mid then model_p - ask else (1e0 - model_p) - (1e0 - bid) end as gross,
  fee_rate * ask * (1e0 - ask) as fee, 2e-2 * (5e-1 + 5e-1 * 4e0 * model_p * (1e0 - model_p)) as unc,
  case when bid_size + ask_size <= 0 then 1e-2 else 5e-3 * least(10e0 / (bid_size + ask_size), 2e0) end as liq,
  3e-3 * least(hours / 1000e0, 2e0) as stale from snap),
net as (select *, gross - fee - unc - 1e-2 - stale - liq as net from ed)"""


def edges(df):
    c = F.col
    yes = c("model_p") >= c("mid")
    price = F.when(yes, c("ask")).otherwise(F.lit(1.0) - c("bid"))
    return df.withColumns({
        "yes": yes, "price_side": price, "gross": pr.gross_edge(c("model_p"), price, yes),
        "fee": bk.fee_per_contract(c("ask"), c("fee_rate")),
        "unc": pr.historical_uncertainty(c("model_p"), F.lit(0.02)),
        "liq": pr.liquidity_penalty(c("bid_size") + c("ask_size"), F.lit(10.0)),
        "stale": pr.stale_penalty(c("hours"), 1000.0),
    }).withColumn(
        "net", c("gross") - c("fee") - c("unc") - F.lit(0.01) - c("stale") - c("liq")
    )


@query("f10_edge_arithmetic", f"""with {SNAP}, {EV10}
select market_id, rid, yes, {s6('gross')} as gross, {s6('fee')} as fee, {s6('unc')} as uncertainty,
 {s6('liq')} as liquidity_penalty, {s6('stale')} as stale_penalty, {s6('net')} as net from net""")
def f10(spark, sf):
    return six(edges(tb.snapshots(spark, sf)).select(
        "market_id", "rid", "yes", "gross", "fee", F.col("unc").alias("uncertainty"),
        F.col("liq").alias("liquidity_penalty"), F.col("stale").alias("stale_penalty"), "net",
    ))


@query("k01_top_signals", f"""with {SNAP}, {EV10}
select market_id, rid, {s6('net')} as net from net order by round(net, 6) desc, market_id, rid limit 25""")
def k01(spark, sf):
    return edges(tb.snapshots(spark, sf)).select("market_id", "rid", r6("net").alias("net")).orderBy(
        F.desc("net"), "market_id", "rid"
    ).limit(25)


@query("f11_position_sizing", f"""with {SNAP}, k as (select *, case when ask > 0 and ask < 1
  and model_p * (1e0 - ask) - (1e0 - model_p) * ask > 0 then
  greatest(0e0, least(1e0, (model_p * (1e0 - ask) - (1e0 - model_p) * ask) / nullif(1e0 - ask, 0))) else 0e0 end as kf from snap),
z as (select *, least(kf * 25e-2, 2e-2) as frac, least(least(10000e0 * 5e-3, 10000e0 * least(kf * 25e-2, 2e-2)), liquidity / 2000e0, 200e0) as size,
 least(10000e0 * 5e-3, 10000e0 * least(kf * 25e-2, 2e-2)) as base from k)
select market_id, rid, {s6('kf')} as kelly, {s6('frac')} as fraction, kf * 25e-2 > 2e-2 as at_cap,
 {s6('size')} as notional,
 case when size < base then case when size = liquidity / 2000e0 then 'risk_budget' when size = 200e0 then 'market_cap' end end as capped_by from z""")
def f11(spark, sf):
    c = F.col
    full = pr.kelly(c("model_p"), c("ask"))
    frac = F.least(full * F.lit(0.25), F.lit(0.02))
    equity = F.lit(10000.0)
    sized = pr.capped_size(equity, c("liquidity") / F.lit(2000.0), c("ask"), kelly_notional=equity * frac)
    return six(tb.snapshots(spark, sf).select(
        "market_id", "rid", full.alias("kelly"), frac.alias("fraction"),
        (full * F.lit(0.25) > 0.02).alias("at_cap"), sized.alias("s"),
    ).select(
        "market_id", "rid", "kelly", "fraction", "at_cap", F.col("s.notional").alias("notional"),
        F.col("s.capped_by").alias("capped_by"),
    ))


@query("f13_uncertainty_estimates", f"""with {SNAP}, ce as (
 select category, abs(avg(model_p - outcome)) as err from snap where outcome is not null group by 1),
u as (select s.market_id, s.rid, model_p, err * (5e-1 + 5e-1 * 4e0 * model_p * (1e0 - model_p)) as hist,
  3e-2 + abs(model_p - mid) / 2e0 as dis, spread * 5e-1 as spr from snap s join ce using (category))
select market_id, rid, {s6('hist')} as historical, {s6('dis')} as disagreement, {s6('spr')} as spread_based,
 {s6('greatest(hist, dis, spr)')} as ensemble, {s6('greatest(0, model_p - greatest(hist, dis, spr))')} as lower,
 {s6('least(1, model_p + greatest(hist, dis, spr))')} as upper from u""")
def f13(spark, sf):
    snap = tb.snapshots(spark, sf)
    c = F.col
    errors = snap.where("outcome is not null").groupBy("category").agg(
        F.abs(F.avg(c("model_p") - c("outcome"))).alias("err")
    )
    # One row per category; a shuffle by category would put all rows into as few tasks as there are categories.
    rows = snap.join(F.broadcast(errors), "category").select(
        "market_id", "rid", "model_p",
        pr.historical_uncertainty(c("model_p"), c("err")).alias("historical"),
        # population deviation of two component forecasts is half their distance
        (F.lit(0.03) + F.abs(c("model_p") - c("mid")) / F.lit(2.0)).alias("disagreement"),
        (c("spread") * F.lit(0.5)).alias("spread_based"),
    ).withColumn("ensemble", F.greatest("historical", "disagreement", "spread_based"))
    b = pr.band(c("model_p"), c("ensemble"))
    return six(rows.withColumn("b", b).select(
        "market_id", "rid", "historical", "disagreement", "spread_based", "ensemble",
        F.col("b.lower").alias("lower"), F.col("b.upper").alias("upper"),
    ))


@query("f14_linear_forecasts", f"""with {BOOK}, f as (
 select *, (bb + ba) / 2e0 as mid, ba - bb as sp, (bd - ad) / (bd + ad) as imb,
  (ba * bs + bb * as_) / (bs + as_) as mp from bb where bb is not null and ba is not null),
g as (select event_id, mid, sp,
 greatest(1e-2, least(99e-2, mid + 25e-2 * (mp - mid) + 2e-1 * sp * imb)) as prior,
 greatest(1e-2, least(99e-2, mp + imb * 1e-1)) as micro,
 greatest(5e-2, sp / mid * 5e-1) as u1, greatest(3e-2, sp / mid * 5e-1) as u2 from f)
select event_id, {s6('prior')} as market_prior, {s6('micro')} as microstructure,
 {s6('6e-1 * prior + 4e-1 * micro')} as ensemble,
 {s6('least(greatest(0, prior - u1), greatest(0, micro - u2))')} as lower,
 {s6('greatest(least(1, prior + u1), least(1, micro + u2))')} as upper from g""")
def f14(spark, sf):
    f = bk.features(F.col("bids"), F.col("asks"))
    base = tb.books(spark, sf).select(
        "event_id", f["midpoint"].alias("mid"), f["spread"].alias("sp"),
        f["imbalance"].alias("imb"), f["microprice"].alias("mp"),
    ).where("mid is not null")
    c = F.col
    prior = pr.clamp(
        c("mid") + F.lit(0.25) * (c("mp") - c("mid")) + F.lit(0.2) * c("sp") * c("imb"), 0.01, 0.99
    )
    micro = pr.clamp(c("mp") + c("imb") * F.lit(0.1), 0.01, 0.99)
    rel = c("sp") / c("mid") * F.lit(0.5)
    u1, u2 = F.greatest(F.lit(0.05), rel), F.greatest(F.lit(0.03), rel)
    zero, one = F.lit(0.0), F.lit(1.0)
    return six(base.select(
        "event_id", prior.alias("market_prior"), micro.alias("microstructure"),
        (F.lit(0.6) * prior + F.lit(0.4) * micro).alias("ensemble"),
        F.least(F.greatest(zero, prior - u1), F.greatest(zero, micro - u2)).alias("lower"),
        F.greatest(F.least(one, prior + u1), F.least(one, micro + u2)).alias("upper"),
    ))


@query("f16_resolution_quality", f"""with {DOCS}, q as (
 select doc_id, lower(text) as t, lower(source) as s, length(text) as n, published_us from docs),
w as (select *, (1e0 - case when n > 200 then 1e-1 else 0 end - case when n > 1000 then 1e-1 else 0 end - case when n = 0 then 2e-1 else 0 end) as clarity,
 case when contains(s, 'official') or contains(s, 'government') or contains(s, 'src1') then 9e-1
  when contains(s, 'news') or contains(s, 'reuters') or contains(s, 'ap') or contains(s, 'bloomberg') then 7e-1
  when length(s) > 0 then 5e-1 else 3e-1 end as rel,
 (contains(t, 'number') or contains(t, 'percentage') or contains(t, 'above') or contains(t, 'below') or contains(t, 'date') or contains(t, 'time'))
 and not (contains(t, 'best') or contains(t, 'most') or contains(t, 'should') or contains(t, 'will') or contains(t, 'opinion') or contains(t, 'feel')) as obj from q)
select doc_id, {s6('greatest(0, least(1, clarity * 4e-1 + rel * 3e-1 + 15e-2 + case when obj then 15e-2 else 0 end - case when n < 50 then 1e-1 else 0 end))')} as score,
 {s6('1e-2 + 5e-2 * ((doc_id % 10) / 10e0 + (doc_id % 7) / 14e0) + least(3e-2, 5e-3 * floor((doc_id % 400) / 90e0))')} as penalty from w""")
def f16(spark, sf):
    c = F.col
    return six(tb.documents(spark, sf).select(
        "doc_id",
        pr.quality_score(
            c("text"), c("text"), c("source"), F.lit(True), (*pr.OFFICIAL_WORDS, "src1")
        ).alias("score"),
        pr.resolution_penalty(
            (c("doc_id") % 10) / F.lit(10.0), (c("doc_id") % 7) / F.lit(14.0), (c("doc_id") % 400).cast("double")
        ).alias("penalty"),
    ))


@query("f17_scaled_amounts", """select o_orderkey as id, cast(round(o_totalprice * 100) as bigint) as scaled,
 round(cast(round(o_totalprice * 100) as bigint) / 100e0, 6) as amount,
 round(cast(round(o_totalprice * 100) as bigint) / 10000e0, 6) as price from orders""")
def f17(spark, sf):
    scaled = F.round(F.col("o_totalprice") * 100).cast("bigint")
    exact = scaled.cast("decimal(38,18)")
    return tb.load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), scaled.alias("scaled"),
        r6(exact / F.lit(100)).alias("amount"), r6(exact / F.lit(10000)).alias("price"),
    )


@query("f18_signed_flow", f"""with {TRADES}
select market_slug, cast(sum(case taker_side when 'BUY' then size else -size end) as bigint) as signed_flow,
 cast(sum(size) as bigint) as volume,
 {s6("sum(case taker_side when 'BUY' then size * price else -size * price end)")} as signed_notional
from trades group by 1""")
def f18(spark, sf):
    sign = F.when(F.col("taker_side") == "BUY", 1).when(F.col("taker_side") == "SELL", -1)
    return tb.trades(spark, sf).groupBy("market_slug").agg(
        F.sum(sign * F.col("size")).alias("signed_flow"), F.sum("size").alias("volume"),
        r6(F.sum(sign * F.col("size") * F.col("price"))).alias("signed_notional"),
    )


@query("f19_operating_day", """select event_id,
 strftime(timezone('America/Chicago', ts at time zone 'UTC'), '%Y-%m-%d') as operating_day,
 cast(hour(timezone('America/Chicago', ts at time zone 'UTC')) + 1 as int) as hour_ending from events""")
def f19(spark, sf):
    local = F.from_utc_timestamp(F.timestamp_micros("ts_us"), "America/Chicago")
    return tb.event_rows(spark, sf).select(
        "event_id", F.date_format(local, "yyyy-MM-dd").alias("operating_day"),
        (F.hour(local) + 1).alias("hour_ending"),
    )


@query("f01_utc_normalization", """select event_id, epoch_us(ts) as ts_us,
 epoch_us(ts) - 5 * 3600000000 as shifted_us, 1 as naive_rejected from events""")
def f01(spark, sf):
    at = F.timestamp_micros("ts_us")
    text = F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    offset = r"(Z|[+-]\d\d:?\d\d)$"

    def utc(value):
        """Parse only text that states its offset; naive text becomes null."""
        return F.when(F.regexp_like(value, F.lit(offset)), F.try_to_timestamp(value))

    return tb.event_rows(spark, sf).select(
        "event_id", F.unix_micros(utc(F.concat(text, F.lit("+00:00")))).alias("ts_us"),
        F.unix_micros(utc(F.concat(text, F.lit("+05:00")))).alias("shifted_us"),
        F.when(utc(text).isNull(), 1).otherwise(0).alias("naive_rejected"),
    )
