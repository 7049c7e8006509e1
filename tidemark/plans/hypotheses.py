"""Hypothesis sets H1-H5 and P1-P5 over books and trades: effects, controls, corrections, decisions.

Both sets test the same five signals and differ in costs and controls:

1. order-book imbalance and the move over the shortest horizon,
2. microprice displacement and the move over the middle one,
3. trailing signed trade flow and its continuation over the middle one,
4. the maker's markout of each trade over the shortest one, predicted negative,
5. change of the depth difference and the move over the longest one.

The data's quotes are hours apart, so one hour here stands for one second of a live feed.
Clusters are market days.
"""

from functools import reduce

from pyspark.sql import functions as F

from tidemark.functions import book as bk
from tidemark.operators import asof
from tidemark.operators import inference as inf
from tidemark.operators import resampling as rs
from tidemark.operators.ordered import nearest_rank, rolling, rolling_range
from tidemark.plans.bindings import LEVELS, TRADES_ONLY
from tidemark.plans.inference import B
from tidemark.plans.pit import DAY, HOUR
from tidemark.plans.registry import query, s6
from tidemark.plans.scores import six
from tidemark.session import checkpointed
from tidemark.sources import tables as tb

SHORT, MIDDLE, LONG, TOLERANCE = 1, 5, 30, 12
HORIZONS = {1: SHORT, 2: MIDDLE, 3: MIDDLE, 4: SHORT, 5: LONG}
MEASURES = ["spread", "depth", "tte", "vol"]
# Clusters a promotion and a kill need, agreeing price fifths and halves, costs.
PROMOTE_CLUSTERS, KILL_CLUSTERS, PRICE_AGREE, AGREE = 160, 40, 4, 2
HALF_SPREAD, FLAT_FEE, CURVED_FEE = 0.5, 0.07, 0.0695

OBS_SQL = LEVELS + f""", {TRADES_ONLY},
bk as (select market_slug, event_id, ts_us, any_value(mid) as mid, sum(size) filter (side = 'bid') as bd, sum(size) filter (side = 'ask') as ad,
  max(price) filter (side = 'bid') as bb, min(price) filter (side = 'ask') as ba, arg_max(size, price) filter (side = 'bid') as bs, arg_min(size, price) filter (side = 'ask') as as_
 from lv group by 1, 2, 3 having count(*) filter (side = 'bid') > 0 and count(*) filter (side = 'ask') > 0),
b1 as (select *, ba - bb as spread, bd + ad as depth, ln(mid / lag(mid) over (partition by market_slug order by ts_us, event_id)) as lr,
  first_value(ad - bd) over (partition by market_slug order by ts_us range between {MIDDLE * HOUR} preceding and current row) as d0,
  min(ts_us) over (partition by market_slug) as t0, max(ts_us) over (partition by market_slug) as t1 from bk),
b2 as (select *, coalesce(stddev_samp(lr) over (partition by market_slug order by ts_us, event_id rows between 30 preceding and 1 preceding), 0) as vol,
  case when t1 > t0 then (ts_us - t0) / (t1 - t0)::double else 5e-1 end as tte from b1),
sg as (
 select unnest([1, 2, 5]) as no, unnest([sign(bd - ad), sign((ba * bs + bb * as_) / (bs + as_) - (bb + ba) / 2e0), sign(ad - bd - d0)]) as s,
   unnest([{SHORT}, {MIDDLE}, {LONG}]) as h, market_slug, ts_us, mid as m0, spread, depth, mid, tte, vol from b2
 union all
 select unnest([3, 4]), unnest([sign(sum(case when taker_side = 'BUY' then size else -size end) over (partition by market_slug order by ts_us range between {SHORT * HOUR} preceding and current row)),
   case when taker_side = 'BUY' then -1 else 1 end]), unnest([{MIDDLE}, {SHORT}]), market_slug, ts_us, null, null, null, null, null, null from trades),
s0 as (select g.*, coalesce(g.m0, b.mid) as start from sg g asof left join bk b on b.market_slug = g.market_slug and g.ts_us >= b.ts_us where s <> 0),
pv as (select g.*, g.ts_us + h * {HOUR} as target from s0 g where start is not null),
p1 as (select p.*, b.ts_us as bt, b.mid as bm, b.ba - b.bb as bsp from pv p asof left join bk b on b.market_slug = p.market_slug and p.target >= b.ts_us),
p2 as (select p.*, b.ts_us as nt, b.mid as nm, b.ba - b.bb as nsp from p1 p asof left join bk b on b.market_slug = p.market_slug and p.target < b.ts_us),
p3 as (select *, bt is not null and (nt is null or target - bt <= nt - target) as back from p2),
ob as (select no, market_slug, ts_us // {DAY} as day, market_slug || '|' || (ts_us // {DAY}) as cluster, s * (case when back then bm else nm end - start) as gross,
  case when back then bm else nm end as fm, case when back then bsp else nsp end as fs, spread, depth, mid, tte, vol
 from p3 where abs(target - case when back then bt else nt end) <= {TOLERANCE * HOUR}),
nt as (
 select 'H' as family, *, gross - {HALF_SPREAD} * fs - {FLAT_FEE} * fm as net from ob
 union all select 'P', *, gross - {HALF_SPREAD} * fs - {CURVED_FEE} * fm * (1e0 - fm) from ob),
cl as (select family, no, cluster, sum(net) as sn, sum(gross) as sg, count(*) as n, any_value(market_slug) as market, any_value(day) as day from nt group by 1, 2, 3),
st as (select family, no, b, sum(w * sn) / sum(w * n) as m from {rs.weights_sql(B, 'cluster')} group by 1, 2, 3),
pw as (select family, no, count(*) filter (case when no = 4 then m >= 0 else m <= 0 end) / count(*) as p, list_sort(list(m)) as s from st group by 1, 2),
g as (select family, no, cast(sum(n) as bigint) as labelled, count(*) as clusters, count(distinct market) as tickers, count(distinct day) as days, sum(sg) / sum(n) as gross, sum(sn) / sum(n) as net from cl group by 1, 2),
rk as (select g.*, p, s[{int(0.025 * B) + 1}] as lo, s[{int(0.975 * B) + 1}] as hi, row_number() over (partition by family order by p, no) as i, count(*) over (partition by family) as m from g join pw using (family, no)),
ho as (select *, least(1, max(p * (m - i + 1)) over (partition by family order by i)) as holm from rk),
ml as (select no, unnest({MEASURES}) as measure, unnest([spread, depth, tte, vol]) as v from ob where spread is not null),
mr as (select *, row_number() over (partition by no, measure order by v) as r, count(*) over (partition by no, measure) as n from ml),
md as (select no, measure, max(v) filter (r = n // 4 + 1) as q1, max(v) filter (r = n // 2 + 1) as q2, max(v) filter (r = 3 * n // 4 + 1) as q3 from mr group by 1, 2),
mw as (select no, max(q2) filter (measure = 'spread') as spread, max(q1) filter (measure = 'depth') as d1, max(q2) filter (measure = 'depth') as d2, max(q3) filter (measure = 'depth') as d3,
  max(q2) filter (measure = 'tte') as tte, max(q2) filter (measure = 'vol') as vol from md group by 1),
bu as (select family, no, net, unnest(['spread', 'depth', 'price', 'time', 'volatility', 'liquidity']) as control, unnest([(n.spread >= w.spread)::int, (n.depth >= d2)::int,
  least(4, floor(mid / 2e-1))::int, (n.tte >= w.tte)::int, (n.vol >= w.vol)::int, (n.depth >= d1)::int + (n.depth >= d2)::int + (n.depth >= d3)::int]) as bucket
 from nt n join mw w using (no) where n.spread is not null),
bb as (select family, no, control, bucket, avg(net) as m from bu group by all),
ct as (select bb.family, bb.no, control, case when count(*) filter (m * case when net > 0 then 1 else -1 end > 0) >= case control when 'price' then {PRICE_AGREE} else {AGREE} end then 'PASS' else 'FAIL' end as status
 from bb join g on g.family = bb.family and g.no = bb.no group by 1, 2, 3),
cw as (select family, no, {', '.join(f"max(status) filter (control = '{c}') as {c}" for c in ('spread', 'depth', 'price', 'time', 'volatility', 'liquidity'))} from ct group by 1, 2)"""

CONTROLS = ["spread", "depth", "price", "time", "volatility"]


@query("a62_hypotheses", f"""with {OBS_SQL}
select family || no as hypothesis, case no {' '.join(f'when {k} then {h}' for k, h in HORIZONS.items())} end as horizon, labelled, clusters, tickers, days, {s6('gross')} as gross, {s6('net')} as net, {s6('lo')} as ci_lower, {s6('hi')} as ci_upper,
 {s6('p')} as p_raw, {s6('holm')} as p_holm, {', '.join(f"case when family = 'H' then {c} end as {c}_control" for c in CONTROLS)}, case when family = 'P' then liquidity end as liquidity_strata,
 case when clusters >= {PROMOTE_CLUSTERS} and holm < 5e-2 and net * case when no = 4 then -1 else 1 end > 0 and (family = 'P' or no in (3, 4) or ({' and '.join(f"{c} = 'PASS'" for c in CONTROLS)})) then 'PROMOTE'
  when clusters >= {KILL_CLUSTERS} and case when no = 4 then lo > 0 else hi < 0 end then 'KILL' else 'CONTINUE' end as decision
from ho left join cw using (family, no)""")
def a62h(spark, sf):
    return six(evaluated(observations(tb.books(spark, sf), tb.trades(spark, sf))))


def book_series(books, prof=None):
    """Two-sided books with the features that condition a hypothesis."""
    c = F.col
    two = books.where((F.size("bids") > 0) & (F.size("asks") > 0))
    base = two.select(
        "market_slug", "event_id", "ts_us", "mid", (bk.best(c("asks")) - bk.best(c("bids"))).alias("spread"), bk.depth(c("bids"), 5).alias("bd"),
        bk.depth(c("asks"), 5).alias("ad"), (bk.microprice(c("bids"), c("asks")) - bk.mid(c("bids"), c("asks"))).alias("shift"))

    def volatility(df, w):
        moves = df.withColumn("lr", F.ln(c("mid") / F.lag("mid").over(w)))
        return moves.withColumn("vol", F.coalesce(F.stddev_samp("lr").over(w.rowsBetween(-30, -1)), F.lit(0.0))).drop("lr")

    moved = rolling(base, ["market_slug"], "ts_us", ["event_id"], 31, volatility, prof=prof)
    earlier = rolling_range(moved, ["market_slug"], "ts_us", MIDDLE * HOUR, lambda df, w: df.withColumn(
        "d0", F.first(c("ad") - c("bd")).over(w.rangeBetween(-MIDDLE * HOUR, 0))), prof=prof)
    ends = base.groupBy("market_slug").agg(F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    tte = F.when(c("t1") > c("t0"), (c("ts_us") - c("t0")) / (c("t1") - c("t0"))).otherwise(0.5)
    return earlier.join(ends, "market_slug").withColumns({"tte": tte, "depth": c("bd") + c("ad")}).drop("t0", "t1")


def observations(books, trades):
    """One row per signal with a book near its horizon: ``no``, cluster, gross move, future mid and spread, controls.

    Every signal probes the book series once, at its own horizon, so each book and trade meets
    the series in one ordered pass. All passes share one profile of the markets, and the series
    is written once for all that read it.
    """
    c = F.col
    prof = asof.stream_profile(books, trades, ["market_slug"], "ts_us", "ts_us")
    series = checkpointed(book_series(books, prof))
    quotes = series.select("market_slug", "event_id", c("ts_us").alias("q_us"), "mid", "spread")

    def signals(df, kinds):
        cases = [F.struct(F.lit(no).alias("no"), F.signum(s).alias("s"), F.lit(HORIZONS[no]).alias("h")) for no, s in kinds]
        return df.withColumn("x", F.explode(F.array(*cases))).where("x.s <> 0").select("*", "x.*").drop("x")

    own = signals(series, [(1, c("bd") - c("ad")), (2, c("shift")), (5, c("ad") - c("bd") - c("d0"))]).select(
        "no", "s", "h", "market_slug", "ts_us", c("mid").alias("start"), "spread", "depth", "mid", "tte", "vol")
    signed = trades.withColumn("flow1", F.when(c("taker_side") == "BUY", c("size")).otherwise(-c("size")))
    flows = rolling_range(signed, ["market_slug"], "ts_us", SHORT * HOUR, lambda df, w: df.withColumn(
        "flow", F.sum("flow1").over(w.rangeBetween(-SHORT * HOUR, 0))), prof=prof)
    met = asof.asof_join(flows, quotes, ["market_slug"], "ts_us", "q_us", ["mid"], "at", tie=c("event_id"), prof=prof).where("at is not null")
    made = signals(met, [(3, c("flow").cast("double")), (4, F.when(c("taker_side") == "BUY", -1.0).otherwise(1.0))]).select(
        "no", "s", "h", "market_slug", "ts_us", c("at.mid").alias("start"))
    probes = own.unionByName(made, allowMissingColumns=True).withColumn("target_us", c("ts_us") + c("h").cast("long") * F.lit(HOUR))
    near = asof.nearest_join(probes, quotes.withColumnsRenamed({"mid": "fm", "spread": "fs"}), ["market_slug"], "target_us", "q_us", ["fm", "fs"],
                             F.lit(TOLERANCE * HOUR), tie=c("event_id"), prof=prof).where("near is not null")
    day = F.floor(c("ts_us") / F.lit(DAY))
    return near.select("no", "market_slug", day.alias("day"), F.concat_ws("|", "market_slug", day).alias("cluster"), (c("s") * (c("near.fm") - c("start"))).alias("gross"),
                       c("near.fm").alias("fm"), c("near.fs").alias("fs"), "spread", "depth", "mid", "tte", "vol")


def controls(net):
    """PASS or FAIL per family, hypothesis and control: does the sign of the mean hold in enough buckets?

    Medians and quartiles are order statistics of counted values; buckets are plain sums.
    """
    c = F.col
    rows = net.where("spread is not null")
    tall = rows.where("family = 'H'").select("no", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), c(m).cast("double").alias("v")) for m in MEASURES])).alias("x")).select("no", "x.*")
    ranks = {"q1": lambda n: F.floor(n / 4) + 1, "q2": lambda n: F.floor(n / 2) + 1, "q3": lambda n: F.floor(3 * n / 4) + 1}
    cut = nearest_rank(tall, ["no", "measure"], "v", ranks).groupBy("no").agg(*[
        F.max(F.when(c("measure") == m, c(q))).alias(f"{m}_{q}") for m, q in (("spread", "q2"), ("depth", "q1"), ("depth", "q2"), ("depth", "q3"), ("tte", "q2"), ("vol", "q2"))])

    def above(measure, q="q2"):
        return (c(measure) >= c(f"{measure}_{q}")).cast("int")

    fifth = F.least(F.lit(4), F.floor(c("mid") / F.lit(0.2))).cast("int")
    kinds = {"spread": above("spread"), "depth": above("depth"), "price": fifth, "time": above("tte"), "volatility": above("vol"),
             "liquidity": above("depth", "q1") + above("depth") + above("depth", "q3")}
    buckets = rows.join(cut, "no").select("family", "no", "net", F.explode(F.array(*[
        F.struct(F.lit(k).alias("control"), v.alias("bucket")) for k, v in kinds.items()])).alias("x")).groupBy("family", "no", "x.control", "x.bucket").agg(
        F.avg("net").alias("m"))
    overall = net.groupBy("family", "no").agg(F.when(F.avg("net") > 0, 1).otherwise(-1).alias("sign"))
    need = F.when(c("control") == "price", PRICE_AGREE).otherwise(AGREE)
    status = buckets.join(overall, ["family", "no"]).groupBy("family", "no", "control").agg(F.count_if(c("m") * c("sign") > 0).alias("ok"))
    return status.withColumn("status", F.when(c("ok") >= need, "PASS").otherwise("FAIL")).groupBy("family", "no").agg(
        *[F.max(F.when(c("control") == k, c("status"))).alias(k) for k in kinds])


def evaluated(rows, replicates=B):
    """Effect, interval, corrected p value, controls and decision of every hypothesis of both sets."""
    c = F.col
    rows = checkpointed(rows)
    cost = F.lit(HALF_SPREAD) * c("fs")
    nets = {"H": c("gross") - cost - F.lit(FLAT_FEE) * c("fm"), "P": c("gross") - cost - F.lit(CURVED_FEE) * c("fm") * (F.lit(1.0) - c("fm"))}
    net = rows.withColumn("x", F.explode(F.array(*[F.struct(F.lit(k).alias("family"), v.alias("net")) for k, v in nets.items()]))).select("*", "x.*").drop("x")
    keys = ["family", "no"]
    clusters = checkpointed(net.groupBy(*keys, "cluster").agg(F.sum("net").alias("sn"), F.sum("gross").alias("sg"), F.count(F.lit(1)).alias("n"),
                                                 F.first("market_slug").alias("market"), F.first("day").alias("day")))
    found = clusters.groupBy(*keys).agg(F.sum("n").alias("labelled"), F.countDistinct("market").alias("tickers"), F.countDistinct("day").alias("days"),
                                        (F.sum("sg") / F.sum("n")).alias("gross"))
    worse = F.filter("stats", lambda m: F.when(c("no") == 4, m >= 0).otherwise(m <= 0))
    drawn = rs.bootstrap(clusters, "cluster", ["sn", "n"], F.try_divide, replicates, keys=keys).withColumns({
        "p_raw": F.size(worse) / F.size("stats"), "ci_upper": F.get("stats", F.lit(int(0.975 * replicates))), "net": c("estimate")}).drop("stats")
    t = inf.adjust(drawn.join(found, keys), ["family"], "p_raw", "no").join(controls(net), keys, "left")
    maker, h = c("no") == 4, c("family") == "H"
    steady = reduce(lambda a, b: a & b, [c(k) == "PASS" for k in CONTROLS])
    promoted = (c("clusters") >= PROMOTE_CLUSTERS) & (c("holm") < 0.05) & (c("net") * F.when(maker, -1).otherwise(1) > 0) & (~h | c("no").isin(3, 4) | steady)
    killed = (c("clusters") >= KILL_CLUSTERS) & F.when(maker, c("ci_lower") > 0).otherwise(c("ci_upper") < 0)
    horizon = F.element_at(F.create_map(*[F.lit(x) for kv in HORIZONS.items() for x in kv]), c("no"))
    return t.select(
        F.concat("family", "no").alias("hypothesis"), horizon.alias("horizon"), "labelled", "clusters", "tickers", "days", "gross", "net", "ci_lower", "ci_upper", "p_raw",
        c("holm").alias("p_holm"), *[F.when(h, c(k)).alias(f"{k}_control") for k in CONTROLS], F.when(~h, c("liquidity")).alias("liquidity_strata"),
        F.when(promoted, "PROMOTE").when(killed, "KILL").otherwise("CONTINUE").alias("decision"))
