"""Comparisons of splits and model versions, collector reconciliation, and the four gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scoring as sc
from tidemark.operators import asof
from tidemark.operators import inference as inf
from tidemark.operators import resampling as rs
from tidemark.operators import scores as op
from tidemark.plans.bindings import LEVELS, QT, SNAP, TRADES_ONLY
from tidemark.plans.feeds import RAW
from tidemark.plans.inference import B, draws
from tidemark.plans.pit import DAY, HOUR
from tidemark.plans.registry import query, r6, s6
from tidemark.plans.scores import RES, SPLIT_US, ll, six
from tidemark.sources import rawlog
from tidemark.sources import tables as tb

PIECES = ["n", "p", "y", "se", "ll"]
OOD_SQL = RES + f""", cb as (select category, least(floor(model_p * 10e0), 9) as bin, count(*) as n, sum(model_p) as p, sum(outcome) as y, sum(pow(model_p - outcome, 2)) as se, sum({ll('model_p')}) as ll from res group by 1, 2),
tb as (select bin, sum(n) as n, sum(p) as p, sum(y) as y, sum(se) as se, sum(ll) as ll from cb group by 1),
ct as (select distinct category from cb),
bo as (select category, bin, coalesce(c.n, 0) as n, coalesce(abs(c.p - c.y), 0) as gap, tb.n - coalesce(c.n, 0) as rn, abs(tb.p - coalesce(c.p, 0) - tb.y + coalesce(c.y, 0)) as rgap,
  coalesce(c.se, 0) as se, coalesce(c.ll, 0) as ll, tb.se - coalesce(c.se, 0) as rse, tb.ll - coalesce(c.ll, 0) as rll from ct cross join tb left join cb c using (category, bin)),
m as (select category, sum(n) as held_out, sum(se) / sum(n) as test_brier, sum(ll) / sum(n) as test_ll, sum(gap) / sum(n) as test_ece, sum(rse) / sum(rn) as train_brier, sum(rll) / sum(rn) as train_ll, sum(rgap) / sum(rn) as train_ece from bo group by 1)"""


@query("a38_out_of_domain", f"""with {OOD_SQL}
select category, cast(held_out as bigint) as held_out, {', '.join(s6(x) + f' as {x}' for x in ('test_brier', 'train_brier', 'test_ll', 'train_ll', 'test_ece', 'train_ece'))}, {s6('test_brier - train_brier')} as brier_degradation,
 {s6('test_ll - train_ll')} as ll_degradation, {s6('test_ece - train_ece')} as ece_degradation,
 round(test_brier - train_brier, 9) > 2e-2 or round((test_brier - train_brier) / greatest(train_brier, 1e-10), 9) > 15e-2 as degraded, row_number() over (order by round(test_brier - train_brier, 9) desc, category) as importance_rank from m""")
def a38o(spark, sf):
    """Each category held out against all others: Brier score, log loss and calibration error of both splits.

    Sums per category and probability bin are enough: a split's rest is the total of its bin less
    its own, so no row is read per held-out category.
    """
    c = F.col
    rows = op.resolved(tb.snapshots(spark, sf))
    own = rows.groupBy("category", sc.unit_bin(c("model_p")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("model_p").alias("p"), F.sum(c("outcome").cast("double")).alias("y"),
        F.sum(sc.squared_error(c("model_p"), c("outcome"))).alias("se"), F.sum(sc.log_loss_term(c("model_p"), c("outcome"), 1e-15)).alias("ll"))
    total = own.groupBy("bin").agg(*[F.sum(x).alias(f"t_{x}") for x in PIECES])
    # Ten bins at most, so a category meets its missing bins in an array of ten totals.
    bins = total.agg(F.collect_list(F.struct("bin", *[f"t_{x}" for x in PIECES])).alias("bins")).scalar()
    every = own.select("category").distinct().withColumn("b", F.explode(bins)).select("category", "b.*")
    both = every.join(own, ["category", "bin"], "left").na.fill(0, PIECES)
    rest = {x: c(f"t_{x}") - c(x) for x in PIECES}

    def metrics(name, part):
        n = F.sum(part["n"])
        return [(F.sum(part["se"]) / n).alias(f"{name}_brier"), (F.sum(part["ll"]) / n).alias(f"{name}_ll"), (F.sum(F.abs(part["p"] - part["y"])) / n).alias(f"{name}_ece")]

    m = both.groupBy("category").agg(F.sum("n").alias("held_out"), *metrics("test", {x: c(x) for x in PIECES}), *metrics("train", rest))
    worse = c("test_brier") - c("train_brier")
    rank = F.row_number().over(Window.orderBy(F.round(worse, 9).desc(), "category"))  # one row per category
    return six(m.select(
        "category", "held_out", "test_brier", "train_brier", "test_ll", "train_ll", "test_ece", "train_ece", worse.alias("brier_degradation"),
        (c("test_ll") - c("train_ll")).alias("ll_degradation"), (c("test_ece") - c("train_ece")).alias("ece_degradation"),
        ((F.round(worse, 9) > 0.02) | (F.round(worse / F.greatest(c("train_brier"), F.lit(1e-10)), 9) > 0.15)).alias("degraded"), rank.alias("importance_rank")))


MAX_AGE = 30
VERSION_SQL = RES + f""", v as (select *, ts_us >= {SPLIT_US} as late from res),
mo as (select late, count(*) as n, avg(model_p) as m, stddev_pop(model_p) as sd, avg(outcome) as y, avg(net_edge) as em, stddev_pop(net_edge) as es from v group by 1),
w as (select max(n) filter (late) as n2, max(n) filter (not late) as n1, max(m) filter (late) - max(m) filter (not late) as mean_diff, max(sd) filter (late) - max(sd) filter (not late) as std_diff,
  max(m - y) filter (late) - max(m - y) filter (not late) as calibration_shift, max(em) filter (late) - max(em) filter (not late) as edge_mean_diff, max(es) filter (late) - max(es) filter (not late) as edge_std_diff from mo),
kc as (select model_p, count(*) filter (late) as a, count(*) filter (not late) as b from v group by 1),
ks as (select max(abs(x / n2 - y / n1)) as ks from (select sum(a) over (order by model_p) as x, sum(b) over (order by model_p) as y from kc), w),
js as (select sum(case when p > 0 then 5e-1 * p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then 5e-1 * q * ln(q / ((p + q) / 2)) else 0 end) as js from (
  select category, count(*) filter (not late) / (select n1 from w) as p, count(*) filter (late) / (select n2 from w) as q from v group by 1)),
ag as (select ((select max(ts_us) from v) - {SPLIT_US}) / {DAY}::double as age)"""


@query("a40_version_comparison", f"""with {VERSION_SQL}
select {s6('mean_diff')} as mean_diff, {s6('std_diff')} as std_diff, {s6('ks')} as ks, {s6('greatest(abs(mean_diff), ks)')} as max_abs_diff, {s6('calibration_shift')} as calibration_shift, cast(n2 - n1 as bigint) as count_change,
 {s6('(n2 - n1) * 100e0 / n1')} as count_change_pct, {s6('edge_mean_diff')} as edge_mean_diff, {s6('edge_std_diff')} as edge_std_diff, {s6('js')} as category_shift, {s6('age')} as age_days,
 {s6(f'least(1, greatest(least(1, age / {MAX_AGE}), ks))')} as staleness_score, age > {MAX_AGE} or ks > 0.1 as is_stale,
 concat_ws(',', case when age > {MAX_AGE} then 'age' when age / {MAX_AGE} > 0.7 then 'age_soon' end, case when ks > 0.1 then 'distribution' end, case when abs(calibration_shift) > 5e-2 then 'calibration' end,
  case when (n2 - n1) * 100e0 / n1 > 20 then 'signals' end) as warnings from w, ks, js, ag""")
def a40v(spark, sf):
    """Forecasts before and after the split as two versions: shifts of every kind, age and staleness."""
    c = F.col
    rows = op.resolved(tb.snapshots(spark, sf)).withColumn("late", c("ts_us") >= SPLIT_US)
    y = c("outcome").cast("double")

    def both(fn):
        return fn(F.when(c("late"), 1)), fn(F.when(~c("late"), 1))

    def shift(fn):
        new, old = both(fn)
        return new - old

    m = rows.agg(
        F.count_if("late").alias("n2"), F.count_if(~c("late")).alias("n1"), shift(lambda k: F.avg(k * c("model_p"))).alias("mean_diff"),
        shift(lambda k: F.stddev_pop(k * c("model_p"))).alias("std_diff"), shift(lambda k: F.avg(k * (c("model_p") - y))).alias("calibration_shift"),
        shift(lambda k: F.avg(k * c("net_edge"))).alias("edge_mean_diff"), shift(lambda k: F.stddev_pop(k * c("net_edge"))).alias("edge_std_diff"),
        ((F.max("ts_us") - F.lit(SPLIT_US)) / F.lit(float(DAY))).alias("age_days"))
    ks = inf.ks_statistic(rows.select("model_p", "late"), "model_p", c("late"))
    counts = rows.groupBy("category").agg(F.count_if(~c("late")).alias("a"), F.count_if("late").alias("b"))
    total = counts.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    js = inf.js_divergence(counts.withColumn("t", total).select((c("a") / c("t.a")).alias("p"), (c("b") / c("t.b")).alias("q")))
    t = m.withColumns({"ks": ks.scalar(), "category_shift": js.scalar(), "count_change_pct": (c("n2") - c("n1")) * F.lit(100.0) / c("n1")})
    age = c("age_days") / F.lit(float(MAX_AGE))
    warnings = F.concat_ws(",", F.when(age > 1, "age").when(age > 0.7, "age_soon"), F.when(c("ks") > 0.1, "distribution"),
                           F.when(F.abs("calibration_shift") > 0.05, "calibration"), F.when(c("count_change_pct") > 20, "signals"))
    return six(t.select(
        "mean_diff", "std_diff", "ks", F.greatest(F.abs("mean_diff"), c("ks")).alias("max_abs_diff"), "calibration_shift", (c("n2") - c("n1")).alias("count_change"), "count_change_pct",
        "edge_mean_diff", "edge_std_diff", "category_shift", "age_days", F.least(F.lit(1.0), F.greatest(F.least(F.lit(1.0), age), c("ks"))).alias("staleness_score"),
        ((age > 1) | (c("ks") > 0.1)).alias("is_stale"), warnings.alias("warnings")))


RECONCILE_US = 6 * HOUR


@query("a52_reconciliation", f"""with {QT}, t as (select event_id, market_slug, ts_us, price from trades),
m as (select t.*, q.mid, q.spread, q.ts_us as q_us from t asof left join quotes q on q.market_slug = t.market_slug and t.ts_us >= q.ts_us),
r as (select ts_us // {DAY} as day, mid is not null and ts_us - q_us <= {RECONCILE_US} as comparable, round(abs(price - mid) - spread - 10e-2, 9) <= 0 as agrees from m)
select day, count(*) as records, count(*) filter (where comparable) as reconcile_total, count(*) filter (where comparable and agrees) as reconcile_matches,
 count(*) filter (where comparable and not agrees) as reconcile_mismatches, {s6('count(*) filter (where comparable and agrees) / nullif(count(*) filter (where comparable), 0)')} as reconciliation_rate,
 coalesce(count(*) filter (where comparable and not agrees) / nullif(count(*) filter (where comparable), 0), 0) <= 0.01 as bounded from r group by 1""")
def a52r(spark, sf):
    """Trades against the quote in force: a recent quote makes them comparable, a price near it makes them agree."""
    c = F.col
    quotes = tb.quotes(spark, sf).withColumn("q_us", c("ts_us"))
    met = asof.asof_join(tb.trades(spark, sf), quotes, ["market_slug"], "ts_us", "q_us", ["mid", "spread", "q_us"], "at", tie=c("event_id"))
    rows = met.select(F.floor(c("ts_us") / DAY).cast("long").alias("day"), F.coalesce(c("ts_us") - c("at.q_us") <= RECONCILE_US, F.lit(False)).alias("comparable"),
                      (F.round(F.abs(c("price") - c("at.mid")) - c("at.spread") - F.lit(0.10), 9) <= 0).alias("agrees"))
    total, good = F.count_if("comparable"), F.count_if(c("comparable") & c("agrees"))
    return six(rows.groupBy("day").agg(F.count(F.lit(1)).alias("records"), total.alias("reconcile_total"), good.alias("reconcile_matches")).withColumn(
        "reconcile_mismatches", c("reconcile_total") - c("reconcile_matches")).withColumns({
            "reconciliation_rate": F.try_divide("reconcile_matches", "reconcile_total"),
            "bounded": F.coalesce(F.try_divide("reconcile_mismatches", "reconcile_total"), F.lit(0.0)) <= 0.01}))
