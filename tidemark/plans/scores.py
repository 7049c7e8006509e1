"""Scoring queries: benchmark, buckets, consensus, sampling hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as sc
from tidemark.operators import scores as op
from tidemark.plans.bindings import FC, FILLS, SNAP
from tidemark.plans.registry import query, r6, s6
from tidemark.sources import tables as tb

SPLIT_US = 883_612_800_000_000  # 1998-01-01, start of the evaluation period

RES = SNAP + ", res as (select * from snap where outcome is not null)"
LL = "case when outcome = 1 then -ln({c}) else -ln(1e0 - {c}) end"


def ll(p: str, eps: str = "1e-15") -> str:
    return LL.format(c=f"greatest({eps}, least(1e0 - {eps}, {p}))")


def case(expr: str, edges) -> str:
    parts = []
    for lo, hi, label in edges:
        upper = "" if hi == float("inf") else f" and {expr} < {float(hi)!r}::double"
        parts.append(f"when {expr} >= {float(lo)!r}::double{upper} then '{label}'")
    return "case " + " ".join(parts) + " end"


def six(df, *keep):
    """Round every floating column except the named ones."""
    return df.select(*[
        r6(c).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes
    ])


MICRO = "(ask * bid_size + bid * ask_size) / (bid_size + ask_size)"


@query("a01_brier", f"""with {RES}
select count(*) as n, {s6('avg(pow(model_p - outcome, 2))')} as model_brier,
 {s6('avg(pow(mid - outcome, 2))')} as market_brier,
 {s6(f'avg(pow({MICRO} - outcome, 2))')} as micro_brier from res""")
def a01(spark, sf):
    return six(op.brier(tb.snapshots(spark, sf)))


@query("a02_log_loss", f"""with {RES}
select {s6(f'avg({ll("model_p")})')} as model_log_loss, {s6(f'avg({ll("mid")})')} as market_log_loss,
 {s6(f'avg({ll("model_p", "1e-12")})')} as model_log_loss_calibration from res""")
def a02(spark, sf):
    return six(op.log_losses(tb.snapshots(spark, sf)))


@query("a03_reliability_table", f"""with {RES}, b as (
 select least(cast(floor(model_p * 10e0) as int), 9) as bin, count(*) n, avg(model_p) p, avg(outcome) y
 from res group by 1)
select cast(g.i as int) as bin, {s6('g.i / 10e0')} as lower, {s6('(g.i + 1) / 10e0')} as upper,
 coalesce(n, 0) as n, {s6('p')} as predicted, {s6('y')} as observed
from range(10) g(i) left join b on b.bin = g.i""")
def a03(spark, sf):
    return six(op.reliability_table(op.resolved(tb.snapshots(spark, sf)), "model_p", "outcome"))


@query("a03_ece_by_category", f"""with {RES}, b as (
 select category, least(cast(floor(model_p * 10e0) as int), 9) as bin, count(*) n,
  avg(model_p) p, avg(outcome) y from res group by all)
select category, cast(sum(n) as bigint) as n, {s6('sum(n * abs(p - y)) / sum(n)')} as ece
from b group by 1""")
def a03b(spark, sf):
    return six(op.ece(op.resolved(tb.snapshots(spark, sf)), "model_p", "outcome", keys=["category"]))


def bench_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    on = f"using ({keys})" if keys else "on true"
    return f"""with {RES}, e as (
 select {k}count(*) n, avg(pow(mid - outcome, 2)) bm, avg(pow(model_p - outcome, 2)) bp,
  avg(pow({MICRO} - outcome, 2)) bx, avg({ll('mid')}) lm, avg({ll('model_p')}) lp, avg({MICRO}) mx,
  count(*) filter (where abs(mid - outcome) < abs(model_p - outcome)) kw,
  count(*) filter (where abs(model_p - outcome) < abs(mid - outcome)) mw,
  count(*) filter (where abs(model_p - outcome) = abs(mid - outcome)) t,
  avg(mid) am, avg(model_p) ap, avg(outcome) ay from res {'group by ' + keys if keys else ''}),
pe as (select {k}sum(abs(s)) / sum(n) as pece from (
  select {k}least(floor(model_p * 10e0), 9) b, sum(model_p - outcome) s, count(*) n from res group by all)
  {'group by ' + keys if keys else ''}),
me as (select {k}sum(abs(s)) / sum(n) as mece from (
  select {k}least(floor(mid * 10e0), 9) b, sum(mid - outcome) s, count(*) n from res group by all)
  {'group by ' + keys if keys else ''})
select {k}n as resolved_count, {s6('bm')} as market_brier, {s6('bp')} as model_brier,
 {s6('bm - bp')} as delta_brier, {s6('lm')} as market_log_loss, {s6('lp')} as model_log_loss,
 {s6('lm - lp')} as delta_log_loss, {s6('mece')} as market_ece, {s6('pece')} as model_ece,
 {s6('mece - pece')} as delta_ece, {s6('mx')} as market_microprice,
 {s6('bx - bp')} as delta_brier_microprice, kw as market_wins, mw as model_wins, t as ties,
 {s6('am')} as market_predicted_mean, {s6('ap')} as model_predicted_mean, {s6('ay')} as outcome_mean
from e join pe {on} join me {on}"""


@query("a04_market_benchmark", bench_sql(""))
def a04(spark, sf):
    return six(op.market_benchmark(tb.snapshots(spark, sf)))


@query("a04_market_benchmark_by_category", bench_sql("category"))
def a04c(spark, sf):
    return six(op.market_benchmark(tb.snapshots(spark, sf), ["category"]))


@query("a05_model_market_matrix", f"""with {RES}, m as (
 select least(cast(floor(model_p * 5e0) as int), 4) as b, * from res)
select coalesce(b, -1) as bucket, count(*) as n, {s6('avg(pow(model_p - outcome, 2))')} as model_brier,
 {s6('avg(pow(mid - outcome, 2))')} as market_brier,
 {s6('avg(pow(mid - outcome, 2)) - avg(pow(model_p - outcome, 2))')} as delta_brier,
 count(*) filter (where abs(model_p - outcome) < abs(mid - outcome)) as model_wins,
 count(*) filter (where abs(mid - outcome) < abs(model_p - outcome)) as market_wins,
 count(*) filter (where abs(mid - outcome) = abs(model_p - outcome)) as ties,
 {s6('avg(outcome)')} as mean_outcome
from m group by rollup(b)""")
def a05(spark, sf):
    return six(op.model_market_matrix(tb.snapshots(spark, sf)))


HITM = "cast((model_p >= 0.5) = (outcome = 1) as int)"
HITK = "cast((mid >= 0.5) = (outcome = 1) as int)"


@query("a06_disagreement_buckets", f"""with {RES}
select {case('abs(model_p - mid)', sc.DISAGREEMENT_EDGES)} as bucket, count(*) as n,
 {s6('avg(pow(model_p - outcome, 2))')} as model_brier, {s6('avg(pow(mid - outcome, 2))')} as market_brier,
 {s6(f'avg({HITM})')} as win_rate, {s6(f'avg({HITK})')} as market_correct,
 {s6('avg(model_p)')} as mean_model, {s6('avg(mid)')} as mean_mid, {s6('avg(outcome)')} as mean_outcome,
 {s6('avg(hours)')} as holding_hours
from res group by 1""")
def a06(spark, sf):
    return six(op.disagreement(tb.snapshots(spark, sf)))


@query("a06_disagreement_summary", f"""with {RES}
select {s6('avg(abs(model_p - mid))')} as total_disagreement,
 {s6(f'coalesce(corr(abs(model_p - mid), {HITM}), 0)')} as correlation from res""")
def a06s(spark, sf):
    return six(op.disagreement_summary(tb.snapshots(spark, sf)))


def _mid(a, b):
    return (a + (b if b != float("inf") else a + 500)) / 2


HB = f"""hb as (select {case('(resolved_us - ts_us) / 36e8', sc.HORIZON_EDGES)} as bucket,
 cast({case('(resolved_us - ts_us) / 36e8', [(a, b, _mid(a, b)) for a, b, _ in sc.HORIZON_EDGES])} as double) as midpoint,
 count(*) as n, avg(pow(model_p - outcome, 2)) mb, avg(pow(mid - outcome, 2)) kb, avg({HITM}) da,
 avg(model_p) mm, avg(mid) mk, avg(outcome) mo
from res where resolved_us >= ts_us group by 1, 2)"""


@query("a07_horizon_buckets", f"""with {RES}, {HB}
select bucket, midpoint, n, {s6('mb')} as model_brier, {s6('kb')} as market_brier,
 {s6('da')} as directional_accuracy, {s6('mm')} as mean_model, {s6('mk')} as mean_mid,
 {s6('mo')} as mean_outcome from hb""")
def a07(spark, sf):
    return six(op.horizon_buckets(tb.snapshots(spark, sf)))


@query("a07_horizon_summary", f"""with {RES}, {HB}
select count(*) as buckets, {s6('regr_slope(mb, midpoint)')} as decay_rate,
 min_by(bucket, mb) as best_horizon, max_by(bucket, mb) as worst_horizon from hb""")
def a07s(spark, sf):
    return six(op.horizon_summary(tb.snapshots(spark, sf)))


CATS = f"""cats as (
 select category, count(*) as n, avg(pow(model_p - outcome, 2)) mb, avg(pow(mid - outcome, 2)) kb,
  avg({ll('model_p')}) l, avg({HITM}) da, avg(model_p) mm, avg(outcome) mo,
  count(*) filter (where filled) / count(*) fr, count(distinct event_cluster) cl
 from res group by 1),
cece as (select category, sum(abs(s)) / sum(n) as ece from (
  select category, least(floor(model_p * 10e0), 9) b, sum(model_p - outcome) s, count(*) n
  from res group by all) group by 1)"""


@query("a08_category_metrics", f"""with {RES}, {CATS}
select category, n, {s6('mb')} as model_brier, {s6('kb')} as market_brier, {s6('l')} as log_loss,
 {s6('ece')} as ece, {s6('da')} as directional_accuracy, {s6('mm')} as mean_model,
 {s6('mo')} as mean_outcome, {s6('fr')} as fill_rate, cl as clusters, {s6('kb - mb')} as delta_brier
from cats join cece using (category)""")
def a08(spark, sf):
    return six(op.categories(tb.snapshots(spark, sf)))


@query("k02_best_worst_category", f"""with {RES}, {CATS}
select max_by(category, kb - mb) as best_category, min_by(category, kb - mb) as worst_category,
 {s6('sum((kb - mb) * n) / sum(n)')} as overall_delta_brier from cats""")
def k02(spark, sf):
    return six(op.category_summary(tb.snapshots(spark, sf)))


@query("a09_ensemble_consensus", f"""with {SNAP}, st as (
 select market_id, count(*) as members, avg(model_p) mean, stddev_samp(model_p) sd, median(model_p) med,
  min(model_p) lo, max(model_p) hi from snap group by 1 having count(*) > 1),
dev as (select market_id, abs(model_p - med) as dv,
  row_number() over (partition by market_id order by abs(model_p - med)) rn, members
  from snap join st using (market_id))
select market_id, members, {s6('mean')} as mean, {s6('sd')} as std, {s6('lo')} as lo, {s6('hi')} as hi,
 {s6('med')} as median, {s6('dv')} as mad, {s6('hi - lo')} as disagreement
from st join (select market_id, dv from dev where rn = members // 2 + 1) using (market_id)""")
def a09(spark, sf):
    return six(op.consensus(tb.snapshots(spark, sf)))


def regime_sql(value, edges):
    pnl = ("case when model_p > mid then (model_p - mid) - spread / 2e0 else 0 end")
    return f"""with {SNAP}
select {case(value, edges)} as bucket, count(*) as n,
 {s6('coalesce(avg(pow(model_p - outcome, 2)), 0)')} as model_brier,
 {s6('coalesce(avg(pow(mid - outcome, 2)), 0)')} as market_brier,
 {s6('avg(spread)')} as avg_spread, {s6('avg(bid_size + ask_size)')} as avg_depth,
 {s6('avg(net_edge)')} as net_edge,
 {s6(f'coalesce(avg({pnl}) filter (where outcome is not null), 0)')} as realized_pnl,
 {s6('coalesce(avg(pow(mid - outcome, 2)), 0) - coalesce(avg(pow(model_p - outcome, 2)), 0)')} as delta_brier,
 abs(coalesce(avg(pow(mid - outcome, 2)), 0) - coalesce(avg(pow(model_p - outcome, 2)), 0)) < 0.01 as is_efficient
from snap group by 1"""


@query("a10_liquidity_regimes", regime_sql("liquidity", sc.LIQUIDITY_EDGES))
def a10(spark, sf):
    return six(op.regime_buckets(tb.snapshots(spark, sf), "liquidity", sc.LIQUIDITY_EDGES))


@query("a10_spread_regimes", regime_sql("round(spread, 9)", sc.SPREAD_EDGES))
def a10s(spark, sf):
    snap = tb.snapshots(spark, sf).withColumn("spread9", F.round("spread", 9))
    return six(op.regime_buckets(snap, "spread9", sc.SPREAD_EDGES))


@query("a11_sampling_hierarchy", f"""with {SNAP}
select count(*) as raw_rows, count(distinct market_id) as markets,
 count(distinct event_cluster) as clusters, count(outcome) as resolved_rows,
 count(distinct case when outcome is not null then market_id end) as resolved_markets from snap""")
def a11(spark, sf):
    return op.sampling_hierarchy(tb.snapshots(spark, sf))


@query("a12_effective_sample_size", f"""with {RES}, c as (
 select event_cluster, count(*) n, avg(model_p) m, var_pop(model_p) v from res group by 1),
s as (select sum(n) n, count(*) k,
  sum(n * pow(m - (select avg(model_p) from res), 2)) / (count(*) - 1) as msb,
  sum(n * v) / (sum(n) - count(*)) as msw from c),
t as (select *, msb / (msb + msw) as icc, n / k as sz from s)
select cast(n as bigint) as nominal, k as clusters, {s6('sz')} as avg_cluster_size, {s6('icc')} as icc,
 {s6('1 + (sz - 1) * icc')} as design_effect, {s6('n / (1 + (sz - 1) * icc)')} as effective from t""")
def a12(spark, sf):
    return six(op.effective_sample_size(tb.snapshots(spark, sf)))


@query("a13_cluster_means", f"""with {RES}, m as (
 select event_cluster, market_id, avg(outcome - mid) v from res group by all)
select event_cluster, {s6('avg(v)')} as v from m group by 1""")
def a13(spark, sf):
    snap = op.resolved(tb.snapshots(spark, sf))
    return six(op.cluster_means(snap, F.col("outcome").cast("double") - F.col("mid")))


@query("a14_binned_cluster_error", f"""with {RES}, m as (
 select least(floor(mid * 10e0), 9) b, event_cluster, market_id, avg(outcome - mid) v from res group by all),
c as (select b, event_cluster, avg(v) v from m group by all),
e as (select b, count(*) ncl, avg(v) eff from c group by 1)
select cast(sum(ncl) as bigint) as clusters, {s6('sum(ncl * abs(eff)) / sum(ncl)')} as ece from e""")
def a14(spark, sf):
    return six(op.binned_cluster_error(op.resolved(tb.snapshots(spark, sf))))


UNIF = "cast(('0x' || substr(md5({t}), 1, 8)) as bigint) / 4294967296e0"


@query("a29_null_strategies", f"""with {RES}, t as (
 select outcome, unnest(['0A_uniform','0B_market_midpoint','0C_class_prior','0D_random',
   '0E_inverse_midpoint','model']) as strategy,
  unnest([5e-1, mid, (select avg(outcome) from res),
   {UNIF.format(t="'42|' || market_id || '|' || ts_us || '|' || rid")}, 1e0 - mid, model_p]) as p
 from res),
b as (select strategy, least(floor(p * 10e0), 9) bin, count(*) n, sum(p - outcome) s,
  sum(pow(p - outcome, 2)) b, sum({ll('p')}) l from t group by all),
r as (select strategy, cast(sum(n) as bigint) as n, sum(b) / sum(n) as br, sum(l) / sum(n) as ll,
  sum(abs(s)) / sum(n) as e from b group by 1)
select strategy, n, {s6('br')} as brier, {s6('ll')} as log_loss, {s6('e')} as ece,
 br < (select br from r where strategy = 'model') as beats_model from r""")
def a29(spark, sf):
    return six(op.null_strategies(tb.snapshots(spark, sf)))


MFE = FC + """, ends as (
 select market_id, count(*) n, max(outcome) as outcome, arg_max(p, (predicted_us, rid)) as last_p,
  min(p) lo, max(p) hi from fc where outcome is not null group by 1 having count(*) >= 2),
mfe as (select market_id, n, case when outcome = 1 then hi - last_p else last_p - lo end as mfe,
  abs(last_p - outcome) as err from ends)"""


@query("a65_max_favourable_excursion", f"""with {MFE}
select market_id, n, {s6('mfe')} as mfe, {s6('err')} as final_error, {s6('mfe / nullif(err, 0)')} as mfe_ratio
from mfe""")
def a65(spark, sf):
    return six(op.max_favourable_excursion(tb.forecasts(spark, sf)))


@query("a65_mfe_summary", f"""with {MFE}, r as (
 select round(mfe / nullif(err, 0), 6) q, row_number() over (order by round(mfe / nullif(err, 0), 6)) rn,
  count(*) over () c from mfe where err <> 0)
select count(*) as markets, {s6('avg(mfe)')} as mean_mfe, {s6('max(mfe)')} as max_mfe,
 {s6('avg(mfe / nullif(err, 0))')} as mean_ratio, count(*) filter (where mfe > 0.1) as high_mfe,
 (select {s6('q')} from r where rn = c // 2 + 1) as median_ratio from mfe""")
def a65s(spark, sf):
    return six(op.mfe_summary(tb.forecasts(spark, sf)))


@query("p04_resolved_evaluation_filter", f"""with {SNAP}
select category, count(*) as n, {s6('avg(outcome - mid)')} as residual from snap
where outcome is not null and ts_us + cast(hours * 36e8 as bigint) >= {SPLIT_US} and ts_us < resolved_us
group by 1""")
def p04(spark, sf):
    return six(
        op.resolved_before(tb.snapshots(spark, sf), SPLIT_US).groupBy("category").agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.col("outcome") - F.col("mid")).alias("residual")
        )
    )


@query("p05_bucket_assignment", f"""with {SNAP}
select least(cast(floor(mid * 10e0) as int), 9) as price_bin,
 case when hours < 1 then '<1h' when hours < 24 then '1h-24h' when hours < 168 then '1d-7d' else '>=168h' end as ttr,
 case when spread <= 0.02 then 'tight' else 'wide' end as regime,
 coalesce(nullif(lower(trim(category)), ''), 'unknown') as cat,
 case when hours < 24 then '<1d' when hours < 72 then '1-3d' when hours < 168 then '3-7d' else '>7d' end as ttr_days,
 case when liquidity < 1000 then 'thin' when liquidity < 10000 then 'medium' else 'deep' end as liq,
 count(*) as n from snap group by all""")
def p05(spark, sf):
    c = F.col
    return tb.snapshots(spark, sf).groupBy(
        sc.unit_bin(c("mid")).alias("price_bin"), sc.ttr_bucket(c("hours")).alias("ttr"),
        sc.spread_regime(c("spread")).alias("regime"),
        sc.normalized_category(c("category")).alias("cat"),
        sc.ttr_days_bucket(c("hours")).alias("ttr_days"),
        sc.liquidity_class(c("liquidity")).alias("liq"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("p06_training_terciles", f"""with {SNAP}, m as (
 select market_id, round(avg(liquidity), 6) v from snap
 where ts_us + cast(hours * 36e8 as bigint) < {SPLIT_US} group by 1),
r as (select v, row_number() over (order by v) rn, count(*) over () n from m)
select max(n) as markets, {s6('max(v) filter (where rn = n // 3 + 1)')} as q1,
 {s6('max(v) filter (where rn = 2 * n // 3 + 1)')} as q2 from r""")
def p06(spark, sf):
    return six(op.terciles(tb.snapshots(spark, sf), SPLIT_US))


SHARE = FILLS + """, tot as (select {g} as grp, round(sum(pnl_per_share * shares), 6) pnl, count(*) trades
 from fills group by 1), sh as (select *, abs(pnl) / sum(abs(pnl)) over () * 100 as share,
 row_number() over (order by abs(pnl) desc, grp desc) as rk from tot), cm as (
 select *, sum(share) over (order by rk) as cum from sh)"""


@query("w19_rank_and_cumulative_share", f"""with {SHARE.format(g='token_id')}
select grp as token_id, {s6('pnl')} as pnl, trades, {s6('abs(pnl)')} as weight, {s6('share')} as share,
 rk as rank, {s6('cum')} as cumulative_pct from cm""")
def w19(spark, sf):
    fills = tb.fills(spark, sf).withColumn("v", F.col("pnl_per_share") * F.col("shares"))
    return six(op.ranked_share(fills, "token_id", "v"))


@query("a24_pnl_concentration", f"""with {SHARE.format(g='strategy')}
select count(*) as total_groups, {s6('sum(pnl)')} as total_pnl, {s6('max(cum) filter (where rk = 1)')} as top_1,
 {s6('max(cum) filter (where rk <= 5)')} as top_5, {s6('max(cum) filter (where rk <= 10)')} as top_10,
 {s6('sum(pow(share / 100, 2))')} as hhi, max(cum) filter (where rk = 1) > 50 as is_concentrated from cm""")
def a24(spark, sf):
    fills = tb.fills(spark, sf).withColumn("v", F.col("pnl_per_share") * F.col("shares"))
    ranked = op.ranked_share(fills, "strategy", "v")
    cum, rank = F.col("cumulative_pct"), F.col("rank")
    top = [F.max(F.when(rank <= k, cum)).alias(f"top_{k}") for k in (1, 5, 10)]
    share = F.col("share") / F.lit(100.0)
    return six(
        ranked.agg(
            F.count(F.lit(1)).alias("total_groups"), F.sum("pnl").alias("total_pnl"), *top,
            F.sum(share * share).alias("hhi"),
        ).withColumn("is_concentrated", F.col("top_1") > 50.0)
    )
