"""Bootstrap, family tests, controls, folds, drift and calibration queries."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import book as bk
from tidemark.functions import pricing as pr
from tidemark.functions import scoring as sc
from tidemark.operators import calibrate as cal
from tidemark.operators import inference as inf
from tidemark.operators import resampling as rs
from tidemark.operators import scores as op
from tidemark.operators.ordered import nearest_rank, running
from tidemark.plans.bindings import FC, SNAP
from tidemark.plans.execution import OBS, SPLITTED, split
from tidemark.plans.market import BOOK, EV10, edges
from tidemark.plans.pit import AS_OF, DAY, canonical
from tidemark.plans.registry import query, r6, s6
from tidemark.plans.scores import RES, SPLIT_US, UNIF, ll, six
from tidemark.sources import tables as tb

# Bootstrap replicates, permutations of a control and repeats of a permuted feature.
B, PERMUTATIONS, REPEATS = 2000, 100, 5
draws = rs.weights_sql


CLS = RES + """, cl as (select event_cluster, sum(pow(model_p - outcome, 2)) as s, count(*) as n,
 sum(abs(model_p - outcome)) as a from res group by 1)"""


def boot_sql(metric, point):
    lo, hi = int(0.025 * B), int(0.975 * B) - 1
    return f"""with {CLS}, d as {draws(B, 'event_cluster')},
st as (select b, {metric} as stat from d group by 1), o as (select list_sort(list(stat)) as s from st),
e as (select count(*) as k, {point} as est from cl)
select k as clusters, {s6('est')} as estimate, {s6(f's[{lo + 1}]')} as ci_lower, {s6(f's[{hi + 1}]')} as ci_upper,
 {s6('(select sqrt(avg(pow(stat - (select est from e), 2))) from st)')} as std_error from e, o"""


def cluster_sums(spark, sf):
    c = F.col
    return op.resolved(tb.snapshots(spark, sf)).groupBy("event_cluster").agg(
        F.sum(sc.squared_error(c("model_p"), c("outcome"))).alias("s"), F.count(F.lit(1)).alias("n"),
        F.sum(F.abs(c("model_p") - c("outcome"))).alias("a"),
    )


@query("a15_cluster_bootstrap", boot_sql("sum(w * s) / sum(w * n)", "sum(s) / sum(n)"))
def a15(spark, sf):
    return six(rs.bootstrap(cluster_sums(spark, sf), "event_cluster", ["s", "n"], F.try_divide, B).drop("stats"))


@query("a22_edge_capture_interval", f"""with {SNAP}, {EV10}, {OBS}, cl as (select event_cluster, sum(pnl) as s, sum(pe) as n from ob where pnl is not null group by 1),
d as {draws(B, 'event_cluster')}, st as (select b, sum(w * s) / sum(w * n) as stat from d group by 1), o as (select list_sort(list(stat)) s from st)
select (select count(*) from cl) as clusters, {s6('(select sum(s) / sum(n) from cl)')} as capture_ratio, {s6(f's[{int(0.025 * B) + 1}]')} as ci_lower,
 {s6(f's[{int(0.975 * B)}]')} as ci_upper from o""")
def a22i(spark, sf):
    """Realized over predicted edge with a cluster-bootstrap interval."""
    c = F.col
    clusters = edges(tb.snapshots(spark, sf)).where("outcome is not null").groupBy("event_cluster").agg(
        F.sum(c("outcome") - c("ask")).alias("s"), F.sum("net").alias("n"))
    out = rs.bootstrap(clusters, "event_cluster", ["s", "n"], F.try_divide, B)
    return six(out.drop("std_error", "stats").withColumnRenamed("estimate", "capture_ratio"))


@query("x02_user_metric_bootstrap", boot_sql("sqrt(sum(w * s) / sum(w * n)) - sum(w * a) / sum(w * n)",
                                             "sqrt(sum(s) / sum(n)) - sum(a) / sum(n)"))
def x02(spark, sf):
    def metric(s, a, n):
        return F.sqrt(F.try_divide(s, n)) - F.try_divide(a, n)

    return six(rs.bootstrap(cluster_sums(spark, sf), "event_cluster", ["s", "a", "n"], metric, B).drop("stats"))


@query("a16_paired_comparison", f"""with {RES}, cl as (select event_cluster, sum(pow(mid - outcome, 2) - pow(model_p - outcome, 2)) as s, count(*) as n from res group by 1),
d as {draws(B, 'event_cluster')}, st as (select b, sum(w * s) / sum(w * n) as stat from d group by 1), o as (select list_sort(list(stat)) s from st)
select (select count(*) from cl) as clusters, {s6('(select sum(s) / sum(n) from cl)')} as estimate, {s6(f's[{int(0.025 * B) + 1}]')} as ci_lower,
 {s6(f's[{int(0.975 * B)}]')} as ci_upper, (select count(*) from cl) >= 20 as enough_clusters from o""")
def a16(spark, sf):
    c = F.col
    delta = sc.squared_error(c("mid"), c("outcome")) - sc.squared_error(c("model_p"), c("outcome"))
    clusters = op.resolved(tb.snapshots(spark, sf)).groupBy("event_cluster").agg(
        F.sum(delta).alias("s"), F.count(F.lit(1)).alias("n")
    )
    out = rs.bootstrap(clusters, "event_cluster", ["s", "n"], F.try_divide, B)
    return six(out.withColumn("enough_clusters", c("clusters") >= 20).drop("std_error", "stats"))


FAM = f"""ev0 as (select *, least(cast(floor(mid * 10e0) as int), 9) as pb, lower(trim(category)) as cat, outcome - mid as resid from snap
 where outcome is not null and ts_us + cast(hours * 36e8 as bigint) >= {SPLIT_US} and ts_us < resolved_us),
cells as (select 'F1' as family, event_cluster, market_id, unnest(['price' || pb, 'category[' || cat || ']', case when spread <= 0.02 then 'spread[tight]' else 'spread[wide]' end,
  'TTR[' || case when hours < 1 then '<1h' when hours < 24 then '1h-24h' when hours < 168 then '1d-7d' else '>=168h' end || ']']) as cell, resid as v from ev0
 union all select 'F2', event_cluster, market_id, 'price' || pb || 'x' || cat, resid from ev0
 union all select 'F2', event_cluster, market_id, 'pooled', resid from ev0 where mid < 0.1
 union all select 'F1_TTR', event_cluster, market_id, 'TTR[' || case when hours < 1 then '<1h' when hours < 24 then '1h-24h' when hours < 168 then '1d-7d' else '>=168h' end || ']', abs(resid) from ev0),
mm as (select family, cell, event_cluster, market_id, avg(v) v from cells group by all),
cm as (select family, cell, event_cluster, avg(v) v from mm group by all),
ob as (select family, cell, avg(v) as effect, count(*) as n_clusters from cm group by 1, 2 having count(*) >= 20),
cl as (select cm.*, effect, n_clusters from cm join ob using (family, cell)),
d as {draws(B, 'event_cluster')},
bt as (select family, cell, b, sum(w * (v - effect)) / sum(w) as boot, max(effect) as effect, max(n_clusters) as n_clusters from d group by 1, 2, 3),
ts as (select family, cell, max(effect) as effect, max(n_clusters) as n_clusters, (count(*) filter (where abs(boot) >= abs(effect)) + 1) / {B + 1}e0 as p_value from bt group by 1, 2),
rk as (select *, count(*) over (partition by family) m, row_number() over (partition by family order by p_value, cell) i,
 row_number() over (partition by family order by p_value desc, cell desc) j from ts),
adj as (select *, least(1, p_value * m) as bonferroni,
 least(1, max(p_value * (m - i + 1)) over (partition by family order by i rows between unbounded preceding and current row)) as holm,
 least(1, min(p_value * m / i) over (partition by family order by i desc rows between unbounded preceding and current row)) as bh,
 least(1, max(p_value * m / j) over (partition by family order by j rows between unbounded preceding and current row)) as bh_reference from rk)"""


def family_tests(spark, sf):
    """Every test cell of the families F1, F2 and F1-TTR with its bootstrap p-value."""
    c = F.col
    rows = op.resolved_before(tb.snapshots(spark, sf), SPLIT_US)
    resid = c("outcome") - c("mid")
    # rows collapse to sums per market and class before they are copied into cells
    sums = rows.groupBy(
        "event_cluster", "market_id", sc.unit_bin(c("mid")).alias("pb"),
        sc.normalized_category(c("category")).alias("cat"), sc.ttr_bucket(c("hours")).alias("ttr"),
        sc.spread_regime(c("spread")).alias("regime"), (c("mid") < 0.1).alias("low"),
    ).agg(F.sum(resid).alias("r"), F.sum(F.abs(resid)).alias("a"), F.count(F.lit(1)).alias("n"))

    def named(kind, value):
        return F.concat(F.lit(f"{kind}["), value, F.lit("]"))

    def cell(family, name, value):
        return F.struct(F.lit(family).alias("family"), name.alias("cell"), value.alias("s"))

    pb = F.concat(F.lit("price"), c("pb"))
    tall = sums.select("event_cluster", "market_id", "n", F.explode(F.array_compact(F.array(
        cell("F1", pb, c("r")), cell("F1", named("category", c("cat")), c("r")),
        cell("F1", named("spread", c("regime")), c("r")), cell("F1", named("TTR", c("ttr")), c("r")),
        cell("F2", F.concat(pb, F.lit("x"), c("cat")), c("r")),
        F.when(c("low"), cell("F2", F.lit("pooled"), c("r"))),
        cell("F1_TTR", named("TTR", c("ttr")), c("a")),
    ))).alias("x")).select("event_cluster", "market_id", "n", "x.*")
    keys = ["family", "cell"]
    means = tall.groupBy(*keys, "event_cluster", "market_id").agg(
        (F.sum("s") / F.sum("n")).alias("v")
    ).groupBy(*keys, "event_cluster").agg(F.avg("v").alias("v"))
    enough = means.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).where("k >= 20").drop("k")
    tests = rs.centred_p(means.join(enough, keys), "event_cluster", "v", keys, B)
    return inf.adjust(tests, ["family"], "p_value", "cell")


@query("a19_family_tests", f"""with {SNAP}, {FAM}
select family, cell, {s6('effect')} as effect, n_clusters, {s6('p_value')} as p_value, {s6('bh')} as p_adjusted, bh < 0.1 and abs(effect) >= 0.01 as passed from adj""")
def a19(spark, sf):
    return six(family_tests(spark, sf).select(
        "family", "cell", "effect", "n_clusters", "p_value", F.col("bh").alias("p_adjusted"),
        ((F.col("bh") < 0.1) & (F.abs("effect") >= 0.01)).alias("passed"),
    ))


@query("a17_multiple_testing", f"""with {SNAP}, {FAM}
select family, cell, {s6('bonferroni')} as bonferroni, {s6('holm')} as holm, {s6('bh')} as bh, {s6('bh_reference')} as bh_reference from adj""")
def a17(spark, sf):
    return six(family_tests(spark, sf).select("family", "cell", "bonferroni", "holm", "bh", "bh_reference"))


@query("a19_family_decisions", f"""with {SNAP}, {FAM}, fl as (select *, bh < 0.1 and abs(effect) >= 0.01 as passed from adj), t as (
 select max(effect) filter (where cell = 'TTR[<1h]') a, max(effect) filter (where cell = 'TTR[1h-24h]') b, max(effect) filter (where cell = 'TTR[1d-7d]') c,
  max(effect) filter (where cell = 'TTR[>=168h]') d from fl where family = 'F1_TTR')
select family, count(*) as tests, count(*) filter (where passed) as significant, case
 when family = 'F1' and count(*) filter (where passed) > 0 then 'SUPPORTED'
 when family = 'F2' and count(*) filter (where passed and cell = 'pooled' and effect < 0) > 0 then 'SUPPORTED'
 when family = 'F1_TTR' and count(*) < 2 then 'INSUFFICIENT_DATA'
 when family = 'F1_TTR' and (select coalesce(d, c, b) - coalesce(a, b, c) >= 0.01 and coalesce(a <= coalesce(b, c, d), true) and coalesce(b <= coalesce(c, d), true) and coalesce(c <= d, true) from t) then 'SUPPORTED'
 else 'NOT_SUPPORTED' end as verdict from fl group by 1""")
def a19d(spark, sf):
    c = F.col
    passed = (c("bh") < 0.1) & (F.abs("effect") >= 0.01)
    t = family_tests(spark, sf).withColumn("passed", passed)

    def eff(cell):
        return F.max(F.when(c("cell") == cell, c("effect")))

    g = t.groupBy("family").agg(
        F.count(F.lit(1)).alias("tests"), F.count_if("passed").alias("significant"),
        F.count_if(c("passed") & (c("cell") == "pooled") & (c("effect") < 0)).alias("pooled"),
        eff("TTR[<1h]").alias("e1"), eff("TTR[1h-24h]").alias("e2"), eff("TTR[1d-7d]").alias("e3"),
        eff("TTR[>=168h]").alias("e4"),
    )
    present = F.array_compact(F.array("e1", "e2", "e3", "e4"))
    rising = F.forall(
        F.sequence(F.lit(0), F.size(present) - 1),
        lambda i: (i == 0) | (F.get(present, i) >= F.get(present, i - 1)),
    )
    far = F.get(present, F.size(present) - 1) - F.get(present, F.lit(0))
    verdict = (
        F.when((c("family") == "F1") & (c("significant") > 0), "SUPPORTED")
        .when((c("family") == "F2") & (c("pooled") > 0), "SUPPORTED")
        .when((c("family") == "F1_TTR") & (c("tests") < 2), "INSUFFICIENT_DATA")
        .when((c("family") == "F1_TTR") & (far >= 0.01) & rising, "SUPPORTED")
        .otherwise("NOT_SUPPORTED")
    )
    return g.select("family", "tests", "significant", verdict.alias("verdict"))


@query("a18_effect_size", f"""with {RES}, d as (select category, pow(mid - outcome, 2) - pow(model_p - outcome, 2) as x from res)
select category, {s6('avg(x) / nullif(stddev_samp(x), 0)')} as cohens_d, case when abs(avg(x) / nullif(stddev_samp(x), 0)) < 0.2 then 'negligible'
 when abs(avg(x) / nullif(stddev_samp(x), 0)) < 0.5 then 'small' when abs(avg(x) / nullif(stddev_samp(x), 0)) < 0.8 then 'medium' else 'large' end as label from d group by 1""")
def a18(spark, sf):
    c = F.col
    x = sc.squared_error(c("mid"), c("outcome")) - sc.squared_error(c("model_p"), c("outcome"))
    g = op.resolved(tb.snapshots(spark, sf)).withColumn("x", x).groupBy("category").agg(
        (F.avg("x") / F.nullif(F.stddev_samp("x"), F.lit(0.0))).alias("cohens_d")
    )
    size = F.abs("cohens_d")
    label = F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large")
    return six(g.withColumn("label", label))


def squared(p: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (p - y) ** 2


IDENT = ["market_id", "ts_us", "rid"]
CONTROLS = [("permuted_labels", []), ("category_permutation", ["category"]), ("cluster_shuffle", ["event_cluster"])]
CONTROL_SQL = ", ".join(rs.permuted_sql(name, "res", group[0] if group else "1", IDENT, ["model_p"], ["outcome"], PERMUTATIONS, 5) for name, group in CONTROLS)


@query("a30_negative_controls", f"""with recursive {RES}, {CONTROL_SQL}, sh as (
 select pow(lag(model_p, 1, model_p) over (partition by market_id order by ts_us, rid) - outcome, 2) as se from res),
x as ({" union all ".join(f"select '{name}' as control, avg(pow(model_p - m_outcome, 2)) as b from {name}" for name, _ in CONTROLS)}
 union all select 'temporal_shift', avg(se) from sh)
select control, {s6('b')} as control_brier, {s6('(select avg(pow(model_p - outcome, 2)) from res)')} as real_brier,
 (select avg(pow(model_p - outcome, 2)) from res) < b - 0.01 as passed from x""")
def a30(spark, sf):
    """Brier score with labels permuted 100 times over all rows, in categories and in clusters, and with late forecasts."""
    c = F.col
    # Labels travel once per replicate and control: a bit each.
    rows = op.resolved(tb.snapshots(spark, sf)).select("market_id", "category", "event_cluster", "ts_us", "rid", "model_p", c("outcome").cast("byte").alias("outcome"))
    real = rows.agg(F.avg(sc.squared_error(c("model_p"), c("outcome")))).scalar()
    p = rs.permuted_losses_by(rows, [group for _, group in CONTROLS], IDENT, ["model_p"], ["outcome"], squared, PERMUTATIONS, 5)
    out = p.groupBy("grouping").agg((F.sum("loss") / F.sum("n")).alias("b")).select(
        F.get(F.array(*[F.lit(name) for name, _ in CONTROLS]), c("grouping")).alias("control"), "b")
    late = running(rows, ["market_id"], "ts_us", ["rid"], {"prev": ("lag", c("model_p"))})
    shifted = late.agg(
        F.avg(sc.squared_error(F.coalesce("prev", "model_p"), c("outcome"))).alias("b")
    ).select(F.lit("temporal_shift").alias("control"), "b")
    out = out.unionByName(shifted).withColumn("real", real)
    return out.select(
        "control", r6("b").alias("control_brier"), r6("real").alias("real_brier"),
        (c("real") < c("b") - 0.01).alias("passed"),
    )


@query("a31_degradation_tests", f"""with {RES}, c as (select category, avg(model_p) m from res group by 1),
cm as (select category, lead(m, 1, (select arg_min(m, category) from c)) over (order by category) as m from c),
x as (select r.*, coalesce(lag(model_p, 5) over w, first_value(model_p) over w) as delayed, first_value(model_p) over w as oldest, cm.m as scr from res r join cm using (category)
 window w as (partition by market_id order by ts_us, rid)),
y as (select outcome, unnest(['baseline', 'delay_predictions', 'remove_external_features', 'scramble_categories', 'stale_snapshots']) as test,
 unnest([model_p, delayed, mid, scr, oldest]) as p from x)
select test, count(*) as n, {s6('avg(pow(p - outcome, 2))')} as brier from y group by 1""")
def a31(spark, sf):
    return six(degradation(op.resolved(tb.snapshots(spark, sf))).where("test <> 'gaussian_noise'"))


def degradation(rows, noise_sd=0.1, seed=42):
    """Brier score after each way of spoiling the forecasts."""
    from tidemark.functions.hashing import normal, uniform
    from tidemark.operators.ordered import rolling

    c = F.col
    base = rows.select("market_id", "category", "ts_us", "rid", "model_p", "mid", "outcome")
    # One row per category; a shuffle by category would put all rows into as few tasks as there are categories.
    cats = base.groupBy("category").agg(F.avg("model_p").alias("m")).select(
        "category",
        F.lead("m").over(Window.partitionBy(F.lit(1)).orderBy("category")).alias("nxt"),
        F.min_by("m", "category").over(Window.partitionBy(F.lit(1))).alias("wrap"),
    ).select("category", F.coalesce("nxt", "wrap").alias("scr"))
    lagged = rolling(
        base, ["market_id"], "ts_us", ["rid"], 5,
        lambda d, w: d.withColumn("l5", F.lag("model_p", 5).over(w)),
    )
    full = running(lagged, ["market_id"], "ts_us", ["rid"], {"oldest": ("first", c("model_p"))}).join(F.broadcast(cats), "category")
    ident = [c("market_id"), c("ts_us"), c("rid")]
    noisy = pr.clamp(
        c("model_p") + F.lit(noise_sd) * normal(uniform(seed, *ident), uniform(seed + 1, *ident)), 0.01, 0.99
    )
    entries = {
        "baseline": c("model_p"), "gaussian_noise": noisy, "delay_predictions": F.coalesce("l5", "oldest"),
        "remove_external_features": c("mid"), "scramble_categories": c("scr"), "stale_snapshots": c("oldest"),
    }
    tall = full.select("outcome", F.explode(F.array(*[
        F.struct(F.lit(k).alias("test"), v.alias("p")) for k, v in entries.items()
    ])).alias("x")).select("outcome", "x.*")
    return tall.groupBy("test").agg(
        F.count(F.lit(1)).alias("n"), F.avg(sc.squared_error(c("p"), c("outcome"))).alias("brier")
    )


@query("a31_gaussian_noise", f"""with {RES}, u as (select *, {UNIF.format(t="'42|' || market_id || '|' || ts_us || '|' || rid")} as u1, {UNIF.format(t="'43|' || market_id || '|' || ts_us || '|' || rid")} as u2 from res),
z as (select *, greatest(1e-2, least(99e-2, model_p + 1e-1 * sqrt(-2e0 * ln(1e0 - u1)) * cos(6.283185307179586e0 * u2))) as noisy from u)
select 'baseline' as test, count(*) as n, {s6('avg(pow(model_p - outcome, 2))')} as brier from res
union all select 'gaussian_noise', count(*), {s6('avg(pow(noisy - outcome, 2))')} from z""")
def a31n(spark, sf):
    return six(degradation(op.resolved(tb.snapshots(spark, sf))).where("test in ('gaussian_noise', 'baseline')"))


COMPONENTS = ["market_prior", "microstructure", "fundamental", "logistic", "gradient_boosting", "relative_value"]
COMBOS = (
    [(c,) for c in COMPONENTS]
    + [("market_prior", "fundamental"), ("market_prior", "microstructure"), ("fundamental", "relative_value"), tuple(COMPONENTS)]
    + [tuple(x for x in COMPONENTS if x != drop) for drop in ("microstructure", "fundamental", "relative_value", "market_prior")]
)
COMP_SQL = {
    "market_prior": "mid", "microstructure": "(ask * bid_size + bid * ask_size) / (bid_size + ask_size)", "fundamental": "5e-1 + (model_p - 5e-1) / 2e0",
    "logistic": "model_p", "gradient_boosting": "sqrt(model_p)", "relative_value": "1e0 - mid",
}
ABL = ", ".join(
    f"('{'+'.join(x)}', ({' + '.join('(' + COMP_SQL[c] + ')' for c in x)}) / {len(x)}e0)" for x in COMBOS
)


@query("a32_component_ablation", f"""with {RES}, x as (select outcome, t.combo, t.p from res, lateral (values {ABL}) t(combo, p)),
y as (select *, p - 5e-1 as edge, case when (outcome = 1 and p > 5e-1) or (outcome = 0 and p <= 5e-1) then (1e0 - case when p > 5e-1 then p else 1e0 - p end) * 98e-2 - 1e0 else -1e0 end as ret from x)
select combo, count(*) as n, {s6('avg(pow(p - outcome, 2))')} as brier, {s6(f'avg({ll("p")})')} as log_loss,
 {s6('coalesce(sum(ret) filter (where abs(edge) >= 2e-2), 0)')} as net_pnl, {s6('count(*) filter (where abs(edge) >= 2e-2) / count(*)')} as turnover,
 {s6('avg(abs(edge)) filter (where abs(edge) >= 2e-2)')} as average_edge from y group by 1""")
def a32(spark, sf):
    c = F.col
    rows = op.resolved(tb.snapshots(spark, sf))
    value = {
        "market_prior": c("mid"),
        "microstructure": sc.microprice(c("bid"), c("ask"), c("bid_size"), c("ask_size")),
        "fundamental": F.lit(0.5) + (c("model_p") - F.lit(0.5)) / F.lit(2.0), "logistic": c("model_p"),
        "gradient_boosting": F.sqrt("model_p"), "relative_value": F.lit(1.0) - c("mid"),
    }

    def mean(combo):
        total = value[combo[0]]
        for name in combo[1:]:
            total = total + value[name]
        return total / F.lit(float(len(combo)))

    tall = rows.select("outcome", F.explode(F.array(*[
        F.struct(F.lit("+".join(x)).alias("combo"), mean(x).alias("p")) for x in COMBOS
    ])).alias("x")).select("outcome", "x.*")
    p, y = c("p"), c("outcome")
    edge = p - F.lit(0.5)
    bet = F.abs(edge) >= 0.02
    stake = F.when(edge > 0, p).otherwise(F.lit(1.0) - p)
    won = ((y == 1) & (edge > 0)) | ((y == 0) & (edge <= 0))
    ret = F.when(won, (F.lit(1.0) - stake) * F.lit(0.98) - F.lit(1.0)).otherwise(-1.0)
    return six(tall.groupBy("combo").agg(
        F.count(F.lit(1)).alias("n"), F.avg(sc.squared_error(p, y)).alias("brier"),
        F.avg(sc.log_loss_term(p, y)).alias("log_loss"),
        F.coalesce(F.sum(F.when(bet, ret)), F.lit(0.0)).alias("net_pnl"),
        (F.count_if(bet) / F.count(F.lit(1))).alias("turnover"),
        F.avg(F.when(bet, F.abs(edge))).alias("average_edge"),
    ))


@query("a38_leave_one_category_out", f"""with {RES}, g as (select category, count(*) n, sum(pow(model_p - outcome, 2)) s from res group by 1)
select category, n as held_out, {s6('s / n')} as test_brier, {s6('((select sum(s) from g) - s) / ((select sum(n) from g) - n)')} as train_brier,
 {s6('s / n - ((select sum(s) from g) - s) / ((select sum(n) from g) - n)')} as gap from g""")
def a38(spark, sf):
    c = F.col
    g = op.resolved(tb.snapshots(spark, sf)).groupBy("category").agg(
        F.count(F.lit(1)).alias("held_out"), F.sum(sc.squared_error(c("model_p"), c("outcome"))).alias("s")
    )
    whole = Window.partitionBy(F.lit(1))  # one row per category
    train = (F.sum("s").over(whole) - c("s")) / (F.sum("held_out").over(whole) - c("held_out"))
    return six(g.withColumn("train_brier", train).select(
        "category", "held_out", (c("s") / c("held_out")).alias("test_brier"), "train_brier",
        (c("s") / c("held_out") - c("train_brier")).alias("gap"),
    ))


# The inverse covariance by Gauss-Jordan steps on the matrix beside the identity.
INVERSE_SQL = """v as (select vec_id, [cast(x as double) for x in embedding] as v, len(embedding) as d from embeddings),
dim as (select d from v where d is not null group by d order by count(*) desc, d limit 1),
pairs as (select i, j, covar_samp(v[i], v[j]) as c from v, dim, range(1, 1000) a(i), range(1, 1000) b(j) where i <= dim.d and j <= dim.d group by i, j),
lines as (select i, list(c order by j) as l from pairs group by i),
gj(k, m) as (
 select 1, (select list(list_concat(l, [case when x = i then 1e0 else 0e0 end for x in range(1, dim.d + 1)]) order by i) from lines, dim)
 union all
 select k + 1, [case when i = k then [y / m[k][k] for y in m[k]] else [m[i][j] - m[i][k] * m[k][j] / m[k][k] for j in range(1, 2 * dim.d + 1)] end for i in range(1, dim.d + 1)]
 from gj, dim where k <= dim.d),
inv as (select [x[dim.d + 1:] for x in m] as q from gj, dim where k = dim.d + 1),
mu as (select list(m order by i) as m from (select i, avg(v[i]) as m from v, dim, range(1, 1000) a(i) where i <= dim.d group by i)),
s as (select vec_id, sqrt(list_sum([(v[i] - mu.m[i]) * list_sum([q[i][j] * (v[j] - mu.m[j]) for j in range(1, dim.d + 1)]) for i in range(1, dim.d + 1)])) as score
 from v, mu, inv, dim where v.d = dim.d)"""


@query("a39_mahalanobis_flags", f"""with recursive {INVERSE_SQL},
r as (select *, row_number() over (order by round(score, 9)) rn, count(*) over () n from s)
select vec_id, round(score, 6) + 0e0 as score, round(score, 9) > (select round(score, 9) from r where rn = least(n, floor(95e-2 * n) + 1)) as flagged from r
union all select vec_id, null, null from v, dim where v.d is null or v.d <> dim.d""")
def a39(spark, sf):
    return six(mahalanobis(tb.load(spark, sf, "embeddings")))


def mahalanobis(df, quantile=0.95):
    """Distance from the mean under the sample covariance of all dimensions; the top tail is flagged.

    The most common length counts (of equally common ones the shortest); vectors of another
    length, and nulls, have no score and stay in the result with nulls.
    Every partition sums its part of the moments, and only those sums (dimensions x
    dimensions) visit the driver.
    """
    import numpy as np
    import pandas as pd

    length = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    common = df.where(length.isNotNull()).groupBy(length.alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    dims = common["d"] if common else 0
    others = df.where(length.isNull() | (length != dims)).select("vec_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("boolean").alias("flagged"))
    rows = df.where(length == dims).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))

    def moments(batches):
        total = np.zeros((dims + 1, dims + 1))
        for pdf in batches:
            x = np.hstack([np.ones((len(pdf), 1)), np.array(pdf["x"].tolist(), float).reshape(len(pdf), dims)])
            total += x.T @ x
        yield pd.DataFrame({"i": range(dims + 1), "line": total.tolist()})

    lines = rows.select("x").mapInPandas(moments, "i int, line array<double>").groupBy("i").agg(
        F.array(*[F.sum(F.get("line", F.lit(j))) for j in range(dims + 1)]).alias("line")).collect()
    total = np.array([r["line"] for r in sorted(lines, key=lambda r: r["i"])])
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    inverse = np.linalg.inv((total[1:, 1:] - n * np.outer(mean, mean)) / (n - 1))

    def distance(x: pd.Series) -> pd.Series:
        gap = np.array(x.tolist(), float).reshape(len(x), dims) - mean
        return pd.Series(np.sqrt(((gap @ inverse) * gap).sum(axis=1)))

    scored = rows.select("vec_id", F.pandas_udf(distance, "double")("x").alias("score"), F.lit(1).alias("g"))
    cut = nearest_rank(
        scored.select("g", F.round("score", 9).alias("v")), ["g"], "v",
        {"cut": lambda n: F.least(n, F.floor(F.lit(quantile) * n) + 1)},
    ).select("cut").scalar()
    return scored.withColumn("cut", cut).select(
        "vec_id", "score", (F.round("score", 9) > F.col("cut")).alias("flagged")
    ).unionByName(others)


KS = f"""a as (select model_p * (case when is_val then 97e-2 else 1e0 end) as v, is_val from sp),
cn as (select v, count(*) filter (where not is_val) c1, count(*) filter (where is_val) c2 from a group by 1),
cu as (select v, sum(c1) over (order by v) / (select sum(c1) from cn) s1, sum(c2) over (order by v) / (select sum(c2) from cn) s2 from cn)"""
BINS = """bn as (select greatest(0, least(9, cast(floor((v - lo) / ((hi - lo) / 10e0)) as int))) as b, is_val from a, lohi),
sh as (select b, count(*) filter (where not is_val) / sum(count(*) filter (where not is_val)) over () as p, count(*) filter (where is_val) / sum(count(*) filter (where is_val)) over () as q from bn group by 1)"""


def two_versions(spark, sf):
    scale = F.when(F.col("is_val"), 0.97).otherwise(1.0)
    return split(spark, sf).select((F.col("model_p") * scale).alias("v"), "is_val")


@query("a40_version_shift", f"""with {SNAP}, {SPLITTED}, {KS}, lohi as (select min(v) lo, max(v) hi from a), {BINS}
select {s6('(select max(abs(s1 - s2)) from cu)')} as ks, {s6('sum(case when p > 0 then 5e-1 * p * ln(p / ((p + q) / 2)) else 0 end + case when q > 0 then 5e-1 * q * ln(q / ((p + q) / 2)) else 0 end)')} as js,
 {s6('(select avg(v) filter (where is_val) - avg(v) filter (where not is_val) from a)')} as mean_shift from sh""")
def a40(spark, sf):
    c = F.col
    df = two_versions(spark, sf)
    lo, hi = df.agg(F.min("v")).scalar(), df.agg(F.max("v")).scalar()
    js = inf.js_divergence(inf.binned_shares(df, "v", c("is_val"), 10, lo, hi))
    ks = inf.ks_statistic(df, "v", c("is_val"))
    shift = df.agg((F.avg(F.when(c("is_val"), c("v"))) - F.avg(F.when(~c("is_val"), c("v")))).alias("d"))
    return six(js.withColumns({"ks": ks.scalar(), "mean_shift": shift.scalar()}))


@query("a41_population_stability", f"""with {SNAP}, {SPLITTED}, {KS}, lohi as (select min(v) lo, max(v) hi from a where not is_val), {BINS}
select {s6('sum(case when p > 0 and q > 0 then (q - p) * ln(q / p) else 0 end)')} as psi from sh""")
def a41(spark, sf):
    df = two_versions(spark, sf)
    ref = df.where(~F.col("is_val"))
    lo, hi = ref.agg(F.min("v")).scalar(), ref.agg(F.max("v")).scalar()
    return six(inf.stability_index(inf.binned_shares(df, "v", F.col("is_val"), 10, lo, hi)))


FEATURES = ["mid", "model_p", "spread"]


@query("a67_permutation_importance", f"""with recursive {RES}, {rs.permuted_sql('pf', 'res', '1', IDENT, ['outcome', *FEATURES], FEATURES, REPEATS, 9)},
s as (select unnest({FEATURES}) as feature, unnest([6e-1 * model_p + 4e-1 * m_mid - spread, 6e-1 * m_model_p + 4e-1 * mid - spread, 6e-1 * model_p + 4e-1 * mid - m_spread]) as f, outcome from pf),
g as (select feature, avg(pow(f - outcome, 2)) br from s group by 1), b as (select avg(pow(6e-1 * model_p + 4e-1 * mid - spread - outcome, 2)) as base from res)
select feature, {s6('base')} as baseline, {s6('br')} as permuted, {s6('br - base')} as importance, case when br > base then 'positive' else 'negative' end as direction,
 br - base < -5e-2 as leak from g, b""")
def a67(spark, sf):
    """Loss of a fixed linear scorer when one feature is permuted over the rows, five times."""
    c = F.col
    rows = op.resolved(tb.snapshots(spark, sf)).select(*IDENT, *FEATURES, "outcome")

    def score(mid, model_p, spread):
        return 0.6 * model_p + 0.4 * mid - spread

    def losses(mid, model_p, spread, outcome, other_mid, other_p, other_spread):
        scores = [score(other_mid, model_p, spread), score(mid, other_p, spread), score(mid, model_p, other_spread)]
        return np.stack([(s - outcome) ** 2 for s in scores])

    permuted = rs.permuted_losses(rows, [], IDENT, [*FEATURES, "outcome"], FEATURES, losses, REPEATS, 9)
    base = rows.agg(F.avg(sc.squared_error(score(c("mid"), c("model_p"), c("spread")), c("outcome")))).scalar()
    g = permuted.groupBy("kind").agg((F.sum("loss") / F.sum("n")).alias("permuted")).withColumn("baseline", base)
    g = g.withColumns({"feature": F.get(F.array(*[F.lit(x) for x in FEATURES]), c("kind")), "importance": c("permuted") - c("baseline")})
    return six(g.select("feature", "baseline", "permuted", "importance", F.when(c("importance") > 0, "positive").otherwise("negative").alias("direction"),
                        (c("importance") < -0.05).alias("leak")))


CAN = FC + """, canon as (select market_id, arg_min(p, (predicted_us, rid)) as p, min(predicted_us) as predicted_us, min(label_known_us) as label_known_us,
 max(outcome) as outcome, any_value(cluster) as cluster from fc group by 1)"""
FIRST, END, WIN = 788_918_400_000_000, 1_009_843_200_000_000, 120 * DAY


@query("w10_walk_forward_folds", f"""with {CAN}, va as (select *, cast((predicted_us - {FIRST}) // {WIN} as int) as fold from canon where predicted_us >= {FIRST} and predicted_us < {END}),
ca as (select fold, count(*) candidates, count(distinct cluster) clusters, count(*) filter (where label_known_us <= {END}) scored from va group by 1),
tr as (select f as fold, c.* from canon c, range({-(-(END - FIRST) // WIN)}) r(f) where label_known_us is not null and predicted_us < {FIRST} + f * {WIN} - {7 * DAY} and label_known_us < {FIRST} + f * {WIN}
 and not exists (select 1 from va where va.fold = f and va.cluster = c.cluster)),
tg as (select fold, count(*) training, sum(outcome) pos from tr group by 1)
select fold, candidates, clusters, scored, coalesce(training, 0) as training, case when coalesce(training, 0) < 4 or not coalesce(pos > 0 and pos < training, false) then 'insufficient_data'
 when scored = 0 then 'awaiting_labels' else 'evaluated' end as status from ca left join tg using (fold)""")
def w10(spark, sf):
    canon = canonical(tb.forecasts(spark, sf))
    return inf.walk_forward(canon, FIRST, END, WIN, embargo=7 * DAY)


CUT = 852_076_800_000_000  # 1997-01-01
ISO = f"""tr as (select * from fc where outcome is not null and predicted_us < {CUT}), g as (select p, sum(outcome) y, count(*) n from tr group by 1),
c as (select p, row_number() over (order by p) i, sum(y) over (order by p) sy, sum(n) over (order by p) sn, y, n from g),
av as (select j.i as j, k.i as k, (k.sy - j.sy + j.y) / (k.sn - j.sn + j.n) as a from c j join c k on j.i <= k.i),
mn as (select c.i, av.j, min(av.a) as m from c join av on av.j <= c.i and av.k >= c.i group by 1, 2),
iso as (select c.p, c.i, max(mn.m) as q from mn join c using (i) group by 1, 2)"""


def isotonic_parts(spark, sf):
    fc = tb.forecasts(spark, sf).where("outcome is not null")
    return fc.where(F.col("predicted_us") < CUT), fc.where(F.col("predicted_us") >= CUT)


@query("m01_isotonic_calibration", f"""with {FC}, {ISO} select {s6('p')} as p, {s6('q')} as q from iso""")
def m01(spark, sf):
    train, _ = isotonic_parts(spark, sf)
    steps = cal.isotonic_steps(train)
    return six(cal.isotonic_predict(train.select("p").distinct(), steps))


@query("m04_calibrated_forecasts", f"""with {FC}, {ISO}, te as (select f.*, coalesce(i.q, (select arg_min(q, p) from iso)) as q from (select * from fc where outcome is not null and predicted_us >= {CUT}) f
 asof left join iso i on f.p >= i.p), b as (select least(floor(q * 10e0), 9) bin, sum(q - outcome) s from te group by 1)
select count(*) as n, {s6('avg(pow(p - outcome, 2))')} as raw_brier, {s6('avg(pow(q - outcome, 2))')} as brier, {s6(f'avg({ll("q", "1e-12")})')} as log_loss,
 {s6('(select sum(abs(s)) from b) / count(*)')} as ece from te""")
def m04(spark, sf):
    c = F.col
    train, test = isotonic_parts(spark, sf)
    scored = cal.isotonic_predict(test, cal.isotonic_steps(train)).select("p", "q", "outcome")
    cells = scored.withColumn("bin", sc.unit_bin(c("q"))).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum(sc.squared_error(c("p"), c("outcome"))).alias("rb"),
        F.sum(sc.squared_error(c("q"), c("outcome"))).alias("b"),
        F.sum(sc.log_loss_term(c("q"), c("outcome"), 1e-12)).alias("l"), F.sum(c("q") - c("outcome")).alias("s"),
    )
    n = F.sum("n")
    return six(cells.agg(
        n.alias("n"), (F.sum("rb") / n).alias("raw_brier"), (F.sum("b") / n).alias("brier"),
        (F.sum("l") / n).alias("log_loss"), (F.sum(F.abs("s")) / n).alias("ece"),
    ))


@query("m02_platt_calibration")
def m02(spark, sf):
    c = F.col
    train, test = isotonic_parts(spark, sf)
    a, b = cal.platt_fit(train)
    q = cal.platt_predict(c("p"), a, b)
    return six(test.agg(
        F.count(F.lit(1)).alias("n"), F.avg(sc.squared_error(c("p"), c("outcome"))).alias("raw_brier"),
        F.avg(sc.squared_error(q, c("outcome"))).alias("brier"),
    ).withColumns({"intercept": F.lit(a), "slope": F.lit(b)}))


@query("m03_temperature_scaling", f"""with {FC}, g as (select p, outcome, count(*) n from fc where outcome is not null group by 1, 2),
x as (select t, n, outcome, greatest(1e-12, least(1e0 - 1e-12, 1e0 / (1e0 + exp(-(ln(greatest(1e-6, least(1e0 - 1e-6, p)) / (1e0 - greatest(1e-6, least(1e0 - 1e-6, p)))) / (t / 100e0)))))) as q from g, range(10, 500) r(t)),
s as (select t, round(sum(n * case when outcome = 1 then -ln(q) else -ln(1e0 - q) end) / sum(n), 12) as nll from x group by 1)
select {s6('t / 100e0')} as temperature, {s6('nll')} as nll from s order by nll, t limit 1""")
def m03(spark, sf):
    return six(cal.temperature(tb.forecasts(spark, sf).where("outcome is not null")))


@query("m05_feature_models")
def m05(spark, sf):
    """Logistic regression and boosted trees on book features, scored on both sides of the cut."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    c = F.col
    cols = ["mid", "spread", "bid_size", "liquidity"]
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(
        op.resolved(tb.snapshots(spark, sf)).select(*cols, "ts_us", c("outcome").cast("double").alias("label"))
    ).select("features", "label", (c("ts_us") < SPLIT_US).alias("is_train"))
    train = data.where("is_train")
    models = {
        "logistic": LogisticRegression(maxIter=30, regParam=0.001),
        "gradient_boosting": GBTClassifier(maxIter=5, maxDepth=3, seed=7),
    }
    out = None
    for name, est in models.items():
        scored = est.fit(train).transform(data).select(
            "is_train", "label", vector_to_array("probability")[1].alias("p")
        )
        part = scored.groupBy("is_train").agg(
            F.count(F.lit(1)).alias("n"), F.avg(sc.squared_error(c("p"), c("label"))).alias("brier"),
            F.avg(sc.log_loss_term(c("p"), c("label"))).alias("log_loss"),
        ).withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return six(out)


@query("m06_training_table", f"""with {BOOK}, {FC}, lb as (select market_id, max(outcome) as outcome, min(label_known_us) as known from fc group by 1)
select event_id, {s6('(bb + ba) / 2')} as mid, {s6('(bd - ad) / (bd + ad)')} as imbalance, outcome from bb join lb on lb.market_id = bb.market_slug
where ts_us <= {AS_OF} and outcome is not null and known <= {AS_OF} and nb > 0 and na > 0""")
def m06(spark, sf):
    """Features of the books visible at the cut with the labels known by then."""
    c = F.col
    f = bk.features(c("bids"), c("asks"))
    books = tb.books(spark, sf, until=AS_OF).where(c("ts_us") <= AS_OF).select(
        "event_id", c("market_slug").alias("market_id"), f["midpoint"].alias("mid"), f["imbalance"].alias("imbalance")
    ).where("mid is not null")
    labels = tb.forecasts(spark, sf).groupBy("market_id").agg(
        F.max("outcome").alias("outcome"), F.min("label_known_us").alias("known")
    ).where(c("outcome").isNotNull() & (c("known") <= AS_OF))
    return six(books.join(labels, "market_id").select("event_id", "mid", "imbalance", "outcome"))


@query("m07_ensemble_weights", f"""with {RES}, g as (select i / 20e0 as w from range(21) r(i)), s as (
 select w, round(avg(pow(w * model_p + (1 - w) * mid - outcome, 2)), 12) as brier from res, g group by 1)
select {s6('brier')} as brier, {s6('w')} as w_model_p, {s6('1 - w')} as w_mid from s order by brier, w limit 1""")
def m07(spark, sf):
    return six(cal.ensemble_weights(op.resolved(tb.snapshots(spark, sf)), ["model_p", "mid"], 20))


@query("m07_ensemble_weights_three", f"""with {RES}, x as (select *, (ask * bid_size + bid * ask_size) / (bid_size + ask_size) as micro from res),
g as (select i / 10e0 as a, j / 10e0 as b, (10 - i - j) / 10e0 as c from range(11) r(i), range(11) s(j) where i + j <= 10), s as (
 select a, b, c, round(avg(pow(a * model_p + b * mid + c * micro - outcome, 2)), 12) as brier from x, g group by 1, 2, 3)
select {s6('brier')} as brier, {s6('a')} as w_model_p, {s6('b')} as w_mid, {s6('c')} as w_micro from s order by brier, a, b limit 1""")
def m07b(spark, sf):
    c = F.col
    rows = op.resolved(tb.snapshots(spark, sf)).withColumn(
        "micro", sc.microprice(c("bid"), c("ask"), c("bid_size"), c("ask_size"))
    )
    return six(cal.ensemble_weights(rows, ["model_p", "mid", "micro"], 10))


@query("m08_overfit_gap", f"""with {RES}, g as (select category, avg(pow(model_p - outcome, 2)) filter (where ts_us < {SPLIT_US}) tr, avg(pow(model_p - outcome, 2)) filter (where ts_us >= {SPLIT_US}) te,
 count(*) filter (where ts_us < {SPLIT_US}) n from res group by 1)
select category, {s6('tr')} as train_brier, {s6('te')} as test_brier, {s6('te - tr')} as gap, te - tr > 0.02 as overfit, {s6('12e0 / n')} as parameter_ratio from g""")
def m08(spark, sf):
    c = F.col
    se = sc.squared_error(c("model_p"), c("outcome"))
    early = c("ts_us") < SPLIT_US
    g = op.resolved(tb.snapshots(spark, sf)).groupBy("category").agg(
        F.avg(F.when(early, se)).alias("train_brier"), F.avg(F.when(~early, se)).alias("test_brier"),
        F.count_if(early).alias("n"),
    )
    gap = c("test_brier") - c("train_brier")
    return six(g.select(
        "category", "train_brier", "test_brier", gap.alias("gap"), (gap > 0.02).alias("overfit"),
        (F.lit(12.0) / c("n")).alias("parameter_ratio"),
    ))


def logistic_model(mid: pd.Series, spread: pd.Series) -> pd.Series:
    """A user's own probability model: Arrow batches in, probabilities out."""
    return 1.0 / (1.0 + np.exp(-(2.0 * (mid - 0.5) + spread)))


@query("x01_user_probability_model", f"""with {SNAP}
select category, count(*) as n, {s6('avg(1e0 / (1e0 + exp(-(2e0 * (mid - 5e-1) + spread))))')} as mean_p from snap group by 1""")
def x01(spark, sf):
    predict = F.pandas_udf(logistic_model, "double")
    rows = tb.snapshots(spark, sf).select("category", predict("mid", "spread").alias("p"))
    return six(rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p")))
