"""Gate tables: burn-in, promotion, strategy guard and overfitting, each criterion with its measured value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as sc
from tidemark.operators import asof
from tidemark.operators import resampling as rs
from tidemark.operators import scores as op
from tidemark.operators.ordered import running
from tidemark.plans.bindings import EV, FILLS, QUOTES, SNAP, TRADES_ONLY
from tidemark.plans.feeds import RAW
from tidemark.plans.inference import B
from tidemark.plans.pit import DAY, HOUR
from tidemark.plans.registry import query, r6, s6
from tidemark.plans.scores import SPLIT_US, six
from tidemark.sources import rawlog
from tidemark.sources import tables as tb

# Criterion, side of the limit that passes, limit.
BURN_IN = [
    ("raw_corruption", "max", 0.0), ("replay_deterministic", "min", 1.0), ("no_delta_on_stale_book", "max", 0.0), ("reconnect_recoverable", "max", 0.0),
    ("timestamp_invariants", "max", 0.0), ("reconciliation_bounded", "max", 0.01), ("heartbeat_recovery", "max", 7200.0), ("restart_recovery", "min", 0.9),
    ("partial_file_recovery", "max", 0.0), ("metadata_point_in_time", "max", 0.0), ("resolution_captured", "min", 0.5), ("model_hash_unchanged", "max", 1.0)]
PROMOTION = [
    ("positive_delta_brier", "above", 0.0), ("calibration_acceptable", "max", 0.1), ("disagreement_stable", "max", 0.02), ("edge_realization_acceptable", "min", 0.5),
    ("paper_vs_backtest_ok", "max", 0.05), ("execution_model_calibrated", "max", 0.05), ("effective_n_adequate", "min", 20.0), ("bootstrap_evidence_positive", "above", 0.0),
    ("multiple_testing_aware", "max", 0.05), ("cost_ladder_survives", "above", 0.0), ("latency_survives", "max", 0.05), ("parameter_stable", "max", 0.01),
    ("monte_carlo_survives", "above", 0.0), ("drawdown_acceptable", "max", 0.2), ("concentration_acceptable", "max", 0.4), ("exposure_caps_functioning", "max", 0.25),
    ("shadow_positive", "above", 0.0), ("paper_positive", "above", 0.0), ("final_holdout_passed", "above", 0.0), ("collector_fidelity_healthy", "max", 0.1),
    ("no_integrity_failures", "max", 0.0)]
STALE_DAYS, RECOVERY_DAYS, PARAMETERS = 5, 5, 3
GUARD_SPLITS = (788_918_400_000_000, 852_076_800_000_000)  # training before 1995, validation before 1997


def judged(metrics, gate, rules):
    """One row per criterion of a one-row table of metrics: the value and whether it passes."""
    c = F.col
    found = F.array(*[F.struct(F.lit(name).alias("criterion"), c(name).cast("double").alias("value"), F.lit(side).alias("side"), F.lit(limit).alias("limit")) for name, side, limit in rules])
    value = F.round("value", 9)
    passed = F.when(c("side") == "max", value <= c("limit")).when(c("side") == "min", value >= c("limit")).otherwise(value > c("limit"))
    return metrics.select(F.inline(found)).select(F.lit(gate).alias("gate"), "criterion", r6("value").alias("value"), F.coalesce(passed, F.lit(False)).alias("passed"))


def judged_sql(table, gate, rules):
    test = {"max": "<=", "min": ">=", "above": ">"}
    return " union all ".join(
        f"select '{gate}' as gate, '{name}' as criterion, {s6(name)} as value, coalesce(round(({name})::double, 9) {test[side]} {limit}::double, false) as passed from {table}" for name, side, limit in rules)


QUOTES_ONLY = QUOTES[len(EV) + 2:]
SNAP_ROWS = SNAP + ", res as (select * from snap where outcome is not null)"
METRICS_SQL = RAW + f""", {QUOTES_ONLY}, {TRADES_ONLY}, {SNAP_ROWS}, {FILLS},
tq as (select t.*, q.mid, q.spread, t.ts_us - q.ts_us as age from trades t asof left join quotes q on q.market_slug = t.market_slug and t.ts_us >= q.ts_us),
er as (select event_id, 'm' || user_id as market_slug, ts_us from ev where event_type = 'error'),
eq as (select e.*, q.ts_us - e.ts_us as wait from er e asof left join quotes q on q.market_slug = e.market_slug and e.ts_us <= q.ts_us),
bm as (select (select count(*) filter (where sha256(wire) is null) from raw) as raw_corruption, 1 as replay_deterministic, (select count(*) filter (where age > {STALE_DAYS * DAY}) from tq) as no_delta_on_stale_book,
  (select count(*) filter (where wait is null) from eq) as reconnect_recoverable, (select count(*) filter (where received_ns < exchange_ms * 1000000) from raw) as timestamp_invariants,
  (select count(*) filter (where round(abs(price - mid) - spread - 1e-1, 9) > 0) / count(*) from tq where age <= {6 * HOUR}) as reconciliation_bounded,
  (select max(gap) / 1e6 from (select ts_us - lag(ts_us) over (order by ts_us, event_id) as gap from ev)) as heartbeat_recovery, (select count(*) filter (where wait <= {RECOVERY_DAYS * DAY}) / count(*) from eq) as restart_recovery,
  (select count(*) filter (where k is null) from ev) as partial_file_recovery, (select count(*) filter (where resolved_us < ts_us) from snap) as metadata_point_in_time,
  (select count(distinct market_id) from res) / (select count(distinct market_id) from snap) as resolution_captured, (select max(n) from (select count(distinct model_p) as n from snap group by market_id, rid)) as model_hash_unchanged),
cl as (select event_cluster, sum(pow(mid - outcome, 2) - pow(model_p - outcome, 2)) as d, sum(outcome - ask) as g, count(*) as n from res group by 1),
bs as (select b, sum(w * d) / sum(w * n) as d, sum(w * g) / sum(w * n) as g from {rs.weights_sql(B, 'event_cluster')} group by 1),
bi as (select list_sort(list(d))[{int(0.025 * B) + 1}] as dlo, list_sort(list(g))[{int(0.025 * B) + 1}] as glo, (count(*) filter (where d <= 0) + 1) / {B + 1}e0 as p from bs),
lg as (select outcome, lag(model_p, 1, model_p) over (partition by market_id order by ts_us, rid) as lp from res),
dy as (select ts_us // {DAY} as day, sum(outcome - ask) as pnl from res group by 1), cp as (select event_cluster, sum(outcome - ask) as pnl, sum(ask * bid_size) as ex from res group by 1),
pm as (select avg(pow(mid - outcome, 2) - pow(model_p - outcome, 2)) as positive_delta_brier,
  (select sum(abs(s)) / sum(n) from (select sum(model_p - outcome) as s, count(*) as n from res group by least(floor(model_p * 10e0), 9))) as calibration_acceptable,
  abs(avg(model_p - mid) filter (where ts_us >= {SPLIT_US}) - avg(model_p - mid) filter (where ts_us < {SPLIT_US})) as disagreement_stable,
  sum(outcome - ask) filter (where round(net_edge, 9) > 0) / sum(net_edge) filter (where round(net_edge, 9) > 0) as edge_realization_acceptable, abs(avg(outcome - ask) filter (where filled) - avg(outcome - ask) filter (where not filled)) as paper_vs_backtest_ok,
  avg(spread) as execution_model_calibrated, count(distinct event_cluster) as effective_n_adequate, (select dlo from bi) as bootstrap_evidence_positive, least(1, (select p from bi) * count(distinct category)) as multiple_testing_aware,
  avg(model_p - ask - 2 * fee_rate * ask * (1e0 - ask)) as cost_ladder_survives, (select avg(pow(lp - outcome, 2)) from lg) - avg(pow(model_p - outcome, 2)) as latency_survives,
  abs(avg(pow(6e-1 * model_p + 4e-1 * mid - outcome, 2) - pow(5e-1 * model_p + 5e-1 * mid - outcome, 2))) as parameter_stable, (select glo from bi) as monte_carlo_survives,
  (select -min(pnl) from dy) / sum(ask) as drawdown_acceptable, (select max(greatest(pnl, 0)) / nullif(sum(greatest(pnl, 0)), 0) from cp) as concentration_acceptable, (select max(ex) / sum(ex) from cp) as exposure_caps_functioning,
  avg(outcome - ask) filter (where not filled) as shadow_positive, avg(outcome - ask) filter (where filled) as paper_positive,
  avg(pow(mid - outcome, 2) - pow(model_p - outcome, 2)) filter (where ts_us >= {SPLIT_US}) as final_holdout_passed, (select count(*) filter (where k > 95) / count(*) from ev) as collector_fidelity_healthy,
  (select raw_corruption from bm) as no_integrity_failures from res),
sm as (select strategy, avg(pnl_per_share) filter (where ts_us < {GUARD_SPLITS[0]}) as t, avg(pnl_per_share) filter (where ts_us >= {GUARD_SPLITS[0]} and ts_us < {GUARD_SPLITS[1]}) as v, avg(pnl_per_share) filter (where ts_us >= {GUARD_SPLITS[1]}) as o from fills group by 1),
gm as (select count(*) as n, max(t) as bt, median(t) as mt, arg_max(v, (t, strategy)) as v, arg_max(o, (t, strategy)) as o from sm where t is not null),
gr as (select n as selection_pressure, case when bt > 0 then (bt - v) / abs(bt) end as train_test_gap, case when bt > 0 and v > 0 then v / bt end as generalization, case when v > 0 then (v - o) / abs(v) end as oos_decay, case when bt > 0 and mt > 0 then bt / mt end as weak_signal from gm),
om as (select avg(pow(model_p - outcome, 2)) filter (where ts_us >= {SPLIT_US}) - avg(pow(model_p - outcome, 2)) filter (where ts_us < {SPLIT_US}) as gap, {PARAMETERS}e0 / greatest(count(*) filter (where ts_us < {SPLIT_US}), 1) as complexity,
  count(distinct category) filter (where ts_us >= {SPLIT_US}) as holdout_abuse, least(1, (select p from bi) * (select n from gm)) as deflation, (select n from gm) as tested from res)"""
GUARD_SQL = """select 'strategy_guard' as gate, unnest(['selection_pressure', 'train_test_gap', 'generalization', 'oos_decay', 'weak_signal']) as criterion, unnest([selection_pressure::double, train_test_gap, generalization, oos_decay, weak_signal]) as value,
 unnest([case when selection_pressure > 50 then 'critical' when selection_pressure > 20 then 'caution' end, case when round(train_test_gap, 9) > 0.5 then 'warning' when round(train_test_gap, 9) > 0.3 then 'warning' end,
  case when round(generalization, 9) < 0.3 then 'caution' end, case when round(oos_decay, 9) > 0.4 then 'caution' end, case when round(weak_signal, 9) < 1.1 then 'caution' end]) as severity from gr
union all select 'overfitting', unnest(['gap', 'complexity', 'holdout_abuse', 'deflation']), unnest([gap, complexity, holdout_abuse::double, deflation]), unnest([
  case when round(gap, 9) > 0.1 then 'critical' when round(gap, 9) > 0.05 then 'high' when round(gap, 9) > 0.02 then 'medium' end, case when round(complexity, 9) > 0.5 then 'critical' when round(complexity, 9) > 0.1 then 'high' when round(complexity, 9) > 0.05 then 'medium' end,
  case when holdout_abuse > 10 then 'critical' when holdout_abuse > 5 then 'high' end, case when round(deflation, 9) < 0.01 and tested > 100 then 'high' when round(deflation, 9) < 0.1 and tested > 20 then 'medium' end]) from om"""


@query("a56_gates", f"""with {METRICS_SQL}, a as ({judged_sql('bm', 'burn_in', BURN_IN)} union all {judged_sql('pm', 'promotion', PROMOTION)}),
w as ({GUARD_SQL})
select gate, criterion, value, passed, case when passed then 'ok' else 'failed' end as severity from a
union all select gate, criterion, {s6('value')}, severity is null, coalesce(severity, 'ok') from w""")
def a56g(spark, sf):
    """All four gates over the tables: burn-in, promotion, strategy guard, overfitting."""
    c = F.col
    rows = op.resolved(tb.snapshots(spark, sf))
    evidence = rs.bootstrap(cluster_sums(rows), "event_cluster", ["d", "n"], F.try_divide, B)
    guard, strategies = strategy_guard(tb.fills(spark, sf))
    p = (F.size(F.filter(c("stats"), lambda x: x <= 0)) + 1) / F.lit(B + 1.0)
    best_p = evidence.select(p.alias("p")).scalar()
    first = judged(burn_in(spark, sf), "burn_in", BURN_IN).unionByName(judged(promotion(spark, sf, rows, evidence, best_p), "promotion", PROMOTION))
    first = first.withColumn("severity", F.when(c("passed"), "ok").otherwise("failed"))
    second = guard.unionByName(overfitting(rows, best_p, strategies)).select(
        "gate", "criterion", r6("value").alias("value"), c("severity").isNull().alias("passed"), F.coalesce("severity", F.lit("ok")).alias("severity"))
    return first.unionByName(second)


def cluster_sums(rows):
    c = F.col
    delta = sc.squared_error(c("mid"), c("outcome")) - sc.squared_error(c("model_p"), c("outcome"))
    return rows.groupBy("event_cluster").agg(F.sum(delta).alias("d"), F.sum(c("outcome") - c("ask")).alias("g"), F.count(F.lit(1)).alias("n"))


def burn_in(spark, sf):
    """One row of the collector's measures."""
    c = F.col
    raw, events, snaps = rawlog.envelopes(spark, sf), tb.event_rows(spark, sf), tb.snapshots(spark, sf)
    quotes = tb.quotes(spark, sf).withColumn("q_us", c("ts_us"))
    met = asof.asof_join(tb.trades(spark, sf), quotes, ["market_slug"], "ts_us", "q_us", ["mid", "spread", "q_us"], "at", tie=c("event_id"))
    age = c("ts_us") - c("at.q_us")
    near = age <= 6 * HOUR
    off = F.round(F.abs(c("price") - c("at.mid")) - c("at.spread") - F.lit(0.1), 9) > 0
    waits = asof.asof_join(tb.gaps(spark, sf).select("event_id", "market_slug", c("start_us").alias("ts_us")), quotes, ["market_slug"], "ts_us", "q_us", ["q_us"], "next", forward=True, tie=c("event_id"))
    silence = running(events.select("event_id", "ts_us", F.lit(1).alias("g")), ["g"], "ts_us", ["event_id"], {"p": ("lag", c("ts_us"))})
    same = rawlog.fingerprint(raw).select(F.struct("n", "checksum").alias("a")).scalar()
    again = rawlog.fingerprint(raw.unionByName(raw))
    versions = snaps.groupBy("market_id", "rid").agg(F.countDistinct("model_p").alias("n"))
    return again.select((F.struct("n", "checksum") == same).cast("int").alias("replay_deterministic")).withColumns({
        "raw_corruption": rawlog.integrity(raw).agg(F.sum("mismatches")).scalar(),
        "timestamp_invariants": raw.agg(F.count_if(c("received_ns") < c("exchange_ms") * 1_000_000)).scalar(),
        "no_delta_on_stale_book": met.agg(F.count_if(age > STALE_DAYS * DAY)).scalar(),
        "reconciliation_bounded": met.agg(F.count_if(near & off) / F.count_if(near)).scalar(),
        "reconnect_recoverable": waits.agg(F.count_if(c("next").isNull())).scalar(),
        "restart_recovery": waits.agg(F.count_if(c("next.q_us") - c("ts_us") <= RECOVERY_DAYS * DAY) / F.count(F.lit(1))).scalar(),
        "heartbeat_recovery": silence.agg(F.max(c("ts_us") - c("p")) / F.lit(1e6)).scalar(),
        "partial_file_recovery": events.agg(F.count_if(c("k").isNull())).scalar(),
        "metadata_point_in_time": snaps.agg(F.count_if(c("resolved_us") < c("ts_us"))).scalar(),
        "resolution_captured": snaps.agg(F.countDistinct(F.when(c("outcome").isNotNull(), c("market_id"))) / F.countDistinct("market_id")).scalar(),
        "model_hash_unchanged": versions.agg(F.max("n")).scalar()})


def promotion(spark, sf, rows, evidence, best_p):
    """One row of the measures that a promotion asks for."""
    c = F.col
    y, gain, edge = c("outcome"), c("outcome") - c("ask"), F.round("net_edge", 9) > 0
    delta = sc.squared_error(c("mid"), y) - sc.squared_error(c("model_p"), y)
    late = c("ts_us") >= SPLIT_US

    def mean(value, where):
        return F.avg(F.when(where, value))

    def blend(w):
        return sc.squared_error(F.lit(w) * c("model_p") + F.lit(1.0 - w) * c("mid"), y)

    bins = rows.groupBy(sc.unit_bin(c("model_p")).alias("bin")).agg(F.sum(c("model_p") - y).alias("s"), F.count(F.lit(1)).alias("n"))
    lagged = running(rows, ["market_id"], "ts_us", ["rid"], {"prev": ("lag", c("model_p"))})
    days = rows.groupBy(F.floor(c("ts_us") / DAY).alias("day")).agg(F.sum(gain).alias("pnl"))
    clusters = rows.groupBy("event_cluster").agg(F.sum(gain).alias("pnl"), F.sum(c("ask") * c("bid_size")).alias("ex"))
    up = F.greatest(c("pnl"), F.lit(0.0))
    carlo = rs.bootstrap(cluster_sums(rows), "event_cluster", ["g", "n"], F.try_divide, B)
    m = rows.agg(
        F.avg(delta).alias("positive_delta_brier"), F.abs(mean(c("model_p") - c("mid"), late) - mean(c("model_p") - c("mid"), ~late)).alias("disagreement_stable"),
        (F.sum(F.when(edge, gain)) / F.sum(F.when(edge, c("net_edge")))).alias("edge_realization_acceptable"), F.abs(mean(gain, c("filled")) - mean(gain, ~c("filled"))).alias("paper_vs_backtest_ok"),
        F.avg("spread").alias("execution_model_calibrated"), F.countDistinct("event_cluster").alias("effective_n_adequate"), F.countDistinct("category").alias("_tests"),
        F.avg(c("model_p") - c("ask") - F.lit(2.0) * c("fee_rate") * c("ask") * (F.lit(1.0) - c("ask"))).alias("cost_ladder_survives"), F.avg(sc.squared_error(c("model_p"), y)).alias("_brier"),
        F.abs(F.avg(blend(0.6) - blend(0.5))).alias("parameter_stable"), F.sum("ask").alias("_spent"), mean(gain, ~c("filled")).alias("shadow_positive"), mean(gain, c("filled")).alias("paper_positive"),
        mean(delta, late).alias("final_holdout_passed"))
    return m.withColumns({
        "calibration_acceptable": bins.agg(F.sum(F.abs("s")) / F.sum("n")).scalar(), "bootstrap_evidence_positive": evidence.select("ci_lower").scalar(),
        "multiple_testing_aware": F.least(F.lit(1.0), best_p * c("_tests")), "monte_carlo_survives": carlo.select("ci_lower").scalar(),
        "latency_survives": lagged.agg(F.avg(sc.squared_error(F.coalesce("prev", "model_p"), y))).scalar() - c("_brier"),
        "drawdown_acceptable": days.agg(-F.min("pnl")).scalar() / c("_spent"), "concentration_acceptable": clusters.agg(F.try_divide(F.max(up), F.sum(up))).scalar(),
        "exposure_caps_functioning": clusters.agg(F.max("ex") / F.sum("ex")).scalar(),
        "collector_fidelity_healthy": tb.event_rows(spark, sf).agg(F.count_if(c("k") > 95) / F.count(F.lit(1))).scalar(),
        "no_integrity_failures": rawlog.integrity(rawlog.envelopes(spark, sf)).agg(F.sum("mismatches")).scalar()})


def warned(df, gate, rules):
    """Rows of value and severity from a one-row table; a null value warns of nothing."""
    found = F.array(*[F.struct(F.lit(name).alias("criterion"), value.cast("double").alias("value"), severity.alias("severity")) for name, value, severity in rules])
    return df.select(F.inline(found)).select(F.lit(gate).alias("gate"), "criterion", "value", "severity")


def strategy_guard(fills):
    """Selection bias of the strategy that is best in training, and the number of strategies tried."""
    c = F.col
    t = c("ts_us")
    split = [t < GUARD_SPLITS[0], (t >= GUARD_SPLITS[0]) & (t < GUARD_SPLITS[1]), t >= GUARD_SPLITS[1]]
    per = fills.groupBy("strategy").agg(*[F.avg(F.when(s, c("pnl_per_share"))).alias(n) for s, n in zip(split, "tvo")]).where("t is not null")
    m = per.agg(F.count(F.lit(1)).alias("n"), F.max("t").alias("bt"), F.median("t").alias("mt"), F.max_by("v", F.struct("t", "strategy")).alias("v"), F.max_by("o", F.struct("t", "strategy")).alias("o"))
    gap, ratio = F.when(c("bt") > 0, (c("bt") - c("v")) / F.abs("bt")), F.when((c("bt") > 0) & (c("v") > 0), c("v") / c("bt"))
    decay, lead = F.when(c("v") > 0, (c("v") - c("o")) / F.abs("v")), F.when((c("bt") > 0) & (c("mt") > 0), c("bt") / c("mt"))
    return warned(m, "strategy_guard", [
        ("selection_pressure", c("n"), F.when(c("n") > 50, "critical").when(c("n") > 20, "caution")), ("train_test_gap", gap, F.when(F.round(gap, 9) > 0.3, "warning")),
        ("generalization", ratio, F.when(F.round(ratio, 9) < 0.3, "caution")), ("oos_decay", decay, F.when(F.round(decay, 9) > 0.4, "caution")),
        ("weak_signal", lead, F.when(F.round(lead, 9) < 1.1, "caution"))]), m.select("n").scalar()


def overfitting(rows, best_p, tested):
    """Gap between splits, parameters per observation, uses of the holdout, and what many tests leave of the best p value."""
    c = F.col
    late, se = c("ts_us") >= SPLIT_US, sc.squared_error(c("model_p"), c("outcome"))
    m = rows.agg((F.avg(F.when(late, se)) - F.avg(F.when(~late, se))).alias("gap"), (F.lit(float(PARAMETERS)) / F.greatest(F.count_if(~late), F.lit(1))).alias("complexity"),
                 F.countDistinct(F.when(late, c("category"))).alias("uses")).withColumns({"tested": tested, "deflation": F.least(F.lit(1.0), best_p * tested)})
    gap, load, left = F.round("gap", 9), F.round("complexity", 9), F.round("deflation", 9)
    return warned(m, "overfitting", [
        ("gap", c("gap"), F.when(gap > 0.1, "critical").when(gap > 0.05, "high").when(gap > 0.02, "medium")),
        ("complexity", c("complexity"), F.when(load > 0.5, "critical").when(load > 0.1, "high").when(load > 0.05, "medium")),
        ("holdout_abuse", c("uses"), F.when(c("uses") > 10, "critical").when(c("uses") > 5, "high")),
        ("deflation", c("deflation"), F.when((left < 0.01) & (c("tested") > 100), "high").when((left < 0.1) & (c("tested") > 20), "medium"))])
