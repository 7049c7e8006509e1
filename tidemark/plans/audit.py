"""Audits, gates, ladders, forecast vintages and study queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import book as bk
from tidemark.functions import pricing as pr
from tidemark.functions import scoring as sc
from tidemark.operators import asof
from tidemark.operators import inference as inf
from tidemark.operators import pairs
from tidemark.operators import resampling as rs
from tidemark.operators import scores as op
from tidemark.operators.ordered import chain, nearest_rank, profile, rolling_range, running
from tidemark.plans.bindings import EV, FILLS, GAPS, LEVELS, LOAD, QT, QUOTES, SNAP, TRADES
from tidemark.plans.execution import LAT, latest_by_market
from tidemark.plans.flow import CORR, PAIRS, daily_returns, events_of
from tidemark.plans.inference import draws
from tidemark.plans.market import BOOK, book_reasons
from tidemark.plans.pit import AS_OF, AS_OF_DAY, DAY, HOUR, NEAR, VINT, actual_peaks, nearest_quotes, vintages
from tidemark.plans.registry import query, r6, s6
from tidemark.plans.scores import RES, SPLIT_US, six
from tidemark.sources import tables as tb

CHECKS = {
    "impossible_bid_ask": "bid > ask",
    "prices_outside_unit": "bid < 0 or bid > 1 or ask < 0 or ask > 1 or mid < 0 or mid > 1 or model_p < 0 or model_p > 1",
    "negative_sizes": "bid_size < 0 or ask_size < 0",
    "negative_volume_liquidity": "volume < 0 or liquidity < 0",
    "malformed_timestamps": "ts_us is null",
    "resolution_before_observation": "resolved_us < ts_us",
    "missing_resolution": "outcome is null",
    "probability_bounds": "model_p <= 0 or model_p >= 1",
    "outcome_validity": "outcome is not null and outcome not in (0, 1)",
}
AUDIT_SQL = ", ".join(f"coalesce({v}, false) as {k}" for k, v in CHECKS.items())
# Checks whose rows are rejected; the others concern labels, events and clusters.
REJECTING = [
    "duplicate_observations", "duplicate_market_timestamp", "impossible_bid_ask", "prices_outside_unit", "negative_sizes",
    "negative_volume_liquidity", "nan_inf", "malformed_timestamps", "timestamp_reversals", "future_feature_timestamps",
    "resolution_before_observation", "yes_no_inconsistency", "probability_bounds",
]
# The NO book and the feature clock of a snapshot, derived from its own columns; input order is order and line number.
AUDIT_ROWS = f"""{SNAP}, au as (select *, cast(string_split(rid, '|')[1] as bigint) as o1, cast(string_split(rid, '|')[2] as bigint) as o2,
  ts_us + cast((26 - bid_size) * {HOUR} as bigint) as feature_us, 1e0 - bid + fee_rate as no_ask, 1e0 - ask - spread / 2e0 as no_bid from snap),
fl as (select *, {AUDIT_SQL}, isnan(bid) or isnan(ask) or isnan(mid) or isnan(model_p) or isnan(net_edge) as nan_inf,
  row_number() over (partition by market_id, ts_us order by o1, o2, rid) > 1 as duplicate_market_timestamp,
  row_number() over (partition by market_id, ts_us, model_p order by o1, o2, rid) > 1 as duplicate_observations,
  coalesce(ts_us < lag(ts_us) over (partition by market_id order by o1, o2, rid), false) as timestamp_reversals,
  feature_us > ts_us as future_feature_timestamps,
  cast(round(bid - (1e0 - no_ask), 9) > 0.02 as int) + cast(round(1e0 - no_bid - ask, 9) > 0.02 as int) as sides,
  cast(round(bid - (1e0 - no_ask), 9) > 0.02 as int) + cast(round(1e0 - no_bid - ask, 9) > 0.02 as int) > 0 as yes_no_inconsistency from au)"""
NAMES = [*CHECKS, "nan_inf", "duplicate_market_timestamp", "duplicate_observations", "timestamp_reversals", "future_feature_timestamps"]


def audit_rows(snap):
    """Row flags of every row-level check. Repeats are flagged after the first row in input order."""
    c = F.col
    flags = {k: F.coalesce(F.expr(v), F.lit(False)) for k, v in CHECKS.items()}
    nan = [F.isnan(x) for x in ("bid", "ask", "mid", "model_p", "net_edge")]
    part = F.split("rid", r"\|")
    rows = snap.withColumns(flags).withColumns({
        "nan_inf": nan[0] | nan[1] | nan[2] | nan[3] | nan[4],
        "o1": part[0].cast("bigint"), "o2": part[1].cast("bigint"),
        "future_feature_timestamps": c("ts_us") + ((F.lit(26) - c("bid_size")) * F.lit(HOUR)).cast("bigint") > c("ts_us"),
    })
    no_ask, no_bid = F.lit(1.0) - c("bid") + c("fee_rate"), F.lit(1.0) - c("ask") - c("spread") / F.lit(2.0)
    sides = (F.round(c("bid") - (F.lit(1.0) - no_ask), 9) > 0.02).cast("int") + (F.round(F.lit(1.0) - no_bid - c("ask"), 9) > 0.02).cast("int")
    rows = running(rows, ["market_id"], "o1", ["o2", "rid"], {"_before": ("lag", c("ts_us"))})
    order = [c("o1"), c("o2"), c("rid")]

    def repeats(*keys):
        return F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1

    return rows.withColumns({
        "timestamp_reversals": F.coalesce(c("ts_us") < c("_before"), F.lit(False)), "sides": sides, "yes_no_inconsistency": sides > 0,
        "duplicate_market_timestamp": repeats("market_id", "ts_us"), "duplicate_observations": repeats("market_id", "ts_us", "model_p"),
    })


@query("a55_dataset_audit", f"""with {AUDIT_ROWS},
c as (select {", ".join(f"count(*) filter (where {n}) as {n}" for n in NAMES)}, cast(sum(sides) as bigint) as yes_no_inconsistency from fl),
mk as (select market_id, min(outcome) <> max(outcome) as split from snap group by 1),
cl as (select event_cluster, count(*) as n, min(outcome) <> max(outcome) as split from snap group by 1),
u as (select * from (unpivot c on columns(*) into name name value affected)
 union all select 'conflicting_resolutions', count(*) filter (where split) from mk union all select 'duplicate_event_labels', count(*) filter (where split) from cl)
select name, affected, affected = 0 as passed from u
union all select 'cluster_independence', 0, count(*) filter (where n = 1) < count(*) or count(*) = 0 from cl""")
def a55(spark, sf):
    """The eighteen checks from two aggregations: row flags, and label ranges per market and cluster."""
    c = F.col
    snap = tb.snapshots(spark, sf)
    row = audit_rows(snap).agg(*[F.count_if(n).alias(n) for n in NAMES], F.coalesce(F.sum("sides"), F.lit(0)).alias("yes_no_inconsistency"))
    flags = row.unpivot([], [*NAMES, "yes_no_inconsistency"], "name", "affected").withColumn("passed", c("affected") == 0)
    markets = snap.groupBy("event_cluster", "market_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("outcome").alias("lo"), F.max("outcome").alias("hi"))
    # A market lies in one cluster, so its label range there is its own.
    clusters = markets.groupBy("event_cluster").agg(
        F.sum("n").alias("n"), (F.min("lo") != F.max("hi")).alias("split"), F.count_if(c("lo") != c("hi")).alias("markets"))
    whole = clusters.agg(
        F.coalesce(F.sum("markets"), F.lit(0)).alias("m"), F.count_if("split").alias("e"), F.count_if(c("n") == 1).alias("ones"),
        F.count(F.lit(1)).alias("k"))

    def check(name, affected, passed):
        return F.struct(F.lit(name).alias("name"), affected.cast("bigint").alias("affected"), passed.alias("passed"))

    rest = whole.select(F.explode(F.array(
        check("conflicting_resolutions", c("m"), c("m") == 0), check("duplicate_event_labels", c("e"), c("e") == 0),
        check("cluster_independence", F.lit(0), (c("ones") < c("k")) | (c("k") == 0)),
    )).alias("r")).select("r.*")
    return flags.unionByName(rest)


@query("a55_rejected_rows", f"""with {AUDIT_ROWS} select market_id, rid, concat_ws(',', {", ".join(f"case when {n} then '{n}' end" for n in REJECTING)}) as reasons from fl
where {" or ".join(REJECTING)}""")
def a55b(spark, sf):
    """Every rejected row with all its reasons; the accepted rows are the others."""
    rows = audit_rows(tb.snapshots(spark, sf))
    reasons = F.concat_ws(",", *[F.when(F.col(n), F.lit(n)) for n in REJECTING])
    return rows.select("market_id", "rid", reasons.alias("reasons")).where("reasons <> ''")


BIAS_SQL = f"""with {FILLS}, x as (select count(*) n, sum(notional) nt, sum(shares * fee_rate * price * (1e0 - price)) fees, sum(slippage * shares) sl,
 count(*) filter (where price <= 0 or price >= 1) bad, count(*) filter (where shares > 50) big from fills),
cl as (select max(e) / sum(e) as c from (select strategy, sum(notional) e from fills group by 1)),
ps as (select max(e) / sum(e) as c from (select token_id, sum(notional) e from fills where side = 'BUY' group by 1)),
sv as (select count(*) n, count(*) filter (where bought and not sold) lost from (select token_id, bool_or(side = 'BUY') bought, bool_or(side <> 'BUY') sold from fills group by 1)),
al as (select count(*) filter (where ts_us < before) as late from (select ts_us, lag(ts_us) over (partition by strategy order by order_id, rid) as before from fills)),
dy as (select ts_us // {DAY} as d, sum(shares * pnl_per_share) p from fills group by 1), eq as (select d, sum(p) over (order by d) e from dy),
of as (select max(top - e) / (select sum(notional) from fills) as dd, (select count(*) from fills) as n from (select e, max(e) over (order by d) as top from eq))
select 'lookahead_bias' as name, 'critical' as severity, bad = 0 as passed, {s6('bad')} as value from x
union all select 'midpoint_fill_bias', 'critical', big = 0, {s6('big')} from x union all select 'fee_omission', 'critical', fees / nt > 0 or fees = 0, {s6('fees / nt')} from x
union all select 'slippage_omission', 'warning', true, {s6('sl / n')} from x union all select 'trade_independence', 'warning', c < 0.5, {s6('c')} from cl
union all select 'concentration', 'warning', c < 0.5, {s6('c')} from ps
union all select 'survivorship_bias', 'info', true, {s6('lost / n')} from sv union all select 'timestamp_alignment', 'critical', late = 0, {s6('late')} from al
union all select 'overfitting_heuristic', 'warning', not ((dd < 1e-2 and n > 10) or (dd < 2e-2 and n > 100)), {s6('dd')} from of"""


def bias_checks(spark, sf):
    c = F.col
    fills = tb.fills(spark, sf)
    x = fills.agg(
        F.count(F.lit(1)).alias("n"), F.sum("notional").alias("nt"),
        F.sum(c("shares") * c("fee_rate") * c("price") * (F.lit(1.0) - c("price"))).alias("fees"),
        F.sum(c("slippage") * c("shares")).alias("sl"),
        F.count_if((c("price") <= 0) | (c("price") >= 1)).alias("bad"), F.count_if(c("shares") > 50).alias("big"),
    )

    def check(name, severity, passed, value):
        return F.struct(F.lit(name).alias("name"), F.lit(severity).alias("severity"), passed.alias("passed"), r6(value).alias("value"))

    rate = c("fees") / c("nt")
    out = x.select(F.explode(F.array(
        check("lookahead_bias", "critical", c("bad") == 0, c("bad")),
        check("midpoint_fill_bias", "critical", c("big") == 0, c("big")),
        check("fee_omission", "critical", (rate > 0) | (c("fees") == 0), rate),
        check("slippage_omission", "warning", F.lit(True), c("sl") / c("n")),
    )).alias("r")).select("r.*")

    def share(rows, key, name):
        g = rows.groupBy(key).agg(F.sum("notional").alias("e")).agg((F.max("e") / F.sum("e")).alias("c"))
        return g.select(F.lit(name).alias("name"), F.lit("warning").alias("severity"), (c("c") < 0.5).alias("passed"), r6("c").alias("value"))

    def row(df, name, severity, passed, value):
        return df.select(check(name, severity, passed, value).alias("r")).select("r.*")

    tokens = fills.groupBy("token_id").agg(F.bool_or(c("side") == "BUY").alias("bought"), F.bool_or(c("side") != "BUY").alias("sold")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("bought") & ~c("sold")).alias("lost"))
    placed = running(fills, ["strategy"], "order_id", ["rid"], {"before": ("lag", c("ts_us"))}).agg(
        F.count_if(c("ts_us") < c("before")).alias("late"))
    by_day = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)  # one row per day
    equity = fills.groupBy(F.floor(c("ts_us") / F.lit(DAY)).alias("d")).agg(
        F.sum(c("shares") * c("pnl_per_share")).alias("p"), F.sum("notional").alias("nt"), F.count(F.lit(1)).alias("n"))
    equity = equity.withColumn("e", F.sum("p").over(by_day)).withColumn("top", F.max("e").over(by_day)).agg(
        (F.max(c("top") - c("e")) / F.sum("nt")).alias("dd"), F.sum("n").alias("n"))
    calm = ((c("dd") < 0.01) & (c("n") > 10)) | ((c("dd") < 0.02) & (c("n") > 100))
    parts = [
        share(fills, "strategy", "trade_independence"), share(fills.where("side = 'BUY'"), "token_id", "concentration"),
        row(tokens, "survivorship_bias", "info", F.lit(True), c("lost") / c("n")),
        row(placed, "timestamp_alignment", "critical", c("late") == 0, c("late")),
        row(equity, "overfitting_heuristic", "warning", ~calm, c("dd")),
    ]
    for part in parts:
        out = out.unionByName(part)
    return out


@query("a54_bias_checks", BIAS_SQL)
def a54(spark, sf):
    return bias_checks(spark, sf)


@query("u06_union_of_check_tables", f"""select count(*) as checks, count(*) filter (where passed) as passed, count(distinct severity) as severities from (
 select name, severity, passed from ({BIAS_SQL}) union all select 'rows_present', 'error', true)""")
def u06(spark, sf):
    present = tb.snapshots(spark, sf).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("rows_present").alias("name"), F.lit("error").alias("severity"), (F.col("n") > 0).alias("passed")
    )
    both = bias_checks(spark, sf).unionByName(present, allowMissingColumns=True)
    return both.agg(
        F.count(F.lit(1)).alias("checks"), F.count_if("passed").alias("passed"), F.countDistinct("severity").alias("severities")
    )


@query("a56_gate_table", f"""with {SNAP}, {EV.replace('ev as', 'ev as')}, m as (select count(*) filter (where resolved_us < ts_us) as a, count(distinct event_cluster) as b, count(outcome) / count(*) as c,
 avg(pow(mid - outcome, 2)) - avg(pow(model_p - outcome, 2)) as d from snap), e as (select count(*) filter (where k > 95) / count(*) as f from ev)
select 'timestamp_invariants' as criterion, {s6('a')} as value, a <= 0 as passed from m union all select 'independent_clusters', {s6('b')}, b >= 20 from m
union all select 'label_coverage', {s6('c')}, c >= 0.5 from m union all select 'model_beats_market', {s6('d')}, d >= 0 from m union all select 'late_receipts', {s6('f')}, f <= 0.1 from e""")
def a56(spark, sf):
    c = F.col
    p, m, y = c("model_p"), c("mid"), c("outcome")
    metrics = tb.snapshots(spark, sf).agg(
        F.count_if(c("resolved_us") < c("ts_us")).cast("double").alias("timestamp_invariants"),
        F.countDistinct("event_cluster").cast("double").alias("independent_clusters"),
        (F.count("outcome") / F.count(F.lit(1))).alias("label_coverage"),
        (F.avg(sc.squared_error(m, y)) - F.avg(sc.squared_error(p, y))).alias("model_beats_market"),
    ).unpivot([], ["timestamp_invariants", "independent_clusters", "label_coverage", "model_beats_market"], "criterion", "value")
    late = tb.event_rows(spark, sf).agg((F.count_if(c("k") > 95) / F.count(F.lit(1))).alias("value")).select(
        F.lit("late_receipts").alias("criterion"), "value"
    )
    # Thresholds of the gate, by criterion.
    limits = [("timestamp_invariants", "max", 0.0), ("independent_clusters", "min", 20.0), ("label_coverage", "min", 0.5),
              ("model_beats_market", "min", 0.0), ("late_receipts", "max", 0.1)]
    table = spark.createDataFrame(limits, "criterion string, kind string, threshold double")
    ok = F.when(c("kind") == "max", c("value") <= c("threshold")).otherwise(c("value") >= c("threshold"))
    return metrics.unionByName(late).join(table, "criterion").select("criterion", r6("value").alias("value"), ok.alias("passed"))


@query("a51_training_coverage", f"""with {SNAP}, tr as (select * from snap where ts_us < {SPLIT_US}), pr as (select category, avg(mid) m, avg(spread) s from snap where ts_us >= {SPLIT_US} group by 1)
select category, count(*) as observations, {s6('count(*) / (select count(*) from tr)')} as fraction,
 count(*) filter (where (case when abs(round(mid - m, 9)) < 0.1 then 1 else 0 end) + (case when abs(round(spread - s, 9)) < 0.1 then 1 else 0 end) >= 1) as similar,
 {s6(f"avg(cast(ts_us >= {SPLIT_US - 365 * DAY} as int))")} as recent_share from tr join pr using (category) group by 1""")
def a51(spark, sf):
    """Support of one prediction per category in the training rows (feature overlap)."""
    c = F.col
    snap = tb.snapshots(spark, sf)
    train = snap.where(c("ts_us") < SPLIT_US)
    preds = snap.where(c("ts_us") >= SPLIT_US).groupBy("category").agg(
        F.create_map(F.lit("mid"), F.avg("mid"), F.lit("spread"), F.avg("spread")).alias("want")
    )
    have = F.create_map(F.lit("mid"), c("mid"), F.lit("spread"), c("spread"))
    close = F.size(F.map_filter("want", lambda k, v: F.abs(F.round(F.try_element_at(c("have"), k) - v, 9)) < 0.1))
    rows = train.withColumn("have", have).join(preds, "category").withColumn("close", close)
    total = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    g = rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_if(c("close") >= F.greatest(F.lit(1), F.floor(F.size("want") / 2))).alias("similar"),
        F.avg((c("ts_us") >= SPLIT_US - 365 * DAY).cast("int")).alias("recent_share"),
    )
    return six(g.withColumn("total", total).select(
        "category", "observations", (c("observations") / c("total")).alias("fraction"), "similar", "recent_share"
    ))


@query("a45_correlation_adjusted_exposure", f"""with {QT}, {PAIRS}, {CORR}, pc as (select event, a, b, abs(corr(ra, rb)) c from al group by 1, 2, 3 having count(*) >= 3), {FILLS},
ps as (select token_id, sum(notional) e from fills where side = 'BUY' group by 1),
cl as (select event, avg(c) as avg_corr from pc where c is not null group by 1),
ex as (select event, sum(e) raw from ps join ek on market_slug = token_id group by 1)
select event as cluster, {s6('raw')} as raw, {s6('avg_corr')} as avg_correlation, {s6('raw * (1e0 + avg_corr / 2e0)')} as adjusted from ex join cl using (event)""")
def a45(spark, sf):
    """Exposure of an event scaled by half the mean absolute correlation inside it."""
    c = F.col
    inside = pairs.mean_correlation(daily_returns(spark, sf))
    spent = tb.fills(spark, sf).where("side = 'BUY'").groupBy(c("token_id").alias("market_slug")).agg(F.sum("notional").alias("e"))
    raw = spent.join(events_of(spark, sf), "market_slug").groupBy("event").agg(F.sum("e").alias("raw"))
    return six(raw.join(inside, "event").select(
        c("event").alias("cluster"), "raw", "avg_correlation", (c("raw") * (F.lit(1.0) + c("avg_correlation") / F.lit(2.0))).alias("adjusted")))


@query("a57_horizon_summary", f"""with {RES}, h as (select *, case when hours < 24 then 12 when hours < 168 then 72 else 500 end as horizon, round(spread, 9) > 0.045 as missing from snap)
select horizon, count(*) as pairs, count(*) filter (where not missing) as present, {s6('avg(cast(missing as int))')} as missing_rate, count(distinct ts_us // 86400000000) filter (where not missing) as days,
 case when count(*) filter (where not missing) < 500 then 'INSUFFICIENT_DATA' when avg(cast(missing as int)) > 0.2 then 'LOW_QUALITY' else '' end as flagged,
 case when count(*) filter (where not missing) >= 500 then {s6('avg(pow(mid - outcome, 2)) filter (where not missing)')} end as brier_mid,
 case when count(*) filter (where not missing) >= 500 then {s6('avg(pow(ask - outcome, 2)) filter (where not missing)')} end as brier_ask,
 case when count(*) filter (where not missing) >= 500 then {s6('avg(pow(bid - outcome, 2)) filter (where not missing)')} end as brier_bid from h group by 1""")
def a57(spark, sf):
    c = F.col
    horizon = F.when(c("hours") < 24, 12).when(c("hours") < 168, 72).otherwise(500)
    rows = tb.snapshots(spark, sf).withColumns({"horizon": horizon, "missing": F.round("spread", 9) > 0.045})
    here = ~c("missing")

    def brier(px):
        return F.avg(F.when(here, sc.squared_error(c(px), c("outcome"))))

    g = rows.groupBy("horizon").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(here).alias("present"), F.avg(c("missing").cast("int")).alias("missing_rate"),
        F.countDistinct(F.when(here, F.floor(c("ts_us") / F.lit(DAY)))).alias("days"),
        brier("mid").alias("bm"), brier("ask").alias("ba"), brier("bid").alias("bb"),
    )
    enough = c("present") >= 500
    flag = F.when(~enough, "INSUFFICIENT_DATA").when(c("missing_rate") > 0.2, "LOW_QUALITY").otherwise("")
    return six(g.select(
        "horizon", "pairs", "present", "missing_rate", "days", flag.alias("flagged"),
        F.when(enough, c("bm")).alias("brier_mid"), F.when(enough, c("ba")).alias("brier_ask"), F.when(enough, c("bb")).alias("brier_bid"),
    ))


@query("a57_horizon_bins", f"""with {RES}, h as (select *, case when hours < 24 then 12 when hours < 168 then 72 else 500 end as horizon, least(cast(floor(mid * 10e0) as int), 9) as bin from res),
g as (select horizon, bin, count(*) n, count(distinct ts_us // 86400000000) dd, avg(mid) p, avg(outcome) y from h group by 1, 2),
a as (select x.horizon, b.i as bin from (select distinct horizon from h) x, range(10) b(i))
select a.horizon, cast(a.bin as int) as bin, coalesce(n, 0) as n, coalesce(dd, 0) as days, case when n >= 30 and dd >= 5 then {s6('p')} end as mean_p, case when n >= 30 and dd >= 5 then {s6('y')} end as mean_y
from a left join g on a.horizon = g.horizon and a.bin = g.bin""")
def a57b(spark, sf):
    c = F.col
    horizon = F.when(c("hours") < 24, 12).when(c("hours") < 168, 72).otherwise(500)
    rows = op.resolved(tb.snapshots(spark, sf)).withColumns({"horizon": horizon, "bin": sc.unit_bin(c("mid"))})
    g = rows.groupBy("horizon", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.floor(c("ts_us") / F.lit(DAY))).alias("days"),
        F.avg("mid").alias("p"), F.avg("outcome").alias("y"),
    )
    grid = rows.select("horizon").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    enough = (c("n") >= 30) & (c("days") >= 5)
    return six(grid.join(g, ["horizon", "bin"], "left").select(
        "horizon", "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("days", F.lit(0)).alias("days"),
        F.when(enough, c("p")).alias("mean_p"), F.when(enough, c("y")).alias("mean_y"),
    ))


@query("a58_climatology_survival", f"""with {VINT}
select day, count(*) filter (where b is not null) as samples, case when count(b) >= 30 then {s6('avg(cast(b > 350000 as int))')} end as p_above from (
 select x.day, y.actual as b from act x left join act y on y.day between x.day - 60 and x.day - 1) group by 1""")
def a58(spark, sf):
    """Share of the previous 60 days whose peak was above the strike; null under 30 samples."""
    peaks = actual_peaks(spark, sf).withColumn("g", F.lit(1))

    def prior(df, w):
        span = w.rangeBetween(-60, -1)
        return df.withColumns({
            "samples": F.count(F.lit(1)).over(span),
            "hit": F.avg((F.col("actual") > 350000).cast("int")).over(span),
        })

    out = rolling_range(peaks, ["g"], "day", 60, prior)
    return out.select("day", "samples", F.when(F.col("samples") >= 30, r6("hit")).alias("p_above"))


RESID = VINT + f""", rs as (select delivery_day - publish_day as lead, round(actual - peak, 6) as e from vint join act on delivery_day = day where publish_day < {AS_OF_DAY}),
pb as (select doc_id, delivery_day - publish_day as lead, 350000 - peak as thr from vint where publish_day >= {AS_OF_DAY})"""


def survival(spark, sf):
    """P(actual > strike) per vintage: rank of (strike - forecast) among residuals of its lead."""
    c = F.col
    v = vintages(spark, sf).withColumn("lead", c("delivery_day") - c("publish_day"))
    act = actual_peaks(spark, sf)
    res = v.where(c("publish_day") < AS_OF_DAY).join(act, v["delivery_day"] == act["day"]).select(
        "lead", F.round(c("actual") - c("peak"), 6).alias("x"), F.lit(0).alias("probe")
    )
    probes = v.where(c("publish_day") >= AS_OF_DAY).select(
        "lead", (F.lit(350000.0) - c("peak")).alias("x"), F.lit(1).alias("probe"), "doc_id"
    )
    both = res.unionByName(probes, allowMissingColumns=True)
    ranked = running(both, ["lead"], "x", ["probe"], {"r": ("sum", F.when(c("probe") == 0, 1).otherwise(0))})
    n = res.groupBy("lead").agg(F.count(F.lit(1)).alias("n"))
    return ranked.where("probe = 1").join(n, "lead").select(
        "doc_id", "lead", F.when(c("n") >= 5, F.lit(1.0) - c("r") / (c("n") + 1)).alias("p_above")
    )


@query("a58_lead_matched_survival", f"""with {RESID}
select doc_id, pb.lead, {s6('1e0 - count(*) filter (where e <= thr) / (count(*) + 1)')} as p_above from pb join rs using (lead) group by 1, 2""")
def a58b(spark, sf):
    return six(survival(spark, sf))


@query("a59_peak_quantiles", f"""with {VINT}, m as (select day // 30 as month, actual, row_number() over (partition by day // 30 order by actual) rn, count(*) over (partition by day // 30) n from act)
select month, max(n) as n, max(actual) filter (where rn = least(floor(5e-1 * n), n - 1) + 1) as q50, max(actual) filter (where rn = least(floor(9e-1 * n), n - 1) + 1) as q90 from m group by 1""")
def a59(spark, sf):
    rows = actual_peaks(spark, sf).select(F.floor(F.col("day") / 30).cast("bigint").alias("month"), "actual")
    return nearest_rank(rows, ["month"], "actual", {
        "q50": lambda n: F.least(F.floor(F.lit(0.5) * n), n - 1) + 1, "q90": lambda n: F.least(F.floor(F.lit(0.9) * n), n - 1) + 1,
    })


@query("a60_daily_peak", f"""with {LOAD} select day, max(mw) as peak, count(*) as readings, arg_max(hour, (mw, doc_id)) as peak_hour from load_rows group by 1""")
def a60(spark, sf):
    return tb.daily_load(spark, sf).groupBy("day").agg(
        F.max("mw").alias("peak"), F.count(F.lit(1)).alias("readings"), F.max_by("hour", F.struct("mw", "doc_id")).alias("peak_hour")
    )


@query("s23_hourly_load_rows", f"""with {LOAD} select day, hour, count(*) as rows, max(mw) as mw from load_rows group by 1, 2""")
def s23(spark, sf):
    """Load files are CSV text with US dates; rows are re-read through that format."""
    c = F.col
    text = tb.daily_load(spark, sf).select(F.concat_ws(
        ",", F.date_format(F.date_from_unix_date(c("day").cast("int")), "MM/dd/yyyy"), "hour", F.format_string("%.2f", "mw")
    ).alias("line"))
    rec = F.from_csv("line", F.lit("day string, hour bigint, mw double"))
    rows = text.select(rec.alias("r")).select(
        F.unix_date(F.to_date("r.day", "MM/dd/yyyy")).cast("bigint").alias("day"), "r.hour", "r.mw"
    )
    return rows.groupBy("day", "hour").agg(F.count(F.lit(1)).alias("rows"), F.max("mw").alias("mw"))


@query("s24_interval_prices", f"""with {LOAD} select day, hour, max(mw) filter (where rn = 1) as price, count(*) as revisions from (
 select *, row_number() over (partition by day, hour order by doc_id desc) rn from load_rows) group by 1, 2""")
def s24(spark, sf):
    c = F.col
    wire = tb.daily_load(spark, sf).select("doc_id", F.to_json(F.struct(
        F.array(F.lit("day"), F.lit("hour"), F.lit("price")).alias("fields"),
        F.array(c("day").cast("string"), c("hour").cast("string"), c("mw").cast("string")).alias("row"),
    )).alias("wire"))
    rec = F.from_json("wire", "fields array<string>, row array<string>")
    m = wire.select("doc_id", F.map_from_arrays(rec["fields"], rec["row"]).alias("m"))
    rows = m.select("doc_id", c("m")["day"].cast("bigint").alias("day"), c("m")["hour"].cast("bigint").alias("hour"), c("m")["price"].cast("double").alias("price"))
    return rows.groupBy("day", "hour").agg(F.max_by("price", "doc_id").alias("price"), F.count(F.lit(1)).alias("revisions"))


@query("s25_intraday_running_max", f"""with {LOAD} select doc_id, day, max(mw) over (partition by day order by hour, doc_id) as running_max from load_rows""")
def s25(spark, sf):
    out = running(tb.daily_load(spark, sf), ["day"], "hour", ["doc_id"], {"running_max": ("max", F.col("mw"))})
    return out.select("doc_id", "day", "running_max")


@query("s40_first_and_latest_vintage", f"""with {VINT} select publish_day, delivery_day, count(*) as rows, arg_min(peak, doc_id) as first_peak, arg_max(peak, doc_id) as latest_peak,
 count(*) >= 2 as complete from vint group by 1, 2""")
def s40(spark, sf):
    return vintages(spark, sf).groupBy("publish_day", "delivery_day").agg(
        F.count(F.lit(1)).alias("rows"), F.min_by("peak", "doc_id").alias("first_peak"), F.max_by("peak", "doc_id").alias("latest_peak"),
        (F.count(F.lit(1)) >= 2).alias("complete"),
    )


LADDER_SQL = SNAP + ", " + LAT.replace("arg_max(ask, (ts_us, rid)) as ask", "arg_max(ask, (ts_us, rid)) as ask, arg_max(bid, (ts_us, rid)) as bid") + """, rung as (
 select l.*, p_retailprice as threshold, ec || '/' || cat as ladder from latest l join part on market_id = 'm' || p_partkey)"""


def rungs(spark, sf):
    """Threshold ladders: the latest quote of every market at its strike."""
    part = tb.load(spark, sf, "part").select(
        F.concat(F.lit("m"), F.col("p_partkey")).alias("market_id"), F.col("p_retailprice").alias("threshold")
    )
    return latest_by_market(spark, sf).join(part, "market_id").withColumn(
        "ladder", F.concat_ws("/", "event_cluster", "category")
    )


@query("s26_ladder_snapshot", f"""with {LADDER_SQL} select ladder, market_id, threshold, {s6('bid')} as yes_bid, {s6('ask')} as yes_ask, {s6('1e0 - ask')} as no_bid, {s6('1e0 - bid')} as no_ask from rung""")
def s26(spark, sf):
    c = F.col
    return rungs(spark, sf).select(
        "ladder", "market_id", "threshold", r6("bid").alias("yes_bid"), r6("ask").alias("yes_ask"),
        r6(F.lit(1.0) - c("ask")).alias("no_bid"), r6(F.lit(1.0) - c("bid")).alias("no_ask"),
    )


@query("w16_cross_strike_monotonicity", f"""with {LADDER_SQL}, w as (select ladder, bid, ask, (bid + ask) / 2 as mid, lag((bid + ask) / 2) over x as pm, lag(ask) over x as pa from rung
 window x as (partition by ladder order by threshold, market_id))
select ladder, count(*) as strikes, count(*) filter (where mid > pm + 1e-9) as mid_rises, count(*) filter (where bid > pa + 1e-9) as arbitrage from w group by 1""")
def w16(spark, sf):
    c = F.col
    rows = rungs(spark, sf).withColumn("m", (c("bid") + c("ask")) / F.lit(2.0))
    lagged = running(rows, ["ladder"], "threshold", ["market_id"], {"p": ("lag", F.struct("m", "ask"))})
    return lagged.groupBy("ladder").agg(
        F.count(F.lit(1)).alias("strikes"), F.count_if(c("m") > c("p.m") + 1e-9).alias("mid_rises"),
        F.count_if(c("bid") > c("p.ask") + 1e-9).alias("arbitrage"),
    )


@query("x08_ladder_explosion", f"""with {LADDER_SQL}, s as (select market_id, unnest(['YES', 'NO']) as side, unnest([ask, 1e0 - bid]) as price from rung)
select side, count(*) as n, {s6('avg(price)')} as mean_price from s group by 1""")
def x08(spark, sf):
    """Table-valued explosion of each rung into its two executable sides."""
    c = F.col
    sides = F.array(
        F.struct(F.lit("YES").alias("side"), c("ask").alias("price")),
        F.struct(F.lit("NO").alias("side"), (F.lit(1.0) - c("bid")).alias("price")),
    )
    return six(rungs(spark, sf).select(F.inline(sides)).groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.avg("price").alias("mean_price")
    ))


F22_SQL = LADDER_SQL + """, s as (select market_id, unnest(['YES', 'NO']) as side, unnest([ask, 1e0 - bid]) as px, unnest([p, 1e0 - p]) as mp, fr, cat from rung),
e as (select *, mp - px - fr * px * (1e0 - px) - 1e-2 as edge from s),
r as (select *, case when cat = 'PROMO' then 'MARKET_CLOSED' when px <= 0 or px >= 1 then 'NO_QUOTE' when fr = 0 then 'FEE_UNVERIFIED' when round(edge, 9) < 2e-2 then 'EDGE_BELOW' else 'ELIGIBLE' end as reason from e)"""


@query("f22_screen_edge", f"""with {F22_SQL} select side, reason, count(*) as n, {s6('avg(edge)')} as mean_edge from r group by 1, 2""")
def f22(spark, sf):
    c = F.col
    sides = F.array(
        F.struct(F.lit("YES").alias("side"), c("ask").alias("px"), c("model_p").alias("mp")),
        F.struct(F.lit("NO").alias("side"), (F.lit(1.0) - c("bid")).alias("px"), (F.lit(1.0) - c("model_p")).alias("mp")),
    )
    rows = rungs(spark, sf).select("market_id", "category", "fee_rate", F.inline(sides))
    edge = c("mp") - c("px") - bk.fee_per_contract(c("px"), c("fee_rate")) - F.lit(0.01)
    reason = (
        F.when(c("category") == "PROMO", "MARKET_CLOSED").when((c("px") <= 0) | (c("px") >= 1), "NO_QUOTE")
        .when(c("fee_rate") == 0, "FEE_UNVERIFIED").when(F.round(c("edge"), 9) < 0.02, "EDGE_BELOW").otherwise("ELIGIBLE")
    )
    return six(rows.withColumn("edge", edge).groupBy("side", reason.alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("edge").alias("mean_edge")
    ))


@query("a61_cross_market_features", f"""with {SNAP}, {LAT} select ec as event_cluster, count(*) as markets, {s6('stddev_pop(ask)')} as dispersion, {s6('abs(sum(p) - 1)')} as partition_deviation,
 {s6('max(abs(p - ask))')} as max_mispricing from latest group by 1""")
def a61(spark, sf):
    c = F.col
    return six(latest_by_market(spark, sf).groupBy("event_cluster").agg(
        F.count(F.lit(1)).alias("markets"), F.stddev_pop("ask").alias("dispersion"),
        F.abs(F.sum("model_p") - 1).alias("partition_deviation"), F.max(F.abs(c("model_p") - c("ask"))).alias("max_mispricing"),
    ))


B = 2000
H_SQL = NEAR + """, sg as (select t.*, case when taker_side = 'BUY' then 1 else -1 end as s from tol t where ok and horizon in (1, 6, 24)),
ob as (select horizon, market_slug as event_cluster, s * (mid - price) as gross, s * (mid - price) - 5e-3 - 7e-2 * mid * (1e0 - mid) as net from sg),
cl as (select horizon, event_cluster, sum(net) as sn, sum(gross) as sg, count(*) as n from ob group by 1, 2)"""


@query("a62_hypothesis_study", f"""with {H_SQL}, d as {draws(B, 'event_cluster')}, st as (select horizon, b, sum(w * sn) / sum(w * n) as m from d group by 1, 2),
pv as (select horizon, count(*) filter (where m <= 0) / count(*) as p, list_sort(list(m)) as s from st group by 1),
g as (select horizon, cast(sum(n) as bigint) as labelled, count(*) as clusters, sum(sg) / sum(n) as gross, sum(sn) / sum(n) as net from cl group by 1),
h as (select g.*, p, s, row_number() over (order by p, horizon) i, count(*) over () m from g join pv using (horizon)),
ho as (select *, least(1, max(p * (m - i + 1)) over (order by i)) as holm from h)
select horizon, labelled, clusters, {s6('gross')} as gross, {s6('net')} as net, {s6(f's[{int(0.025 * B) + 1}]')} as ci_lower, {s6(f's[{int(0.975 * B)}]')} as ci_upper, {s6('p')} as p_raw, {s6('holm')} as p_holm,
 case when holm < 0.05 and net > 0 then 'SUPPORTED' else 'CONTINUE' end as decision from ho""")
def a62(spark, sf):
    """Signed move after each trade at several horizons, net of costs, with cluster inference."""
    c = F.col
    rows = nearest_quotes(spark, sf).where("near is not null")
    sign = F.when(c("taker_side") == "BUY", 1).otherwise(-1)
    m = c("near.mid")
    gross = sign * (m - c("price"))
    cl = rows.select(
        "horizon", c("market_slug").alias("event_cluster"), gross.alias("gross"),
        (gross - F.lit(0.005) - F.lit(0.07) * m * (F.lit(1.0) - m)).alias("net"),
    ).groupBy("horizon", "event_cluster").agg(F.sum("net").alias("sn"), F.sum("gross").alias("sg"), F.count(F.lit(1)).alias("n"))
    ci = rs.bootstrap(cl, "event_cluster", ["sn", "n"], F.try_divide, B, keys=["horizon"]).withColumn(
        "p_raw", F.size(F.filter("stats", lambda m: m <= 0)) / F.size("stats"))
    g = cl.groupBy("horizon").agg(F.sum("n").alias("labelled"), (F.sum("sg") / F.sum("n")).alias("gross"))
    t = ci.join(g, "horizon").withColumnRenamed("estimate", "net").withColumn("fam", F.lit(1))
    t = inf.adjust(t, ["fam"], "p_raw", "horizon")
    decision = F.when((c("holm") < 0.05) & (c("net") > 0), "SUPPORTED").otherwise("CONTINUE")
    return six(t.select(
        "horizon", "labelled", "clusters", "gross", "net", "ci_lower", "ci_upper", "p_raw", c("holm").alias("p_holm"), decision.alias("decision")
    ))


@query("a63_liquidity_by_category", f"""with {LEVELS}, w0 as (select *, coalesce(sum(size) over (partition by event_id order by i rows between unbounded preceding and 1 preceding), 0) bf from lv where side = 'ask'),
v as (select event_id, any_value(market_slug) as slug, round(sum(greatest(0, least(size, 50e0 - bf)) * price) / sum(greatest(0, least(size, 50e0 - bf))), 9) as vwap, sum(size) as depth from w0 group by 1),
r as (select length(slug) as stratum, vwap, depth, row_number() over (partition by length(slug) order by vwap) rn, count(*) over (partition by length(slug)) n from v)
select cast(stratum as int) as stratum, max(n) as n, {s6('max(vwap) filter (where rn = n // 2 + 1)')} as median_vwap, {s6('avg(depth)')} as mean_depth from r group by 1""")
def a63(spark, sf):
    c = F.col
    rows = tb.books(spark, sf).where(F.size("asks") > 0).select(
        F.length("market_slug").alias("stratum"), F.round(bk.walk(c("asks"), F.lit(50.0), F.lit(0.0))["vwap"], 9).alias("vwap"),
        bk.depth(c("asks"), 5).alias("depth"),
    )
    med = nearest_rank(rows, ["stratum"], "vwap", {"median_vwap": lambda n: F.floor(n / 2) + 1})
    mean = rows.groupBy("stratum").agg(F.avg("depth").alias("mean_depth"))
    return six(med.join(mean, "stratum"))


@query("a64_latency_report", f"""with {EV}, st as (select event_type, k * 10 as parse, case when event_id % 11 = 0 then k * 10 - 5 else k * 12 + 3 end as publish from ev),
ok as (select *, publish - parse as d, row_number() over (partition by event_type order by publish - parse) rn, count(*) over (partition by event_type) n from st where publish >= parse and parse >= 0),
bad as (select event_type, count(*) filter (where publish < parse) as v from st group by 1)
select event_type, max(n) as n, max(d) filter (where rn = greatest(1, round_even(n * 5e-1, 0))) as p50, max(d) filter (where rn = greatest(1, round_even(n * 99e-2, 0))) as p99,
 count(*) filter (where d > 100) as over_100, max(v) as violations from ok join bad using (event_type) group by 1""")
def a64(spark, sf):
    c = F.col
    rows = tb.event_rows(spark, sf).select("event_type", F.create_map(
        F.lit("parse"), c("k") * 10, F.lit("publish"), F.when(c("event_id") % 11 == 0, c("k") * 10 - 5).otherwise(c("k") * 12 + 3)
    ).alias("stages"))
    d = c("stages")["publish"] - c("stages")["parse"]
    rows = rows.withColumns({"d": d, "ordered": d >= 0})
    ok = rows.where("ordered")
    ranks = nearest_rank(ok, ["event_type"], "d", {
        "p50": lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(0.5))), "p99": lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(0.99))),
    })
    counts = rows.groupBy("event_type").agg(
        F.count_if(c("ordered") & (c("d") > 100)).alias("over_100"), F.count_if(~c("ordered")).alias("violations")
    )
    return ranks.join(counts, "event_type")


@query("a68_distinct_counts", f"""with {SNAP} select category, count(distinct event_cluster) as clusters, count(distinct market_id) as markets, count(distinct ts_us // 86400000000) as days from snap group by 1""")
def a68(spark, sf):
    return tb.snapshots(spark, sf).groupBy("category").agg(
        F.countDistinct("event_cluster").alias("clusters"), F.countDistinct("market_id").alias("markets"),
        F.countDistinct(F.floor(F.col("ts_us") / F.lit(DAY))).alias("days"),
    )


@query("a70_lineage_audit", f"""with {BOOK}, w as (select *, lag(ts_us) over (partition by market_slug order by event_id) as pt from bb)
select market_slug, count(*) as n, count(*) filter (where nb > 0 and na > 0) as two_sided, count(*) filter (where ts_us < pt) as reversals,
 count(*) filter (where nb > 0 and abs(bb * 1000 - round(bb * 1000)) > 1e-6) as off_grid, {s6('avg(ts_us - pt) / 36e8')} as cadence_hours from w group by 1""")
def a70(spark, sf):
    c = F.col
    lagged = running(tb.books(spark, sf), ["market_slug"], "event_id", [], {"pt": ("lag", c("ts_us"))})
    bid = bk.best(c("bids"))
    return six(lagged.groupBy("market_slug").agg(
        F.count(F.lit(1)).alias("n"), F.count_if((F.size("bids") > 0) & (F.size("asks") > 0)).alias("two_sided"),
        F.count_if(c("ts_us") < c("pt")).alias("reversals"),
        F.count_if(F.abs(bid * 1000 - F.round(bid * 1000)) > 1e-6).alias("off_grid"),
        (F.avg(c("ts_us") - c("pt")) / F.lit(3.6e9)).alias("cadence_hours"),
    ))


@query("a71_readiness_counts", f"""with {VINT} select delivery_day - publish_day as lead, count(*) as residuals, max(publish_day) as newest_vintage, count(*) >= 5 as ready from vint join act on delivery_day = day group by 1""")
def a71(spark, sf):
    v, a = vintages(spark, sf), actual_peaks(spark, sf)
    return v.join(a, v["delivery_day"] == a["day"]).groupBy((F.col("delivery_day") - F.col("publish_day")).alias("lead")).agg(
        F.count(F.lit(1)).alias("residuals"), F.max("publish_day").alias("newest_vintage"), (F.count(F.lit(1)) >= 5).alias("ready")
    )


@query("a72_fee_manifest", f"""with {QUOTES}, cur as (select 'm' || s_suppkey as market_slug, cast(floor(s_acctbal) as bigint) as coef from supplier)
select coalesce(cast(coef as varchar), 'UNKNOWN') as fee, count(distinct market_slug) as markets, count(*) as n from quotes left join cur using (market_slug) where coef is null or coef > 0 group by 1""")
def a72(spark, sf):
    cur = tb.load(spark, sf, "supplier").select(
        F.concat(F.lit("m"), F.col("s_suppkey")).alias("market_slug"), F.floor("s_acctbal").cast("bigint").alias("coef")
    )
    rows = tb.quotes(spark, sf).join(cur, "market_slug", "left").where("coef is null or coef > 0")
    return rows.groupBy(F.coalesce(F.col("coef").cast("string"), F.lit("UNKNOWN")).alias("fee")).agg(
        F.countDistinct("market_slug").alias("markets"), F.count(F.lit(1)).alias("n")
    )


CUTOVER = 1_704_672_000_000_000  # 2024-01-08


@query("p09_evidence_class", f"""with {EV}, x as (select *, ts_us + k * 1000000 as received, case when event_type = 'error' then null else ts_us + 3600000000 end as ie,
 row_number() over (partition by user_id, ts_us // 86400000000 order by ts_us + k * 1000000, event_id) = 1 as is_first from ev)
select case when ie is null then 'UNRESOLVED_TIME_SEMANTICS' when ie <= {CUTOVER} then 'BOOTSTRAP' when received <= {CUTOVER} then 'RECEIPT_PRE_CUTOVER' when not is_first then 'REVISION' else 'PROSPECTIVE' end as evidence_class,
 count(*) as n from x group by 1""")
def p09(spark, sf):
    c = F.col
    ev = tb.event_rows(spark, sf).withColumns({
        "received": c("ts_us") + c("k") * 1_000_000, "d": F.floor(c("ts_us") / F.lit(DAY)),
        "ie": F.when(c("event_type") != "error", c("ts_us") + 3_600_000_000),
    })
    ev = running(ev, ["user_id", "d"], "received", ["event_id"], {"rn": ("count", None)})
    label = (
        F.when(c("ie").isNull(), "UNRESOLVED_TIME_SEMANTICS").when(c("ie") <= CUTOVER, "BOOTSTRAP")
        .when(c("received") <= CUTOVER, "RECEIPT_PRE_CUTOVER").when(c("rn") > 1, "REVISION").otherwise("PROSPECTIVE")
    )
    return ev.groupBy(label.alias("evidence_class")).agg(F.count(F.lit(1)).alias("n"))


@query("j26_revision_surprise", f"""with {VINT}, r as (select *, lag(peak) over (partition by delivery_day order by publish_day, doc_id) as pp from vint),
sp as (select * from r where abs(peak - pp) >= 100000)
select case when peak > pp then 'UP' else 'DOWN' end as direction, count(*) as surprises, {s6('avg(peak - pp)')} as mean_delta, count(distinct delivery_day) as days from sp group by 1""")
def j26(spark, sf):
    c = F.col
    prev = running(vintages(spark, sf), ["delivery_day"], "publish_day", ["doc_id"], {"pp": ("lag", c("peak"))})
    move = c("peak") - c("pp")
    return six(prev.where(F.abs(move) >= 100000).groupBy(F.when(move > 0, "UP").otherwise("DOWN").alias("direction")).agg(
        F.count(F.lit(1)).alias("surprises"), F.avg(move).alias("mean_delta"), F.countDistinct("delivery_day").alias("days")
    ))


@query("j27_first_qualifying_snapshot", f"""with {QT}, nq as (select t.event_id, t.market_slug, greatest(t.ts_us, t.ts_us + t.size * 60000000) as known_us from trades t),
a as (select n.event_id, q.event_id as quote_id, q.ts_us - n.known_us as wait_us from nq n asof left join quotes q on n.market_slug = q.market_slug and n.known_us <= q.ts_us)
select event_id, quote_id, wait_us from a""")
def j27(spark, sf):
    """First quote after a forecast was both published and received."""
    c = F.col
    q = tb.quotes(spark, sf).withColumn("q_us", c("ts_us"))
    probes = tb.trades(spark, sf).withColumn("known_us", F.greatest(c("ts_us"), c("ts_us") + c("size") * 60_000_000))
    out = asof.asof_join(probes, q, ["market_slug"], "known_us", "q_us", ["event_id", "q_us"], forward=True, tie=c("event_id"))
    return out.select("event_id", c("asof.event_id").alias("quote_id"), (c("asof.q_us") - c("known_us")).alias("wait_us"))


@query("j28_settlement_agreement", f"""with {VINT}, o as (select doc_id, delivery_day, peak * 102e-2 as strike, doc_id % 2 as claimed from vint)
select (actual > strike) = (claimed = 1) as agrees, count(*) as n, count(distinct delivery_day) as days from o join act on delivery_day = day group by 1""")
def j28(spark, sf):
    c = F.col
    o = vintages(spark, sf).select("delivery_day", (c("peak") * F.lit(1.02)).alias("strike"), (c("doc_id") % 2).alias("claimed"))
    a = actual_peaks(spark, sf)
    agrees = (c("actual") > c("strike")) == (c("claimed") == 1)
    return o.join(a, o["delivery_day"] == a["day"]).groupBy(agrees.alias("agrees")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("delivery_day").alias("days")
    )


@query("f26_entry_evaluation", f"""with {BOOK}, m as (select *, (bb + ba) / 2e0 as mid from bb), x as (select event_id, concat_ws(',',
 case when ts_us > {AS_OF} then 'future_book' end, case when {AS_OF} - ts_us > {10 * DAY} then 'stale_book' end, case when ba - bb is null then 'one_sided_book' end,
 case when ba - bb <= 0 then 'locked_or_crossed_book' end, case when round(ba - bb, 9) > 0.04 then 'spread_too_wide' end, case when least(bd, ad) < 100 then 'insufficient_depth' end,
 case when round(mid + 5e-2 - ba - 2e-2 * ba * (1e0 - ba) - 1e-2, 9) < 1e-2 then 'edge_below_minimum' end) as rejections, mid + 5e-2 - ba - 2e-2 * ba * (1e0 - ba) - 1e-2 as edge from m)
select rejections, count(*) as n, {s6('avg(edge)')} as mean_edge from x group by 1""")
def f26(spark, sf):
    c = F.col
    mid, ask = bk.mid(c("bids"), c("asks")), bk.best(c("asks"))
    edge = mid + F.lit(0.05) - ask - bk.fee_per_contract(ask, F.lit(0.02)) - F.lit(0.01)
    low = F.when(F.round(edge, 9) < 0.01, F.lit("edge_below_minimum"))
    all_reasons = F.array_compact(F.concat(book_reasons(AS_OF), F.array(low)))
    rows = tb.books(spark, sf).select(F.concat_ws(",", all_reasons).alias("rejections"), edge.alias("edge"))
    return six(rows.groupBy("rejections").agg(F.count(F.lit(1)).alias("n"), F.avg("edge").alias("mean_edge")))


@query("a23_strategy_sheet", f"""with {NEAR}, {FILLS}, mk as (select horizon, count(*) n, count(*) filter (where ok) ok, avg(case when ok then mid - price end) m from tol group by 1)
select 'markout' as block, 'h' || horizon as item, n, case when ok >= 30 then {s6('m')} end as value from mk
union all select 'trades', side, count(*), {s6('avg(pnl_per_share)')} from fills group by 2
union all select 'settlement', case when pnl_per_share > 0 then 'won' when pnl_per_share < 0 then 'lost' else 'open' end, count(*), {s6('sum(pnl_per_share * shares)')} from fills group by 2""")
def a23(spark, sf):
    c = F.col
    fills = tb.fills(spark, sf)
    mk = nearest_quotes(spark, sf).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.count("near").alias("ok"), F.avg(c("near.mid") - c("price")).alias("m")
    ).select(F.lit("markout").alias("block"), F.concat(F.lit("h"), "horizon").alias("item"), "n", F.when(c("ok") >= 30, r6("m")).alias("value"))
    tr = fills.groupBy("side").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("pnl_per_share")).alias("value")).select(
        F.lit("trades").alias("block"), c("side").alias("item"), "n", "value"
    )
    state = F.when(c("pnl_per_share") > 0, "won").when(c("pnl_per_share") < 0, "lost").otherwise("open")
    st = fills.groupBy(state.alias("item")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(c("pnl_per_share") * c("shares"))).alias("value")
    ).select(F.lit("settlement").alias("block"), "item", "n", "value")
    return mk.unionByName(tr).unionByName(st)


@query("s27_push_events", """select event_type as league, count(*) as n, cast(sum(cast(regexp_extract(props, '"k": (\\d+)', 1) as bigint)) as bigint) as clock, count(distinct user_id) as games from events group by 1""")
def s27(spark, sf):
    """Canonical event from provider pushes whose fields sit on alternative paths."""
    c = F.col
    raw = tb.load(spark, sf, "events").select("event_type", F.concat(
        F.lit('{"payload":{"game":{"id":"g'), c("user_id"), F.lit('"},"event":'),
        F.when(c("event_type") == "click", F.regexp_replace("props", '"k"', '"clock"')).otherwise(c("props")), F.lit("}}"),
    ).alias("wire"))
    clock = F.coalesce(F.get_json_object("wire", "$.payload.event.clock"), F.get_json_object("wire", "$.payload.event.k"))
    rows = raw.select(c("event_type").alias("league"), clock.cast("bigint").alias("clock"), F.get_json_object("wire", "$.payload.game.id").alias("game"))
    return rows.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.sum("clock").alias("clock"), F.countDistinct("game").alias("games"))


@query("s03_receipt_export", f"""with {EV} select count(*) as n, min(ts_us) as first_us, max(ts_us + k * 1000000) as last_us from ev
where ts_us + k * 1000000 <= {AS_OF} and (event_type = 'signup' or ts_us <= {AS_OF})""")
def s03(spark, sf):
    """The rows an export at the instant holds, through their JSON line form."""
    from tidemark.sources import receipts as rc

    rows = rc.replay(rc.receipts(spark, sf).withColumn("t", F.get_json_object("payload", "$.event").cast("bigint")), AS_OF)
    lines = rows.select(F.to_json(F.struct(*rc.RECEIPTS.fieldNames())).alias("line"))
    back = lines.select(F.from_json("line", rc.RECEIPTS).alias("r")).select("r.*")
    k = F.get_json_object("payload", "$.k").cast("bigint")
    return back.agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("received_us") - k * 1_000_000).alias("first_us"), F.max("received_us").alias("last_us")
    )


@query("x03_user_price_function", f"""with {QT}, a as (select t.taker_side, q.mid - t.price as d from trades t asof join quotes q on t.market_slug = q.market_slug and t.ts_us + 6 * {HOUR} >= q.ts_us)
select taker_side, count(*) as n, {s6('avg(d)')} as mean_move from a group by 1""")
def x03(spark, sf):
    """A user price function of time is a table of (market, time, price) joined as of."""
    prices = tb.quotes(spark, sf).select("market_slug", F.col("ts_us").alias("q_us"), F.col("mid").alias("px"), F.col("event_id").alias("price_id"))
    probes = asof.at_horizons(tb.trades(spark, sf), "ts_us", [6], HOUR)
    out = asof.asof_join(probes, prices, ["market_slug"], "target_us", "q_us", ["px"], tie=F.col("price_id")).where("asof is not null")
    return six(out.groupBy("taker_side").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("asof.px") - F.col("price")).alias("mean_move")))


@query("x05_parameter_grid_function", f"""with {SNAP}, g as (select unnest([1e-2, 5e-2, 1e-1]) as th)
select th as threshold, count(*) as n, {s6('avg(outcome - ask)')} as metric from snap, g where outcome is not null and model_p - ask > th group by 1""")
def x05(spark, sf):
    """A user evaluation function run over a grid, results as one table."""
    def evaluate(df, threshold):
        return df.where(F.col("model_p") - F.col("ask") > threshold).agg(
            F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("outcome") - F.col("ask"))).alias("metric")
        )

    rows = tb.snapshots(spark, sf).where("outcome is not null").select("model_p", "ask", "outcome")
    out = None
    for th in (0.01, 0.05, 0.1):
        part = evaluate(rows, th).withColumn("threshold", F.lit(th))
        out = part if out is None else out.unionByName(part)
    return out
