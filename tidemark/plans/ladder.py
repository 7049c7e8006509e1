"""Ladder observations, their resolutions and the strategy sheet built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scoring as sc
from tidemark.functions.stats import normal_cdf, normal_cdf_sql
from tidemark.operators.ordered import nearest_rank
from tidemark.plans.bindings import FILLS
from tidemark.plans.pit import AS_OF_DAY, DAY, HOUR, VINT, actual_peaks, vintages
from tidemark.plans.registry import query, r6, s6
from tidemark.plans.scores import ll, six
from tidemark.sources import tables as tb

FLAT, GATE = 0.07, 30
# An observation is taken once per closed day: at the first instant at which the ladder was captured
# after the day's first forecast was both published and received, for every strike captured then.
OBSERVED_SQL = VINT + f""", fv as (select *, row_number() over (partition by delivery_day order by publish_day, doc_id) as rn from vint where delivery_day <= {AS_OF_DAY}),
f0 as (select delivery_day, publish_day, doc_id, peak as fpeak, greatest(publish_day * {DAY}, publish_day * {DAY} + (doc_id % 24) * {HOUR}) as known from fv where rn = 1 and delivery_day in (select day from act)),
lq as (select epoch_us(l_shipdate) as cap, epoch_us(l_shipdate) // {DAY} + l_linenumber % 7 as delivery_day, 80000e0 * (1 + l_suppkey % 5) as strike, (l_quantity - 5e-1) / 50e0 as mid,
  (l_quantity - 5e-1) / 50e0 + 1e-2 + l_discount / 2e0 as ask, (l_quantity - 5e-1) / 50e0 - 1e-2 - l_discount / 2e0 as bid, l_orderkey || '|' || l_linenumber as qid from lineitem),
ts as (select delivery_day, min(cap) as star from f0 join lq using (delivery_day) where cap >= known group by 1),
sn as (select delivery_day, strike, star, arg_max(ask, qid) as ask, arg_max(bid, qid) as bid, arg_max(mid, qid) as mid from ts join lq using (delivery_day) where cap = star group by 1, 2, 3),
rs as (select delivery_day - publish_day as lead, avg(actual - peak) as bias, stddev_samp(actual - peak) as sd from vint join act on delivery_day = day where delivery_day - publish_day between 0 and 6 group by 1),
o1 as (select sn.*, f0.doc_id, f0.publish_day, known, fpeak, 1e0 - {normal_cdf_sql('((strike - (fpeak + bias)) / sd)')} as p from sn join f0 using (delivery_day) join rs on lead = delivery_day - publish_day),
ob as (select *, p - ask - {FLAT} as edge_yes, (1e0 - p) - (1e0 - bid) - {FLAT} as edge_no from o1),
ve as (select delivery_day, strike, arg_max(mid, (cap, qid)) > 0.5 as venue_yes from lq group by 1, 2),
re as (select ob.*, actual, actual > strike as physical_yes, venue_yes from ob join act on day = delivery_day join ve using (delivery_day, strike))"""


def ladder(spark, sf):
    """Quotes of rungs: capture time, delivery day, strike, prices."""
    c = F.col
    price, at = (c("l_quantity") - F.lit(0.5)) / F.lit(50.0), tb.micros("l_shipdate")
    half = F.lit(0.01) + c("l_discount") / F.lit(2.0)
    return tb.load(spark, sf, "lineitem").select(
        at.alias("cap"), (F.floor(at / DAY) + c("l_linenumber") % 7).cast("long").alias("delivery_day"), (F.lit(80000.0) * (F.lit(1) + c("l_suppkey") % 5)).alias("strike"),
        price.alias("mid"), (price + half).alias("ask"), (price - half).alias("bid"), F.concat_ws("|", "l_orderkey", "l_linenumber").alias("qid"))


def observations(spark, sf):
    """One row per closed day and strike, at the first capture after the forecast was known."""
    c = F.col
    quotes, actual = ladder(spark, sf), actual_peaks(spark, sf)
    known = F.greatest(c("publish_day") * DAY, c("publish_day") * DAY + (c("doc_id") % 24) * HOUR)
    first = vintages(spark, sf).where(c("delivery_day") <= AS_OF_DAY).groupBy("delivery_day").agg(
        F.min(F.struct("publish_day", "doc_id", c("peak").alias("fpeak"))).alias("f")).select("delivery_day", "f.*").withColumn("known", known)
    first = first.join(actual.select(c("day").alias("delivery_day")), "delivery_day", "left_semi")
    met = quotes.join(first.select("delivery_day", "known"), "delivery_day").where("cap >= known")
    # The earliest instant per day keeps its rungs; a rung captured twice then counts by its last quote.
    rungs = met.groupBy("delivery_day", "strike", "cap").agg(F.max_by(F.struct("ask", "bid", "mid"), "qid").alias("q"))
    star = met.groupBy("delivery_day").agg(F.min("cap").alias("star"))
    at = rungs.join(star, "delivery_day").where("cap = star").select("delivery_day", "strike", "star", "q.*")
    v = vintages(spark, sf)
    lead = c("delivery_day") - c("publish_day")
    errors = v.join(actual, v["delivery_day"] == actual["day"]).where(lead.between(0, 6)).groupBy(lead.alias("lead")).agg(
        F.avg(c("actual") - c("peak")).alias("bias"), F.stddev_samp(c("actual") - c("peak")).alias("sd"))
    rows = at.join(first, "delivery_day").withColumn("lead", lead).join(errors, "lead")
    rows = rows.withColumn("p", F.lit(1.0) - normal_cdf((c("strike") - (c("fpeak") + c("bias"))) / c("sd")))
    return rows.withColumns({"edge_yes": c("p") - c("ask") - F.lit(FLAT), "edge_no": (F.lit(1.0) - c("p")) - (F.lit(1.0) - c("bid")) - F.lit(FLAT)})


def resolved(spark, sf):
    """Observations with the physical outcome and the venue's own: the side of its last quote."""
    c = F.col
    venue = ladder(spark, sf).groupBy("delivery_day", "strike").agg((F.max_by("mid", F.struct("cap", "qid")) > 0.5).alias("venue_yes"))
    a = actual_peaks(spark, sf).withColumnRenamed("day", "delivery_day")
    return observations(spark, sf).join(a, "delivery_day").join(venue, ["delivery_day", "strike"]).withColumn("physical_yes", c("actual") > c("strike"))


@query("j27_ladder_observations", f"""with {OBSERVED_SQL}
select delivery_day, strike, doc_id as forecast_id, known as known_us, star as captured_us, {s6('fpeak')} as forecast_peak, {s6('p')} as p_model, {s6('ask')} as yes_ask, {s6('1e0 - bid')} as no_ask,
 {s6('edge_yes')} as edge_yes, {s6('edge_no')} as edge_no, round(greatest(edge_yes, edge_no), 9) > 0 as is_candidate from ob""")
def j27o(spark, sf):
    """First qualifying ladder after the forecast was published and received: every strike, once per closed day."""
    c = F.col
    return six(observations(spark, sf).select(
        "delivery_day", "strike", c("doc_id").alias("forecast_id"), c("known").alias("known_us"), c("star").alias("captured_us"), c("fpeak").alias("forecast_peak"), c("p").alias("p_model"),
        c("ask").alias("yes_ask"), (F.lit(1.0) - c("bid")).alias("no_ask"), "edge_yes", "edge_no", (F.round(F.greatest("edge_yes", "edge_no"), 9) > 0).alias("is_candidate")))


@query("j28_resolution_audit", f"""with {OBSERVED_SQL}
select strike, count(*) as observations, count(distinct delivery_day) as days, count(*) filter (where physical_yes) as physical_yes, count(*) filter (where venue_yes) as venue_yes,
 count(*) filter (where physical_yes and not venue_yes) as venue_missed, count(*) filter (where venue_yes and not physical_yes) as venue_false, {s6('avg((physical_yes = venue_yes)::int)')} as agreement, {s6('avg(actual - fpeak)')} as mean_surprise from re group by 1""")
def j28r(spark, sf):
    """Resolution of every observation by the actual peak, and where the venue's settlement differs."""
    c = F.col
    return six(resolved(spark, sf).groupBy("strike").agg(
        F.count(F.lit(1)).alias("observations"), F.countDistinct("delivery_day").alias("days"), F.count_if("physical_yes").alias("physical_yes"), F.count_if("venue_yes").alias("venue_yes"),
        F.count_if(c("physical_yes") & ~c("venue_yes")).alias("venue_missed"), F.count_if(c("venue_yes") & ~c("physical_yes")).alias("venue_false"),
        F.avg((c("physical_yes") == c("venue_yes")).cast("int")).alias("agreement"), F.avg(c("actual") - c("fpeak")).alias("mean_surprise")))


def gated(n, value):
    return f"case when {n} >= {GATE} then {s6(value)} end"


SHEET_SQL = OBSERVED_SQL + f""", {FILLS},
cd as (select *, case when round(edge_yes, 9) > 0 then edge_yes else edge_no end as pred, case when round(edge_yes, 9) > 0 then p else 1e0 - p end as q, (case when round(edge_yes, 9) > 0 then physical_yes else not physical_yes end)::int as outcome,
   case when round(edge_yes, 9) > 0 then physical_yes::int - ask else (not physical_yes)::int - (1e0 - bid) end - {FLAT} as term from re where round(greatest(edge_yes, edge_no), 9) > 0),
ev as (select unnest([edge_yes, edge_no]) as e from ob), er as (select e, row_number() over (order by e) as r, count(*) over () as n from ev),
bn as (select least(floor(q * 10e0), 9) as bin, count(*) as n, sum(q - outcome) as s from cd group by 1),
dr as (select delivery_day >= (select median(delivery_day) from re) as late, p - physical_yes::int as err from re)"""


@query("a23_full_sheet", f"""with {SHEET_SQL}
select 'denominator' as block, unnest(['observations', 'candidates', 'resolved_candidates', 'operating_days', 'strikes']) as item, unnest([(select count(*) from ob), (select count(*) from ob where round(greatest(edge_yes, edge_no), 9) > 0), (select count(*) from cd), (select count(distinct delivery_day) from ob), (select count(distinct strike) from ob)]) as n, null::double as value
union all select 'calibration', unnest(['brier', 'log_loss', 'calibration_error']), (select count(*) from cd), unnest([(select {gated('count(*)', 'avg(pow(q - outcome, 2))')} from cd), (select {gated('count(*)', f"avg({ll('q')})")} from cd), (select {gated('sum(n)', 'sum(abs(s)) / sum(n)')} from bn)])
union all select 'reliability', 'bin' || bin::int, n, {gated('n', 's / n')} from bn
union all select 'edge', unnest(['min', 'median', 'max', 'positive']), (select count(*) from ev), unnest([(select {s6('min(e)')} from ev), (select {s6('max(e) filter (where r = n // 2 + 1)')} from er), (select {s6('max(e)')} from ev), (select {s6('count(*) filter (where round(e, 9) > 0)')} from ev)])
union all select 'realized', 'mean_terminal_edge', count(*), {gated('count(*)', 'avg(term)')} from cd
union all select 'capture', 'edge_capture_ratio', count(*), {gated('count(*)', 'sum(term) / sum(pred)')} from cd
union all select 'fillability', unnest(['yes', 'no']), unnest([count(*) filter (where round(edge_yes, 9) > 0), count(*) filter (where round(edge_no, 9) > 0)]), null from ob
union all select 'drift', case when late then 'late_error' else 'early_error' end, count(*), {gated('count(*)', 'avg(err)')} from dr group by late
union all select 'concentration', 'strike ' || (strike // 1)::bigint, count(*), {s6('count(*) / (select count(*) from ob)')} from ob group by strike
union all select 'settlement', case when pnl_per_share > 0 then 'win' when pnl_per_share < 0 then 'loss' else 'unsettled' end, count(*), {gated('count(*)', 'avg(pnl_per_share * shares)')} from fills group by 2
union all select 'confidence', unnest(['calibration_usable', 'capture_usable']), count(*), unnest([(count(*) >= {GATE})::int, (count(*) >= {GATE})::int]) from cd""")
def a23f(spark, sf):
    """Strategy sheet: denominators, calibration, edge, realized edge, capture, drift, concentration, settlement and what may be decided.

    Every block is one aggregation over observations or fills; means over fewer than thirty rows are null.
    """
    c = F.col
    rows, every = resolved(spark, sf), observations(spark, sf)
    yes = F.round("edge_yes", 9) > 0
    hit = F.when(yes, c("physical_yes")).otherwise(~c("physical_yes")).cast("int")
    cand = rows.where(F.round(F.greatest("edge_yes", "edge_no"), 9) > 0).select(
        F.when(yes, c("edge_yes")).otherwise(c("edge_no")).alias("pred"), F.when(yes, c("p")).otherwise(F.lit(1.0) - c("p")).alias("q"), hit.alias("outcome"),
        (hit - F.when(yes, c("ask")).otherwise(F.lit(1.0) - c("bid")) - F.lit(FLAT)).alias("term"))

    def gate(n, value):
        return F.when(n >= GATE, r6(value))

    def block(name, df, items):
        """One row per item from a one-row table: item -> (n, value)."""
        found = F.array(*[F.struct(F.lit(k).alias("item"), n.cast("long").alias("n"), v.cast("double").alias("value")) for k, (n, v) in items.items()])
        return df.select(F.inline(found)).select(F.lit(name).alias("block"), "item", "n", "value")

    none, one = F.lit(None), F.count(F.lit(1))
    bins = cand.groupBy(sc.unit_bin(c("q")).alias("bin")).agg(one.alias("n"), F.sum(c("q") - c("outcome")).alias("s"))
    facts = cand.agg(one.alias("k"), F.avg(sc.squared_error(c("q"), c("outcome"))).alias("brier"), F.avg(sc.log_loss_term(c("q"), c("outcome"))).alias("ll"),
                     F.avg("term").alias("term"), (F.sum("term") / F.nullif(F.sum("pred"), F.lit(0.0))).alias("capture"))
    facts = facts.withColumn("ece", bins.agg(F.sum(F.abs("s")) / F.sum("n")).scalar())
    counts = every.agg(one.alias("obs"), F.count_if(F.round(F.greatest("edge_yes", "edge_no"), 9) > 0).alias("cand"), F.countDistinct("delivery_day").alias("days"),
                       F.countDistinct("strike").alias("strikes"), F.count_if(yes).alias("yes"), F.count_if(F.round("edge_no", 9) > 0).alias("no"))
    counts = counts.withColumn("resolved", cand.agg(one).scalar())
    edges = every.select(F.explode(F.array("edge_yes", "edge_no")).alias("e"), F.lit(1).alias("g"))
    spread = edges.agg(one.alias("k"), F.min("e").alias("lo"), F.max("e").alias("hi"), F.count_if(F.round("e", 9) > 0).alias("up")).withColumn(
        "mid", nearest_rank(edges, ["g"], "e", {"m": lambda n: F.floor(n / 2) + 1}).select("m").scalar())
    middle = rows.agg(F.median("delivery_day")).scalar()
    drift = rows.select((c("delivery_day") >= middle).alias("late"), (c("p") - c("physical_yes").cast("int")).alias("err")).groupBy("late").agg(one.alias("n"), F.avg("err").alias("m"))
    state = F.when(c("pnl_per_share") > 0, "win").when(c("pnl_per_share") < 0, "loss").otherwise("unsettled")
    settled = tb.fills(spark, sf).groupBy(state.alias("item")).agg(one.alias("n"), F.avg(c("pnl_per_share") * c("shares")).alias("m"))
    usable = (c("k") >= GATE).cast("int")
    parts = [
        block("denominator", counts, {"observations": (c("obs"), none), "candidates": (c("cand"), none), "resolved_candidates": (c("resolved"), none), "operating_days": (c("days"), none), "strikes": (c("strikes"), none)}),
        block("calibration", facts, {"brier": (c("k"), gate(c("k"), c("brier"))), "log_loss": (c("k"), gate(c("k"), c("ll"))), "calibration_error": (c("k"), gate(c("k"), c("ece")))}),
        bins.select(F.lit("reliability").alias("block"), F.concat(F.lit("bin"), "bin").alias("item"), "n", gate(c("n"), c("s") / c("n")).alias("value")),
        block("edge", spread, {"min": (c("k"), r6("lo")), "median": (c("k"), r6("mid")), "max": (c("k"), r6("hi")), "positive": (c("k"), r6("up"))}),
        block("realized", facts, {"mean_terminal_edge": (c("k"), gate(c("k"), c("term")))}), block("capture", facts, {"edge_capture_ratio": (c("k"), gate(c("k"), c("capture")))}),
        block("fillability", counts, {"yes": (c("yes"), none), "no": (c("no"), none)}),
        drift.select(F.lit("drift").alias("block"), F.when(c("late"), "late_error").otherwise("early_error").alias("item"), "n", gate(c("n"), c("m")).alias("value")),
        every.groupBy("strike").agg(one.alias("n")).withColumn("t", counts.select("obs").scalar()).select(
            F.lit("concentration").alias("block"), F.concat(F.lit("strike "), c("strike").cast("long").cast("string")).alias("item"), "n", r6(c("n") / c("t")).alias("value")),
        settled.select(F.lit("settlement").alias("block"), "item", "n", gate(c("n"), c("m")).alias("value")),
        block("confidence", facts, {"calibration_usable": (c("k"), usable), "capture_usable": (c("k"), usable)})]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
