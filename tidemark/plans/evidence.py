"""Evidence queries: release contracts, manifest verification, evidence boundary, revision surprises."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.stats import normal_cdf, normal_cdf_sql
from tidemark.operators import asof, intervals
from tidemark.operators.ordered import running
from tidemark.plans.bindings import DOCS
from tidemark.plans.feeds import RAW
from tidemark.plans.pit import DAY, HOUR, UNION, VINT, W0, W1, actual_peaks, vintages
from tidemark.plans.registry import query, r6, s6
from tidemark.plans.scores import six
from tidemark.session import checkpointed
from tidemark.sources import rawlog
from tidemark.sources import tables as tb

TERM_WORDS = 3
TERM_SQL = f"""rel as (select item_id, 1704067200000000 + (item_id % 7) * 86400000000 as scheduled_us, list_filter(string_split(lower(text), ' '), lambda x: x <> '') as ws from benchmark),
tm as (select item_id, strftime(make_timestamp(scheduled_us), '%Y-%m-%d') as date, list_distinct(ws[i + 1:i + {TERM_WORDS}]) as term from rel, unnest(range(0, len(ws) - {TERM_WORDS - 1}, {TERM_WORDS})) r(i)),
ct as (select strftime(make_timestamp(published_us), '%Y-%m-%d') as date, 'c' || doc_id || '-' || strftime(make_timestamp(published_us), '%Y-%m-%d') as slug, list_distinct(string_split(lower(text), ' ')) as held from docs)"""


@query("s22_release_contracts", f"""with {DOCS}, {TERM_SQL}, mt as (
 select distinct item_id, slug from tm join ct on ct.date = tm.date and contains(slug, tm.date) and list_has_all(held, term))
select item_id, count(*) as contracts, min(slug) as first_slug from mt group by 1""")
def s22(spark, sf):
    """Contracts of a release: found under one of its search terms, with the release date in the slug."""
    c = F.col
    day = F.date_format(F.timestamp_micros(c("published_us")), "yyyy-MM-dd")
    docs = tb.documents(spark, sf).select(
        F.concat(F.lit("c"), "doc_id", F.lit("-"), day).alias("slug"), day.alias("date"), F.array_distinct(F.split(F.lower("text"), " ")).alias("held"))
    bench = tb.load(spark, sf, "benchmark").select(
        "item_id", F.date_format(F.timestamp_micros(F.lit(1_704_067_200_000_000) + (c("item_id") % 7) * DAY), "yyyy-MM-dd").alias("date"),
        F.filter(F.split(F.lower("text"), " "), lambda x: x != "").alias("ws"))
    starts = F.sequence(F.lit(0), F.size("ws") - TERM_WORDS, F.lit(TERM_WORDS))
    terms = bench.where(F.size("ws") >= TERM_WORDS).select("item_id", "date", F.explode(starts).alias("i"), "ws").select(
        "item_id", "date", F.array_distinct(F.slice("ws", c("i") + 1, F.lit(TERM_WORDS))).alias("term"))
    found = contained(terms.withColumn("term_id", F.concat_ws("|", "item_id", "term")), docs)
    return found.select("item_id", "slug").distinct().groupBy("item_id").agg(F.count(F.lit(1)).alias("contracts"), F.min("slug").alias("first_slug"))


def contained(terms, texts):
    """Terms (``item_id``, ``term_id``, ``date``, ``term``) whose words all stand in a text (``slug``, ``date``, ``held``) of the same date.

    Prefix filtering: a term is looked for by its rarest word only, so a frequent word is a join
    key only where all words of a term are frequent. The candidates' other words are then
    counted against the texts' words; no text is copied per candidate.
    """
    c = F.col
    # Only texts of an asked date can hold a term; the dates are those of the releases.
    dated = texts.join(terms.select("date").distinct(), "date", "left_semi")
    words = checkpointed(dated.select("slug", "date", F.explode("held").alias("word")))
    asked = terms.select("term_id", F.explode("term").alias("word")).distinct()
    seen = words.join(asked.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    rare = asked.join(seen, "word").groupBy("term_id").agg(F.min(F.struct("df", "word")).alias("rare"), F.count(F.lit(1)).alias("known"))
    keyed = terms.join(rare, "term_id").where(c("known") == F.size("term")).select("item_id", "term_id", "date", "term", c("rare.word").alias("word"))
    candidates = keyed.join(words, ["date", "word"]).select("item_id", "term_id", "slug", F.size("term").alias("need"), F.explode("term").alias("word"))
    return candidates.join(words.select("slug", "word"), ["slug", "word"], "left_semi").groupBy("item_id", "term_id", "slug", "need").agg(
        F.count(F.lit(1)).alias("n")).where("n = need")


HIT = "cast('0x' || substr(md5({x}), 1, 8) as bigint)"


@query("s09_manifest_verification", f"""with {RAW}, h as (select day, seq, source, {HIT.format(x='wire')} % 97 = 0 as changed from raw),
d as (select day, count(*) as n, count(*) filter (where changed) as changed_records, min(seq) filter (where changed) as first_changed, max(seq) filter (where changed) as last_changed from h group by 1),
k as (select *, lag(day) over (order by day) as before from d)
select day, n, changed_records, first_changed, last_changed, before is null or day % 7 <> 3 as chain_ok,
 case when before is not null and day % 7 = 3 then 'chain broken' when changed_records > 0 then 'root mismatch' else 'ok' end as status from k""")
def s09v(spark, sf):
    """Verification of the day manifests after some records and some links were altered."""
    sealed = rawlog.envelopes(spark, sf)
    manifests = rawlog.manifest(sealed)
    first = manifests.agg(F.min("day")).scalar()
    broken = (F.col("day") % 7 == 3) & (F.col("day") > first)
    stored = manifests.withColumn("previous", F.when(broken, F.sha2(F.lit("x"), 256)).otherwise(F.col("previous")))
    return rawlog.verify(sealed, stored, rawlog.tampered(sealed, "wire"))


COVERED, COMPLETE = 0.97, 0.9
D0, D1 = W0 // DAY, W1 // DAY - 1
SETTLE_DAYS = 5
BOUNDARY_SQL = UNION + f""", q as (select 'm' || user_id as market_slug, ts_us from ev where event_type in ('view', 'click')),
tr as (select 'm' || user_id as market_slug, ts_us, ts_us // {DAY} as day from ev where event_type in ('purchase', 'signup') and ts_us >= {W0} and ts_us < {W1}),
st as (select t.market_slug, t.day, count(*) as n, count(q.ts_us) filter (where q.ts_us - t.ts_us <= {SETTLE_DAYS * DAY}) as settled from tr t asof left join q on q.market_slug = t.market_slug and t.ts_us <= q.ts_us group by 1, 2),
gp as (select market_slug, unnest(range(greatest(start_us, {W0}) // {DAY}, (least(end_us, {W1}) - 1) // {DAY} + 1)) as day, start_us, end_us from uni where end_us > {W0} and start_us < {W1}),
un as (select market_slug, day, sum(least(end_us, (day + 1) * {DAY}) - greatest(start_us, day * {DAY})) as gone from gp group by 1, 2),
mk as (select distinct 'm' || user_id as market_slug from ev),
gr as (select market_slug, unnest(range({D0}, {D1 + 1})) as day from mk),
dd as (select market_slug, day, coalesce(gone, 0) as gone, coalesce(n, 0) as n, coalesce(settled, 0) as settled, {DAY} as span from gr left join un using (market_slug, day) left join st using (market_slug, day)),
al as (select * from dd union all select 'all', day, sum(gone), sum(n), sum(settled), sum(span) from dd group by day),
sf as (select market_slug, day, sum(gone) over w as gone, sum(n) over w as n, sum(settled) over w as settled, sum(span) over w as span from al window w as (partition by market_slug order by day desc)),
ok as (select *, 1 - gone / span as coverage, case when n > 0 then settled / n else 1 end as completeness from sf),
rm as (select *, min((round(coverage, 9) >= {COVERED} and round(completeness, 9) >= {COMPLETE})::int) over (partition by market_slug order by day desc) as held from ok)"""


@query("a53_evidence_boundary", f"""with {BOUNDARY_SQL}
select market_slug, cast(max(n) as bigint) as trades, cast(max(settled) as bigint) as settled, {s6(f'max(coverage) filter (where day = {D0})')} as coverage, {s6(f'max(completeness) filter (where day = {D0})')} as completeness,
 min(day) filter (where held = 1) as boundary_day, coalesce({D1 + 1} - min(day) filter (where held = 1), 0) as days, min(held) = 1 as whole_window from rm group by 1""")
def a53b(spark, sf):
    """Earliest day from which coverage and settlement completeness hold to the end, per market and overall.

    Both are measured from a day to the end of the window by sums from the right; a day counts
    if the limits hold there and at every later start, a running minimum from the right.
    """
    c = F.col
    gaps = intervals.union_intervals(tb.gaps(spark, sf), ["market_slug"], "start_us", "end_us").where((c("end_us") > W0) & (c("start_us") < W1))
    day = F.explode(F.sequence(F.floor(F.greatest(c("start_us"), F.lit(W0)) / DAY).cast("long"), F.floor((F.least(c("end_us"), F.lit(W1)) - 1) / DAY).cast("long")))
    unobserved = gaps.withColumn("day", day).groupBy("market_slug", "day").agg(
        F.sum(F.least(c("end_us"), (c("day") + 1) * DAY) - F.greatest(c("start_us"), c("day") * DAY)).alias("gone"))
    trades = tb.trades(spark, sf, W0, W1 - 1)
    quotes = tb.quotes(spark, sf).select("market_slug", "event_id", c("ts_us").alias("q_us"))
    met = asof.asof_join(trades, quotes, ["market_slug"], "ts_us", "q_us", ["q_us"], "next", forward=True, tie=c("event_id"))
    settled = met.groupBy("market_slug", F.floor(c("ts_us") / DAY).cast("long").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("next.q_us") - c("ts_us") <= SETTLE_DAYS * DAY).alias("settled"))
    markets = tb.event_rows(spark, sf).select(F.concat(F.lit("m"), "user_id").alias("market_slug")).distinct()
    grid = markets.withColumn("day", F.explode(F.sequence(F.lit(D0).cast("long"), F.lit(D1).cast("long"))))
    days = grid.join(unobserved, ["market_slug", "day"], "left").join(settled, ["market_slug", "day"], "left").na.fill(0, ["gone", "n", "settled"]).withColumn("span", F.lit(DAY))
    sums = ["gone", "n", "settled", "span"]
    overall = days.groupBy("day").agg(*[F.sum(s).alias(s) for s in sums]).select(F.lit("all").alias("market_slug"), "day", *sums)
    # A market has one row per day of the window, so a window per market is small.
    back = Window.partitionBy("market_slug").orderBy(F.desc("day"))
    suffix = days.select("market_slug", "day", *sums).unionByName(overall).withColumns({s: F.sum(s).over(back) for s in sums})
    suffix = suffix.withColumns({"coverage": F.lit(1.0) - c("gone") / c("span"), "completeness": F.when(c("n") > 0, c("settled") / F.nullif(c("n"), F.lit(0))).otherwise(1.0)})
    good = (F.round("coverage", 9) >= COVERED) & (F.round("completeness", 9) >= COMPLETE)
    held = suffix.withColumn("held", F.min(good.cast("int")).over(back))
    start = F.min(F.when(c("held") == 1, c("day")))
    return six(held.groupBy("market_slug").agg(
        F.max("n").alias("trades"), F.max("settled").alias("settled"), F.max(F.when(c("day") == D0, c("coverage"))).alias("coverage"),
        F.max(F.when(c("day") == D0, c("completeness"))).alias("completeness"), start.alias("boundary_day"),
        F.coalesce(F.lit(D1 + 1) - start, F.lit(0)).alias("days"), (F.min("held") == 1).alias("whole_window")))


SURPRISE, MOVE, REPRICE, FLAT = 100_000, 0.01, 0.02, 0.07
SURPRISE_SQL = VINT + f""", rv as (select doc_id, publish_day, delivery_day, peak, lag(peak) over (partition by delivery_day order by publish_day, doc_id) as pp from vint),
sp as (select *, case when peak > pp then 1 else -1 end as dir, publish_day * {DAY} as pub, publish_day * {DAY} + (doc_id % 24) * {HOUR} as rcv from rv where abs(peak - pp) >= {SURPRISE}),
lq as (select epoch_us(l_shipdate) as cap, epoch_us(l_shipdate) // {DAY} + l_linenumber % 7 as delivery_day, 80000e0 * (1 + l_suppkey % 5) as strike, (l_quantity - 5e-1) / 50e0 as mid,
  (l_quantity - 5e-1) / 50e0 + 1e-2 + l_discount / 2e0 as ask, 51e0 - l_quantity as size, l_orderkey || '|' || l_linenumber as qid from lineitem),
rs as (select delivery_day - publish_day as lead, avg(actual - peak) as bias, stddev_samp(actual - peak) as sd from vint join act on delivery_day = day where delivery_day - publish_day between 0 and 6 group by 1),
rg as (select distinct delivery_day, strike from lq),
am as (select doc_id, arg_min(strike, (abs(strike - peak), strike)) as strike from sp join rg using (delivery_day) group by 1),
ev_ as (select sp.*, am.strike, bias, sd from sp join am using (doc_id) left join rs on lead = delivery_day - publish_day),
bs as (select doc_id, arg_max(mid, (cap, qid)) as base from ev_ e join lq q on q.delivery_day = e.delivery_day and q.strike = e.strike and cap < pub group by 1),
mv as (select e.doc_id, min(cap) filter (where round((mid - base) * dir, 9) >= {MOVE}) as t1, min(cap) filter (where round((mid - base) * dir, 9) >= {REPRICE}) as t2
 from ev_ e join bs using (doc_id) join lq q on q.delivery_day = e.delivery_day and q.strike = e.strike and cap >= pub group by 1),
ac as (select e.doc_id, arg_min(ask, (cap, qid)) as ask, arg_min(size, (cap, qid)) as size from ev_ e join lq q on q.delivery_day = e.delivery_day and q.strike = e.strike and cap >= rcv group by 1)"""


def fair_sql(peak):
    return f"(1e0 - {normal_cdf_sql(f'((strike - ({peak} + bias)) / sd)')})"


@query("j26_surprise_reactions", f"""with {SURPRISE_SQL}
select e.doc_id, e.delivery_day, {s6('peak - pp')} as delta_peak, strike, {s6(fair_sql('pp'))} as p_old, {s6(fair_sql('peak'))} as p_new, (rcv - pub) // 1000000 as ingest_s,
 (t1 - pub) // 1000000 as reaction_s, (t2 - pub) // 1000000 as repricing_s, case when size > 0 then {s6(f"{fair_sql('peak')} - ask - {FLAT}")} end as edge
from ev_ e left join mv using (doc_id) left join ac using (doc_id)""")
def j26r(spark, sf):
    """Every revision surprise with its at-the-money rung, first move, repricing and edge at the first quote after receipt.

    The rung is the nearest strike, by the same nearest join that finds nearest times. Quotes are
    first reduced to one row per rung and capture time. What is asked of them depends on rung,
    direction and day of publication (or time of receipt) only, so each such question is answered
    once, however many revisions ask it. Moves are looked for in the days' extremes of the rung
    first; only the day of the crossing is opened.
    """
    c = F.col
    prev = running(vintages(spark, sf), ["delivery_day"], "publish_day", ["doc_id"], {"pp": ("lag", c("peak"))})
    events = prev.where(F.abs(c("peak") - c("pp")) >= SURPRISE).withColumns({
        "dir": F.when(c("peak") > c("pp"), 1).otherwise(-1), "pub": c("publish_day") * DAY, "rcv": c("publish_day") * DAY + (c("doc_id") % 24) * HOUR})
    price = (c("l_quantity") - F.lit(0.5)) / F.lit(50.0)
    captured = tb.micros("l_shipdate")
    ladder = tb.load(spark, sf, "lineitem").select(
        captured.alias("cap"), (F.floor(captured / DAY) + c("l_linenumber") % 7).cast("long").alias("delivery_day"),
        (F.lit(80000.0) * (F.lit(1) + c("l_suppkey") % 5)).alias("strike"), price.alias("mid"), (price + F.lit(0.01) + c("l_discount") / F.lit(2.0)).alias("ask"),
        (F.lit(51.0) - c("l_quantity")).alias("size"), F.concat_ws("|", "l_orderkey", "l_linenumber").alias("qid"))
    key = ["delivery_day", "strike"]
    # The last quote of a time for who looks back, the first for who looks ahead.
    points = checkpointed(ladder.groupBy(*key, "cap").agg(
        F.max("mid").alias("hi"), F.min("mid").alias("lo"), F.max_by("mid", "qid").alias("mid"), F.min_by(F.struct("ask", "size"), "qid").alias("offer")))
    rungs = points.select(*key).distinct().withColumn("rung", c("strike"))
    money = checkpointed(asof.nearest_join(events, rungs, ["delivery_day"], "peak", "rung", ["strike"], F.lit(1e18), "atm", tie=c("strike")).where("atm is not null").withColumn(
        "strike", c("atm.strike")).drop("atm"))
    quoted = points.withColumn("q_us", c("cap"))
    based = asof.asof_join(money.select(*key, "pub").distinct(), quoted, key, "pub", "q_us", ["mid"], "base", strict=True, tie=c("cap"))
    acted = asof.asof_join(money.select(*key, "rcv").distinct(), quoted, key, "rcv", "q_us", ["offer"], "act", forward=True, tie=c("cap"))
    base = checkpointed(based.select(*key, "pub", c("base.mid").alias("base")))
    asked = money.select(*key, "pub", "dir").distinct().join(base, [*key, "pub"]).where("base is not null")
    cap_day = F.floor(c("cap") / DAY).cast("long")
    extremes = points.groupBy(*key, cap_day.alias("cap_day")).agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    gain = F.round((F.when(c("dir") == 1, c("hi")).otherwise(c("lo")) - c("base")) * c("dir"), 9)
    kinds = [("t1", MOVE), ("t2", REPRICE)]
    crossed = asked.join(extremes, key).where(c("cap_day") >= F.floor(c("pub") / DAY)).groupBy(*key, "pub", "dir", "base").agg(
        *[F.min(F.when(gain >= limit, c("cap_day"))).alias(k) for k, limit in kinds])
    days = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(limit).alias("limit"), c(k).alias("cap_day")) for k, limit in kinds])
    opened = crossed.select(*key, "pub", "dir", "base", F.inline(days)).join(points.withColumn("cap_day", cap_day), [*key, "cap_day"]).where(gain >= c("limit"))
    moved = opened.groupBy(*key, "pub", "dir").agg(*[F.min(F.when(c("kind") == k, c("cap"))).alias(k) for k, _ in kinds])
    lead = c("delivery_day") - c("publish_day")
    v, a = vintages(spark, sf), actual_peaks(spark, sf)
    errors = v.join(a, v["delivery_day"] == a["day"]).where(lead.between(0, 6)).groupBy(lead.alias("lead")).agg(
        F.avg(c("actual") - c("peak")).alias("bias"), F.stddev_samp(c("actual") - c("peak")).alias("sd"))

    def fair(peak):
        return F.lit(1.0) - normal_cdf((c("strike") - (c(peak) + c("bias"))) / c("sd"))

    out = money.join(moved, [*key, "pub", "dir"], "left").join(acted.select(*key, "rcv", c("act.offer").alias("act")), [*key, "rcv"], "left").withColumn(
        "lead", lead).join(errors, "lead", "left")
    second = F.lit(1_000_000)
    return out.select(
        "doc_id", "delivery_day", r6(c("peak") - c("pp")).alias("delta_peak"), "strike", r6(fair("pp")).alias("p_old"), r6(fair("peak")).alias("p_new"),
        F.floor((c("rcv") - c("pub")) / second).alias("ingest_s"), F.floor((c("t1") - c("pub")) / second).alias("reaction_s"), F.floor((c("t2") - c("pub")) / second).alias("repricing_s"),
        F.when(c("act.size") > 0, r6(fair("peak") - c("act.ask") - F.lit(FLAT))).alias("edge"))
