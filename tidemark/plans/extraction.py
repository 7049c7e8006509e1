"""Extraction queries: provider features, extraction reports, metadata chains, stratified universes and liquidity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import book as bk
from tidemark.operators.ordered import nearest_rank, running
from tidemark.operators.sequences import in_order
from tidemark.plans.bindings import EV, LEVELS, TRADES
from tidemark.plans.feeds import book_wires
from tidemark.plans.market import BOOK
from tidemark.plans.pit import DAY, HOUR
from tidemark.plans.registry import query, r6, s6
from tidemark.plans.scores import six
from tidemark.sources import providers, wire
from tidemark.sources import tables as tb
from tidemark.sources.providers import Provider

PROVIDERS = {p.name: p for p in (
    Provider("clicks", "push", 5 * 60_000_000, "k bigint", lambda p: {"k": p["k"], "busy": (p["k"] > 50).cast("int")}),
    Provider("news", "poll", DAY, "lang string, source string, chars bigint", lambda p: {
        "length": p["chars"], "english": (p["lang"] == "en").cast("int"), "named_source": p["source"].isNotNull().cast("int")}),
    Provider("chat", "push", HOUR, "role string, turn int, text string", lambda p: {
        "turn": p["turn"], "asks": F.when(p["role"] == "user", p["text"].contains("?").cast("int"))}),
)}
PAYLOAD_SQL = EV + """, f as (
 select 'clicks' as provider, 'push' as source_class, 'u' || user_id as entity, ts_us as o, 300000000 as life, unnest(['k', 'busy']) as feature, unnest([k::double, (k > 50)::int::double]) as value from ev
 union all select 'news', 'poll', 'd' || doc_id, 1704067200000000 + doc_id * 600000000, 86400000000, unnest(['length', 'english', 'named_source']), unnest([n_chars::double, (lang = 'en')::int::double, (source is not null)::int::double]) from documents
 union all select 'chat', 'push', 'c' || conv_id, 1704067200000000 + turn * 1000000, 3600000000, unnest(['turn', 'asks']), unnest([turn::double, case when role = 'user' then contains(text, '?')::int::double end]) from conversations)"""


def payloads(spark, sf):
    """Raw JSON payloads of three providers, each of its own shape."""
    c = F.col
    events = tb.event_rows(spark, sf).select(F.lit("clicks").alias("provider"), F.concat(F.lit("u"), "user_id").alias("entity"), c("ts_us").alias("observed_us"), F.to_json(F.struct("k")).alias("payload"))
    news = tb.load(spark, sf, "documents").select(
        F.lit("news").alias("provider"), F.concat(F.lit("d"), "doc_id").alias("entity"), (F.lit(1_704_067_200_000_000) + c("doc_id") * 600_000_000).alias("observed_us"),
        F.to_json(F.struct("lang", "source", c("n_chars").alias("chars"))).alias("payload"))
    chat = tb.load(spark, sf, "conversations").select(
        F.lit("chat").alias("provider"), F.concat(F.lit("c"), "conv_id").alias("entity"), (F.lit(1_704_067_200_000_000) + c("turn") * 1_000_000).alias("observed_us"),
        F.to_json(F.struct("role", "turn", "text")).alias("payload"))
    return events.unionByName(news).unionByName(chat)


@query("x06_provider_features", f"""with {PAYLOAD_SQL}
select provider, source_class, feature, count(*) as n, count(distinct entity) as entities, {s6('sum(value)')} as total, min(o) as first_us, max(o + life) as expires_us from f where value is not null group by 1, 2, 3""")
def x06p(spark, sf):
    """Features of three providers with three payload schemas through the extractor registry."""
    found = providers.extracted(payloads(spark, sf), PROVIDERS)
    return six(found.groupBy("provider", "source_class", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), F.sum("value").alias("total"), F.min("observed_us").alias("first_us"), F.max("expires_us").alias("expires_us")))


UPDATE_SQL = """sn as (select l_partkey as pk, epoch_us(l_shipdate) as ts_us, l_orderkey || '|' || l_linenumber || '|' || l_suppkey as rid, cast(round(l_tax * 100) as bigint) as fee from lineitem),
lg as (select *, lag(fee) over (partition by pk order by ts_us, rid) as old from sn),
up as (select pk, row_number() over (partition by pk order by ts_us, rid) || '|m' || pk || '|fee|' || coalesce(old::varchar, '-') || '|' || fee || '|' || ts_us as line, ts_us, rid from lg where old is null or fee <> old),
ls as (select pk, list(line order by ts_us, rid) as ls from up group by 1)"""


@query("s38_metadata_chain", f"""with {UPDATE_SQL}
select 'm' || pk as symbol, len(ls)::bigint as updates, list_reduce(list_prepend(sha256(''), ls), lambda a, x: sha256(a || '|' || x)) as root from ls""")
def s38c(spark, sf):
    """Append-only chain of every instrument's fee changes: each update is hashed with the root before it.

    A chain is sequential by nature; its rows stream past one hash of state, in order, so a long
    chain needs no memory and no group is collected.
    """
    c = F.col
    rows = tb.load(spark, sf, "lineitem").select(
        F.concat(F.lit("m"), "l_partkey").alias("symbol"), tb.micros("l_shipdate").alias("ts_us"), F.concat_ws("|", "l_orderkey", "l_linenumber", "l_suppkey").alias("rid"),
        F.round(c("l_tax") * 100).cast("long").alias("fee"))
    seen = running(rows, ["symbol"], "ts_us", ["rid"], {"old": ("lag", c("fee"))})
    changed = seen.where("old is null or fee <> old")
    numbered = running(changed, ["symbol"], "ts_us", ["rid"], {"sequence": ("count", None)})
    lines = numbered.select("symbol", "ts_us", "rid", F.concat_ws("|", "sequence", "symbol", F.lit("fee"), F.coalesce(c("old").cast("string"), F.lit("-")), "fee", "ts_us").alias("line"))
    return chained(lines)


def chained(lines):
    """``symbol``, ``updates`` and ``root`` of every symbol's hash chain over ``line`` in order of (ts_us, rid)."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, n, root = None, 0, ""
        for batch in batches:
            done = []
            for name, line in zip(batch["symbol"].tolist(), batch["line"].tolist()):
                if name != symbol:
                    if symbol is not None:
                        done.append((symbol, n, root))
                    symbol, n, root = name, 0, hashlib.sha256(b"").hexdigest()
                n, root = n + 1, hashlib.sha256(f"{root}|{line}".encode()).hexdigest()
            yield pd.DataFrame(done, columns=["symbol", "updates", "root"])
        if symbol is not None:
            yield pd.DataFrame([(symbol, n, root)], columns=["symbol", "updates", "root"])

    return in_order(lines, ["symbol"], ["ts_us", "rid"]).select("symbol", "line").mapInPandas(fold, "symbol string, updates long, root string")


REPORT_SQL = BOOK + f""", tk as (select event_id, case when k % 10 = 0 then 0 else k end as size, k from ev where event_type in ('purchase', 'signup')),
bw as (select event_id, market_slug, nb > 0 and na > 0 as two, cast('0x' || substr(md5(event_id::varchar), 1, 8) as bigint) % 97 = 0 as broken, case when event_id % 13 = 0 then 2 else 1 end as copies, bb, ba, bd, ad from bb),
m as (select 'books' as feed, unnest(['seen', 'duplicates', 'hash_mismatches', 'rejected:one_sided', 'accepted', 'markets', 'spread_p50_bp', 'depth_p50']) as metric, unnest([
  (select sum(copies) from bw), (select sum(copies - 1) from bw), (select count(*) filter (where broken) from bw), (select count(*) filter (where not two and not broken) from bw),
  (select count(*) filter (where two and not broken) from bw), (select count(distinct market_slug) from bw where two and not broken),
  (select max(v) from (select round((ba - bb) * 10000) as v, row_number() over (order by round((ba - bb) * 10000)) as r, count(*) over () as n from bw where two and not broken) where r = n // 2 + 1),
  (select max(v) from (select bd + ad as v, row_number() over (order by bd + ad) as r, count(*) over () as n from bw where two and not broken) where r = n // 2 + 1)]) as value
 union all select 'trades', unnest(['seen', 'duplicates', 'hash_mismatches', 'rejected:no_size', 'accepted']), unnest([(select count(*) from tk), 0, (select count(*) filter (where cast('0x' || substr(md5(event_id::varchar), 1, 8) as bigint) % 97 = 0) from tk),
  (select count(*) filter (where size = 0 and cast('0x' || substr(md5(event_id::varchar), 1, 8) as bigint) % 97 <> 0) from tk), (select count(*) filter (where size > 0 and cast('0x' || substr(md5(event_id::varchar), 1, 8) as bigint) % 97 <> 0) from tk)]))"""


@query("s39_integrity_report", f"with {REPORT_SQL} select feed, metric, cast(value as bigint) as value from m where value > 0 or metric not like 'rejected%'")
def s39r(spark, sf):
    """Books and trades of a feed: seen, repeated, altered, rejected by kind, accepted, and the accepted books' spread and depth.

    A repeated record has the same id and the same content; two records that only say the same both count.
    """
    c = F.col
    altered = F.conv(F.substring(F.md5(c("event_id").cast("string")), 1, 8), 16, 10).cast("long") % 97 == 0

    def sealed(df):
        return df.withColumn("sha256", F.sha2(F.when(altered, F.concat("wire", F.lit("!"))).otherwise(c("wire")), 256))

    books = sealed(book_wires(spark, sf))
    books = books.unionByName(books.where("event_id % 13 = 0"))
    size = F.when(c("size") % 10 == 0, 0).otherwise(c("size"))
    trades = sealed(tb.trades(spark, sf).select("event_id", F.to_json(F.struct("market_slug", "price", size.alias("size"))).alias("wire")))
    record = ["event_id", "sha256"]
    once = wire.parse_books(books.dropDuplicates(record), "wire").withColumn("intact", F.sha2("wire", 256) == c("sha256"))
    done = trades.dropDuplicates(record).withColumn("intact", F.sha2("wire", 256) == c("sha256")).withColumn(
        "rejects", F.when(F.get_json_object("wire", "$.size").cast("long") <= 0, F.array(F.lit("no_size"))).otherwise(F.array().cast("array<string>")))

    def report(feed, raw, parsed):
        kinds = parsed.where("intact").select(F.explode("rejects").alias("kind")).groupBy(F.concat(F.lit("rejected:"), "kind").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
        sound = parsed.agg(F.count_if(~c("intact")).alias("hash_mismatches"), F.count_if(c("intact") & (F.size("rejects") == 0)).alias("accepted")).unpivot(
            [], ["hash_mismatches", "accepted"], "metric", "value")
        seen = raw.agg(F.count(F.lit(1)).alias("seen"), (F.count(F.lit(1)) - F.countDistinct(F.struct(*record))).alias("duplicates")).unpivot([], ["seen", "duplicates"], "metric", "value")
        return kinds.unionByName(sound).unionByName(seen).select(F.lit(feed).alias("feed"), "metric", "value")

    kept = once.where(c("intact") & (F.size("rejects") == 0)).select("market_slug", F.round((bk.best(c("asks")) - bk.best(c("bids"))) * 10000).alias("spread"),
                                                                    (bk.depth(c("bids"), 5) + bk.depth(c("asks"), 5)).alias("depth"), F.lit(1).alias("g"))
    medians = [nearest_rank(kept, ["g"], v, {"value": lambda n: F.floor(n / 2) + 1}).select(F.lit("books").alias("feed"), F.lit(f"{v}_p50{'_bp' if v == 'spread' else ''}").alias("metric"), c("value").cast("long").alias("value"))
               for v in ("spread", "depth")]
    markets = kept.agg(F.countDistinct("market_slug").alias("value")).select(F.lit("books").alias("feed"), F.lit("markets").alias("metric"), "value")
    return report("books", books, once).unionByName(report("trades", trades, done)).unionByName(markets).unionByName(medians[0]).unionByName(medians[1])


SEGMENTS = "sg as (select 'm' || c_custkey as market_slug, c_mktsegment as stratum, c_acctbal > 0 as sound from customer)"


def segments(spark, sf):
    """Market, its stratum (the segment of the customer whose number it bears) and whether it passes the quality gate."""
    return tb.load(spark, sf, "customer").select(F.concat(F.lit("m"), "c_custkey").alias("market_slug"), F.col("c_mktsegment").alias("stratum"), (F.col("c_acctbal") > 0).alias("sound"))


TOP = 10


@query("k05_stratified_universe", f"""with {TRADES}, {SEGMENTS}, v as (select market_slug, cast(sum(size) as bigint) as volume, count(*) as trades from trades group by 1),
r as (select stratum, market_slug, volume, trades, row_number() over (partition by stratum order by volume desc, market_slug) as rn from v join sg using (market_slug) where sound and trades >= 3)
select stratum, market_slug, volume, trades, rn from r where rn <= {TOP}""")
def k05u(spark, sf):
    """The largest markets by volume of every segment, among those that pass the quality gate.

    The rank limit is applied below the shuffle, so a segment never gathers in one task.
    """
    volume = tb.trades(spark, sf).groupBy("market_slug").agg(F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"))
    rows = volume.join(segments(spark, sf), "market_slug").where("sound and trades >= 3")
    best = Window.partitionBy("stratum").orderBy(F.desc("volume"), "market_slug")
    return rows.withColumn("rn", F.row_number().over(best).cast("long")).where(F.col("rn") <= TOP).select("stratum", "market_slug", "volume", "trades", "rn")


@query("a63_liquidity_by_segment", f"""with {LEVELS}, {SEGMENTS}, w0 as (select *, coalesce(sum(size) over (partition by event_id order by i rows between unbounded preceding and 1 preceding), 0) bf from lv where side = 'ask'),
v as (select event_id, any_value(market_slug) as market_slug, round(sum(greatest(0, least(size, 50e0 - bf)) * price) / sum(greatest(0, least(size, 50e0 - bf))), 9) as vwap, sum(size) as depth, round(any_value(mid) * 1000000) as m from w0 group by 1),
x as (select v.*, q.spread from v join quotes q using (event_id)),
r as (select stratum, vwap, depth, spread, row_number() over (partition by stratum order by vwap) rv, row_number() over (partition by stratum order by depth) rd, row_number() over (partition by stratum order by round(spread, 9)) rs, count(*) over (partition by stratum) n from x join sg using (market_slug))
select stratum, max(n) as n, {s6('max(vwap) filter (where rv = n // 2 + 1)')} as median_vwap, {s6('max(depth) filter (where rd = n // 2 + 1)')} as median_depth, {s6('avg(depth)')} as mean_depth, {s6('max(spread) filter (where rs = n // 2 + 1)')} as median_spread from r group by 1""")
def a63s(spark, sf):
    """Depth, price to buy fifty and spread of every segment's books, medians by counted values."""
    c = F.col
    spread = tb.quotes(spark, sf).select("event_id", F.round("spread", 9).alias("spread"))
    rows = tb.books(spark, sf).where(F.size("asks") > 0).select(
        "event_id", "market_slug", F.round(bk.walk(c("asks"), F.lit(50.0), F.lit(0.0))["vwap"], 9).alias("vwap"), bk.depth(c("asks"), 5).alias("depth")).join(spread, "event_id").join(
        segments(spark, sf), "market_slug")
    measures = ["vwap", "depth", "spread"]
    tall = rows.select("stratum", F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), c(m).alias("v")) for m in measures])).alias("x")).select("stratum", "x.*")
    median = nearest_rank(tall, ["stratum", "measure"], "v", {"median": lambda n: F.floor(n / 2) + 1})
    wide = median.groupBy("stratum").agg(F.max("n").alias("n"), *[F.max(F.when(c("measure") == m, c("median"))).alias(f"median_{m}") for m in measures])
    return six(wide.join(rows.groupBy("stratum").agg(F.avg("depth").alias("mean_depth")), "stratum").select("stratum", "n", "median_vwap", "median_depth", "mean_depth", "median_spread"))
