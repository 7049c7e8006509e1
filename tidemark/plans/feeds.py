"""Source, integrity, external-fact, identifier and universe queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import content_id
from tidemark.operators.ordered import nearest_rank, running
from tidemark.plans.bindings import DOCS, EV, FC, LEVELS, QT, QUOTES, SNAP, TRADES
from tidemark.plans.market import BOOK
from tidemark.plans.pit import AS_OF, DAY, HOUR
from tidemark.plans.registry import query, r6, s6
from tidemark.plans.scores import SPLIT_US, six
from tidemark.sources import rawlog, wire
from tidemark.sources import tables as tb

RAW = EV + """, raw as (select event_id as seq, event_id || '|' || user_id || '|' || event_type || '|' || k as wire, event_type as source, ts_us // 1000 as exchange_ms,
 (ts_us + k * 1000) * 1000 as received_ns, ts_us // 86400000000 as day, k from ev)"""


@query("s05_raw_envelopes", f"""with {RAW} select seq, wire, source, exchange_ms, received_ns, day, sha256(wire) as sha256, k from raw""")
def s05(spark, sf):
    return rawlog.envelopes(spark, sf)


@query("s06_raw_replay_order", f"""with {RAW} select seq, day, source, row_number() over (partition by day, source order by received_ns, seq) as position from raw""")
def s06(spark, sf):
    return rawlog.replay_order(rawlog.envelopes(spark, sf)).select("seq", "day", "source", "position")


@query("s07_raw_integrity", f"""with {RAW} select day, count(*) as n, count(*) filter (where cast('0x' || substr(md5(wire), 1, 8) as bigint) % 97 = 0) as mismatches from raw group by 1""")
def s07(spark, sf):
    """Sealed records of which some were altered afterwards: the scan must count exactly those."""
    return rawlog.integrity(rawlog.tampered(rawlog.envelopes(spark, sf), "wire"))


TREE = RAW + """, p as (select day, sha256(wire) as d, row_number() over (partition by day order by received_ns, seq) - 1 as p from raw),
l1 as (select day, p // 1000 as p, sha256(string_agg(d, '' order by p)) as d from p group by day, p // 1000),
l2 as (select day, p // 1000 as p, sha256(string_agg(d, '' order by p)) as d from l1 group by day, p // 1000),
roots as (select day, sha256(string_agg(d, '' order by p)) as root from l2 group by day)"""


@query("s08_day_root_hash", f"with {TREE} select day, root from roots")
def s08(spark, sf):
    env = rawlog.envelopes(spark, sf)
    placed = running(env, ["day"], "received_ns", ["seq"], {"position": ("count", None)})
    return rawlog.tree_root(placed, ["day"], "position", "sha256")


@query("s09_daily_manifest", f"""with {TREE}, c as (select day, count(*) as n, count(distinct source) as sources from raw group by 1),
j as (select c.*, root, lag(root) over (order by day) as previous from c join roots using (day))
select *, sha256(day || '|' || n || '|' || sources || '|' || root || '|' || coalesce(previous, 'genesis')) as manifest_sha256 from j""")
def s09(spark, sf):
    return rawlog.manifest(rawlog.envelopes(spark, sf))


@query("s10_dual_replay", f"""with {RAW} select count(*) as n, cast(sum(cast('0x' || substr(md5(row_number || '|' || wire), 1, 8) as bigint)) as bigint) as checksum, true as deterministic
from (select wire, row_number() over (partition by day, source order by received_ns, seq) as row_number from raw)""")
def s10(spark, sf):
    env = rawlog.envelopes(spark, sf)
    again = rawlog.fingerprint(env.unionByName(env).orderBy(F.desc("seq")))  # repeats, met in another order
    first = rawlog.fingerprint(env)
    same = first.select(F.struct("n", "checksum").alias("a")).scalar()
    return again.withColumn("deterministic", F.struct("n", "checksum") == same)


@query("s11_market_source", """select p_type as category, count(*) as accepted, cast(sum(case when p_size > 25 then 1 else 0 end) as bigint) as active,
 round(sum(p_retailprice), 4) as volume from part where p_size % 10 <> 0 group by 1""")
def s11(spark, sf):
    c = F.col
    bad = c("p_size") % 10 == 0
    raw = tb.load(spark, sf, "part").select(F.to_json(F.struct(
        F.concat(F.lit("m"), c("p_partkey")).alias("id"),
        F.when(bad, F.array(F.lit("Yes"))).otherwise(F.array(F.lit("Yes"), F.lit("No"))).alias("outcomes"),
        (c("p_size") > 25).alias("active"), F.lit(False).alias("closed"), c("p_type").alias("category"),
        c("p_retailprice").cast("string").alias("volume"),
    )).alias("wire"))
    ok = wire.accepted(wire.parse_markets(raw, "wire"))
    return ok.groupBy("category").agg(
        F.count(F.lit(1)).alias("accepted"), F.count_if("active").alias("active"),
        F.round(F.sum("volume"), 4).alias("volume"),
    )


def book_wires(spark, sf):
    """Books as the venue sends them: prices and sizes as text."""
    c = F.col

    def side(levels):
        return F.transform(levels, lambda x: F.struct(
            F.format_number(x["price"], 6).alias("px"), x["size"].cast("bigint").cast("string").alias("qty")
        ))

    body = F.to_json(F.struct(
        c("market_slug").alias("marketSlug"), c("ts_us").alias("ts"), side(c("bids")).alias("bids"),
        side(c("asks")).alias("offers"), F.when(c("k") > 90, "halted").otherwise("open").alias("state"),
    ))
    return tb.books(spark, sf).select("event_id", body.alias("wire"))


@query("s12_book_source", f"""with {BOOK}
select event_id, concat_ws(',', case when nb = 0 or na = 0 then 'one_sided' end) as rejects, {s6('case when nb > 0 and na > 0 then ba - bb end')} as spread from bb""")
def s12(spark, sf):
    b = wire.parse_books(book_wires(spark, sf), "wire")
    spread = F.get("asks", F.lit(0))["price"] - F.get("bids", F.lit(0))["price"]
    return b.select("event_id", F.concat_ws(",", "rejects").alias("rejects"), r6(spread).alias("spread"))


@query("s13_trade_source", f"""with {TRADES}
select event_id, market_slug, taker_side as side, {s6('round(price, 6)')} as price, cast(size as double) as size,
 concat_ws(',', case when coalesce(round(price, 6) <= 0 or round(price, 6) >= 1, true) then 'price_out_of_range' end,
  case when coalesce(size <= 0, true) then 'size_not_positive' end) as rejects from trades""")
def s13(spark, sf):
    c = F.col
    body = F.to_json(F.struct(
        c("market_slug").alias("marketSlug"), F.concat(F.lit("ORDER_SIDE_"), c("taker_side")).alias("side"),
        F.round("price", 6).cast("decimal(38,6)").cast("string").alias("price"), c("size").cast("string").alias("qty"), c("ts_us").alias("ts"),
    ))
    raw = tb.trades(spark, sf).select("event_id", body.alias("wire"))
    return wire.parse_trades(raw, "wire").select(
        "event_id", "market_slug", "side", r6("price").alias("price"), "size", F.concat_ws(",", "rejects").alias("rejects")
    )


@query("s14_settlement_labels", """select source, count(*) as n, count(*) filter (where quality + toxic = 1) as yes, count(*) filter (where quality + toxic = 0) as no,
 count(*) filter (where quality + toxic > 1) as not_binary from labels join documents using (doc_id) group by 1""")
def s14(spark, sf):
    rows = tb.load(spark, sf, "labels").join(tb.load(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    payout = F.col("quality") + F.col("toxic")
    label = F.when(payout.isin(0, 1), payout)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(label == 1).alias("yes"), F.count_if(label == 0).alias("no"),
        F.count_if(label.isNull()).alias("not_binary"),
    )


@query("s15_price_history", f"""with {QUOTES}
select event_id, i as point, {s6('mid + 1e-3 * i')} as long_price, {s6('1e0 - (mid + 1e-3 * i)')} as short_price from quotes, range(3) r(i)""")
def s15(spark, sf):
    c = F.col
    hist = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(
        i.alias("i"), (c("mid") + F.lit(0.001) * i).alias("long"), (F.lit(1.0) - (c("mid") + F.lit(0.001) * i)).alias("short")
    ))
    raw = tb.quotes(spark, sf).select("event_id", F.to_json(F.struct(hist.alias("history"))).alias("wire"))
    schema = "history array<struct<i:int,long:double,short:double>>"
    rows = raw.select("event_id", F.explode(F.from_json("wire", schema)["history"]).alias("h"))
    return rows.where(F.abs(c("h.long") + c("h.short") - 1) < 1e-9).select(
        "event_id", c("h.i").cast("bigint").alias("point"), r6("h.long").alias("long_price"), r6("h.short").alias("short_price")
    )


@query("s16_bbo_feed", f"""with {BOOK} select event_id, market_slug, {s6('bb')} as best_bid, {s6('bs')} as bid_size, {s6('ba')} as best_ask, {s6('as_')} as ask_size from bb""")
def s16(spark, sf):
    b = wire.parse_books(book_wires(spark, sf), "wire")
    first = {s: F.get(s, F.lit(0)) for s in ("bids", "asks")}
    return six(b.select(
        "event_id", "market_slug", first["bids"]["price"].alias("best_bid"), first["bids"]["size"].alias("bid_size"),
        first["asks"]["price"].alias("best_ask"), first["asks"]["size"].alias("ask_size"),
    ))


@query("s17_canonical_books", f"""with {BOOK}
select event_id, {s6('(bb + ba) / 2')} as mid, {s6('(bd - ad) / (bd + ad)')} as imbalance, {s6('(ba * bd + bb * ad) / (bd + ad)')} as microprice,
 cast('0x' || substr(md5(event_id::varchar), 1, 8) as bigint) % 97 <> 0 as verified, strftime(make_timestamp(ts_us), '%Y-%m-%d') as partition from bb where nb > 0 and na > 0 and bb < ba""")
def s17(spark, sf):
    from tidemark.functions import book as bk

    c = F.col
    # Some digests were sealed over another text: those records must come out unverified.
    other = F.conv(F.substring(F.md5(c("event_id").cast("string")), 1, 8), 16, 10).cast("bigint") % 97 == 0
    raw = book_wires(spark, sf).withColumn("sha256", F.sha2(F.when(other, F.concat("wire", F.lit("!"))).otherwise(c("wire")), 256))
    ok = wire.accepted(wire.parse_books(raw, "wire"))
    bd, ad = bk.depth(c("bids"), 5), bk.depth(c("asks"), 5)
    micro = (bk.best(c("asks")) * bd + bk.best(c("bids")) * ad) / F.nullif(bd + ad, F.lit(0.0))
    return ok.select(
        "event_id", r6(bk.mid(c("bids"), c("asks"))).alias("mid"), r6(bk.imbalance(c("bids"), c("asks"))).alias("imbalance"),
        r6(micro).alias("microprice"), (F.sha2("wire", 256) == c("sha256")).alias("verified"),
        F.date_format(F.timestamp_micros("venue_us"), "yyyy-MM-dd").alias("partition"),
    )


@query("s39_extraction_report", f"""with {BOOK} select case when nb > 0 and na > 0 then 'accepted' else 'one_sided' end as status, count(*) as n,
 count(distinct market_slug) as markets from bb group by 1""")
def s39(spark, sf):
    b = wire.parse_books(book_wires(spark, sf), "wire")
    status = F.when(F.size("rejects") == 0, "accepted").otherwise(F.concat_ws(",", "rejects"))
    return b.groupBy(status.alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("market_slug").alias("markets")
    )


@query("s18_external_observations", f"""with {DOCS}
select sha256(source || '|' || md5(text) || '|' || lang) as observation_id, source as provider, count(*) as seen, min(published_us) as first_seen,
 max(retrieved_us) as last_seen from docs group by source, md5(text), lang""")
def s18(spark, sf):
    rows = tb.documents(spark, sf).select(
        content_id("source", F.md5("text"), "lang").alias("observation_id"), "source", "published_us", "retrieved_us"
    )
    return rows.groupBy("observation_id", F.col("source").alias("provider")).agg(
        F.count(F.lit(1)).alias("seen"), F.min("published_us").alias("first_seen"), F.max("retrieved_us").alias("last_seen")
    )


@query("s19_tagged_values", f"""with {DOCS}
select case lang when 'en' then 'text' when 'de' then 'scalar' when 'fr' then 'filing' else 'alert' end as kind, count(*) as n,
 count(*) filter (where lang = 'de') as with_number, cast(coalesce(sum(case when lang = 'de' then length(text) end), 0) as bigint) as total_value from docs group by 1""")
def s19(spark, sf):
    c = F.col
    kind = F.when(c("lang") == "en", "text").when(c("lang") == "de", "scalar").when(c("lang") == "fr", "filing").otherwise("alert")
    value = F.struct(
        kind.alias("kind"), F.when(kind == "scalar", F.length("text")).alias("number"),
        F.when(kind == "text", c("text")).alias("body"), F.when(kind == "filing", c("doc_id")).alias("filing_id"),
    )
    return tb.documents(spark, sf).select(value.alias("v")).groupBy("v.kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("v.number").alias("with_number"),
        F.coalesce(F.sum("v.number"), F.lit(0)).alias("total_value"),
    )


@query("s20_available_facts", f"""with {DOCS} select source, count(*) as n, max(greatest(published_us, retrieved_us)) as newest from docs
where greatest(published_us, retrieved_us) <= 1704240000000000 group by 1""")
def s20(spark, sf):
    known = F.greatest("published_us", "retrieved_us")
    return tb.documents(spark, sf, until=1_704_240_000_000_000).where(known <= 1_704_240_000_000_000).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.max(known).alias("newest")
    )


REL = """rel as (select item_id, 1704067200000000 + (item_id % 7) * 86400000000 as scheduled_us, list_distinct(string_split(lower(text), ' ')) as terms from benchmark)"""


def releases(spark, sf):
    """Release calendar: one scheduled release per benchmark item with all words of its search text."""
    return tb.load(spark, sf, "benchmark").select(
        "item_id", (F.lit(1_704_067_200_000_000) + (F.col("item_id") % 7) * DAY).alias("scheduled_us"),
        F.array_distinct(F.split(F.lower("text"), " ")).alias("terms"),
    )


@query("s21_release_calendar", f"""with {REL} select scheduled_us // 86400000000 as day, count(*) as releases, min(item_id) as first_id from rel
where scheduled_us between 1704153600000000 and 1704499200000000 group by 1""")
def s21(spark, sf):
    return releases(spark, sf).where("scheduled_us between 1704153600000000 and 1704499200000000").groupBy(
        F.floor(F.col("scheduled_us") / F.lit(DAY)).cast("bigint").alias("day")
    ).agg(F.count(F.lit(1)).alias("releases"), F.min("item_id").alias("first_id"))


@query("s28_forecast_export", f"""with {FC}, lab as (select distinct 'm' || doc_id as market_id, quality from labels)
select fc.market_id, rid, predicted_us, {s6('p')} as probability, quality as outcome from fc left join lab using (market_id)""")
def s28(spark, sf):
    lab = tb.load(spark, sf, "labels").select(F.concat(F.lit("m"), F.col("doc_id")).alias("market_id"), "quality").distinct()
    return tb.forecasts(spark, sf).join(lab, "market_id", "left").select(
        "market_id", "rid", "predicted_us", r6("p").alias("probability"), F.col("quality").alias("outcome")
    )


@query("j08_label_join", f"""with {FC}, lab as (select distinct 'm' || doc_id as market_id, quality from labels)
select quality as outcome, count(*) as n, {s6('avg(p)')} as mean_p from fc left join lab using (market_id) group by 1""")
def j08(spark, sf):
    return s28(spark, sf).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("probability")).alias("mean_p"))


@query("s29_dataset_summary", f"""with {SNAP} select count(*) as n, count(distinct market_id) as markets, count(distinct event_cluster) as clusters, count(outcome) as resolved,
 min(ts_us) as first_us, max(ts_us) as last_us, cast(sum(cast('0x' || substr(md5(market_id || '|' || ts_us || '|' || rid), 1, 8) as bigint)) as bigint) as data_hash from snap""")
def s29(spark, sf):
    part = F.conv(F.substring(F.md5(F.concat_ws("|", "market_id", "ts_us", "rid")), 1, 8), 16, 10).cast("bigint")
    return tb.snapshots(spark, sf).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("market_id").alias("markets"), F.countDistinct("event_cluster").alias("clusters"),
        F.count("outcome").alias("resolved"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.sum(part).alias("data_hash"),
    )


@query("s30_dataset_from_reports", f"""with {SNAP} select event_cluster, count(*) as forecasts, count(outcome) as labelled, {s6('avg(model_p)')} as mean_p from snap group by 1""")
def s30(spark, sf):
    """Reports hold arrays of forecasts as JSON; the dataset is their explosion joined to labels."""
    c = F.col
    rep = tb.snapshots(spark, sf).select("event_cluster", "outcome", F.to_json(F.struct(
        F.array(F.struct(c("market_id").alias("market"), c("model_p").alias("p"))).alias("forecasts")
    )).alias("report"))
    schema = "forecasts array<struct<market:string,p:double>>"
    rows = rep.select("event_cluster", "outcome", F.explode(F.from_json("report", schema)["forecasts"]).alias("f"))
    return six(rows.groupBy("event_cluster").agg(
        F.count(F.lit(1)).alias("forecasts"), F.count("outcome").alias("labelled"), F.avg("f.p").alias("mean_p")
    ))


@query("s32_idempotent_append", f"""with {DOCS}, h as (select sha256(lower(trim(text)) || '|' || lower(trim(source))) as id, published_us from docs)
select count(distinct id) as new_rows from h where id not in (select id from h where published_us <= 1704153600000000)""")
def s32(spark, sf):
    ids = tb.documents(spark, sf).select("published_us", content_id(F.lower(F.trim("text")), F.lower(F.trim("source"))).alias("id"))
    existing = tb.documents(spark, sf, until=1_704_153_600_000_000).select(
        content_id(F.lower(F.trim("text")), F.lower(F.trim("source"))).alias("id"))
    return ids.join(existing, "id", "left_anti").agg(F.countDistinct("id").alias("new_rows"))


@query("j11_new_observations", f"""with {DOCS}, h as (select sha256(source || '|' || md5(text)) as id, published_us from docs)
select id, min(published_us) as first_us from h where published_us > 1704240000000000 and id not in (select id from h where published_us <= 1704240000000000) group by 1""")
def j11(spark, sf):
    rows = tb.documents(spark, sf).select(content_id("source", F.md5("text")).alias("id"), "published_us")
    known = tb.documents(spark, sf, until=1_704_240_000_000_000).select(content_id("source", F.md5("text")).alias("id"))
    return rows.where("published_us > 1704240000000000").join(known, "id", "left_anti").groupBy("id").agg(
        F.min("published_us").alias("first_us")
    )


@query("s33_raw_provenance", f"""with {RAW} select day, source, count(*) as n, cast(sum(cast('0x' || substr(md5(wire), 1, 8) as bigint)) as bigint) as checksum from raw
where exchange_ms between 1704326400000 and 1705276800000 group by 1, 2""")
def s33(spark, sf):
    part = F.conv(F.substring(F.md5("wire"), 1, 8), 16, 10).cast("bigint")
    return rawlog.envelopes(spark, sf, 1_704_326_400_000_000, 1_705_276_800_999_999).where("exchange_ms between 1704326400000 and 1705276800000").groupBy("day", "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(part).alias("checksum")
    )


@query("s34_mapping_union", f"""with {QT} select market_slug, min(src) as first_source from (select market_slug, 'quotes' as src from quotes union all select market_slug, 'trades' from trades) group by 1""")
def s34(spark, sf):
    a = tb.quotes(spark, sf).select("market_slug", F.lit("quotes").alias("src"))
    b = tb.trades(spark, sf).select("market_slug", F.lit("trades").alias("src"))
    return a.unionByName(b).groupBy("market_slug").agg(F.min("src").alias("first_source"))


@query("s35_decision_audit_log", f"""with {QT} select market_slug, count(*) as decisions, cast(sum(size) as bigint) as size from trades where ts_us between {AS_OF - 5 * DAY} and {AS_OF} and taker_side = 'BUY' group by 1""")
def s35(spark, sf):
    """The decision log is nested JSON; an export is a filtered read of it."""
    c = F.col
    log = tb.trades(spark, sf, AS_OF - 5 * DAY, AS_OF).select(F.to_json(F.struct(
        "market_slug", "ts_us", c("taker_side").alias("type"), F.struct("price", "size").alias("state")
    )).alias("line"))
    schema = "market_slug string, ts_us bigint, type string, state struct<price:double,size:bigint>"
    rows = log.select(F.from_json("line", schema).alias("d")).select("d.*")
    return rows.where((c("type") == "BUY") & c("ts_us").between(AS_OF - 5 * DAY, AS_OF)).groupBy("market_slug").agg(
        F.count(F.lit(1)).alias("decisions"), F.sum("state.size").alias("size")
    )


@query("s36_quote_series_window", f"""with {QUOTES} select event_id, ts_us, {s6('best_bid')} as best_bid, {s6('best_ask')} as best_ask from quotes
where market_slug = 'm7' and ts_us between {AS_OF - 10 * DAY} and {AS_OF + 10 * DAY}""")
def s36(spark, sf):
    return six(tb.quotes(spark, sf, AS_OF - 10 * DAY, AS_OF + 10 * DAY, users=[7]).where(
        (F.col("market_slug") == "m7") & F.col("ts_us").between(AS_OF - 10 * DAY, AS_OF + 10 * DAY)
    ).select("event_id", "ts_us", "best_bid", "best_ask"))


@query("s37_instrument_reference", """select p_type as category, count(*) as instruments, round(min(1e0 / (10 * (1 + p_size % 3))), 6) + 0e0 as min_tick, count(distinct p_brand) as events from part group by 1""")
def s37(spark, sf):
    c = F.col
    inst = tb.load(spark, sf, "part").select(
        F.concat(F.lit("m"), c("p_partkey")).alias("symbol"), c("p_brand").alias("event"), c("p_type").alias("category"),
        (F.lit(1.0) / (F.lit(10) * (F.lit(1) + c("p_size") % 3))).alias("tick"),
    )
    return inst.groupBy("category").agg(
        F.count(F.lit(1)).alias("instruments"), r6(F.min("tick")).alias("min_tick"), F.countDistinct("event").alias("events")
    )


@query("s38_instrument_policy_hash", """with p as (select p_brand as event, sha256(p_partkey || '|' || p_size || '|' || p_type) as d, row_number() over (partition by p_brand order by p_partkey) - 1 as p from part),
l1 as (select event, p // 1000 as p, sha256(string_agg(d, '' order by p)) d from p group by event, p // 1000),
l2 as (select event, p // 1000 as p, sha256(string_agg(d, '' order by p)) d from l1 group by event, p // 1000)
select event, sha256(string_agg(d, '' order by p)) as root from l2 group by 1""")
def s38(spark, sf):
    inst = tb.load(spark, sf, "part").select(
        F.col("p_brand").alias("event"), "p_partkey", content_id("p_partkey", "p_size", "p_type").alias("d")
    )
    placed = running(inst, ["event"], "p_partkey", [], {"pos": ("count", None)})
    return rawlog.tree_root(placed, ["event"], "pos", "d")


@query("p07_stratum_by_prefix", f"""with {SNAP} select case when market_id like 'm1%' then 'alpha' when market_id like 'm2%' then 'beta' else lower(category) end as stratum,
 count(*) as n, count(distinct market_id) as markets from snap group by 1""")
def p07(spark, sf):
    prefixes = spark.createDataFrame([("m1", "alpha"), ("m2", "beta")], "prefix string, stratum string")
    rows = tb.snapshots(spark, sf).select("market_id", "category", F.substring("market_id", 1, 2).alias("prefix"))
    out = rows.join(prefixes, "prefix", "left").withColumn("stratum", F.coalesce("stratum", F.lower("category")))
    return out.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("market_id").alias("markets"))


@query("p11_schema_drift", """with f as (select event_type as kind, unnest(case when event_type = 'error' then ['missing:price', 'unknown:k'] when event_type = 'view' then ['missing:price', 'missing:size', 'unknown:k'] else ['missing:price'] end) as f from events)
select kind, split_part(f, ':', 1) as issue, split_part(f, ':', 2) as field, count(*) as n from f group by all""")
def p11(spark, sf):
    """Payload fields against a pinned set: what is missing and what is new, per kind."""
    c = F.col
    ev = tb.load(spark, sf, "events")
    size = F.when(c("event_type") == "view", F.lit(None)).otherwise(c("value"))
    renamed = F.when(c("event_type").isin("error", "view"), F.lit(1))
    rows = ev.select(c("event_type").alias("kind"), F.to_json(F.struct(size.alias("size"), renamed.alias("k"))).alias("payload"))
    return wire.drift(rows, "kind", "payload", ["price", "size"], ["price", "size"])


@query("u02_field_set_difference", """select 'quotes' as side, unnest(['mid', 'spread']) as field union all select 'trades', unnest(['size', 'taker_side'])""")
def u02(spark, sf):
    """Fields of one table that the other lacks, in both directions, read off the rows."""
    c = F.col

    def fields(df, cols):
        seen = df.select(*[F.max(c(x).isNotNull()).alias(x) for x in cols])
        return seen.select(F.explode(F.array_compact(F.array(*[F.when(c(x), F.lit(x)) for x in cols]))).alias("field"))

    q = fields(tb.quotes(spark, sf), ["market_slug", "ts_us", "event_id", "mid", "spread"])
    t = fields(tb.trades(spark, sf), ["market_slug", "ts_us", "event_id", "size", "taker_side"])
    return q.exceptAll(t).select(F.lit("quotes").alias("side"), "field").unionByName(
        t.exceptAll(q).select(F.lit("trades").alias("side"), "field")
    )


@query("p15_signal_explanation", f"""with {SNAP}, f as (select market_id, rid, [{{'n': 'spread_bps', 'v': spread * 10}}, {{'n': 'mkt_volume', 'v': volume / 1e5}}, {{'n': 'time_left', 'v': hours / 2500e0}}, {{'n': 'ext_gap', 'v': model_p - mid}}] as fs from snap)
select market_id, rid, list_aggregate(list_transform(list_slice(list_sort(list_transform(fs, lambda x: {{'a': -abs(round(x.v, 9)), 'n': x.n}})), 1, 2), lambda x: x.n), 'string_agg', ',') as drivers from f""")
def p15(spark, sf):
    c = F.col
    feats = {"spread_bps": c("spread") * F.lit(10.0), "mkt_volume": c("volume") / F.lit(1e5),
             "time_left": c("hours") / F.lit(2500.0), "ext_gap": c("model_p") - c("mid")}
    ranked = F.array_sort(F.array(*[
        F.struct((-F.abs(F.round(v, 9))).alias("a"), F.lit(n).alias("n")) for n, v in feats.items()
    ]))
    return tb.snapshots(spark, sf).select(
        "market_id", "rid", F.concat_ws(",", F.transform(F.slice(ranked, 1, 2), lambda x: x["n"])).alias("drivers")
    )


@query("j09_cluster_priority", f"""with {QUOTES}, ev1 as (select distinct 'm' || c_custkey as market_slug, 'event-' || c_nationkey as ev from customer where c_mktsegment = 'BUILDING'),
rel1 as (select 'm' || s_suppkey as market_slug, 'release-' || s_nationkey as rel from supplier)
select coalesce(ev, rel, market_slug) as cluster, count(*) as n from quotes left join ev1 using (market_slug) left join rel1 using (market_slug) group by 1""")
def j09(spark, sf):
    c = F.col
    feed = tb.load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.concat(F.lit("m"), c("c_custkey")).alias("market_slug"), F.concat(F.lit("event-"), c("c_nationkey")).alias("ev")
    ).distinct()
    rel = tb.load(spark, sf, "supplier").select(
        F.concat(F.lit("m"), c("s_suppkey")).alias("market_slug"), F.concat(F.lit("release-"), c("s_nationkey")).alias("rel")
    )
    return tb.quotes(spark, sf).select("market_slug").join(feed, "market_slug", "left").join(rel, "market_slug", "left").groupBy(
        F.coalesce("ev", "rel", "market_slug").alias("cluster")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("j12_release_coverage", f"""with {QT}, req as (select 'm' || c_custkey as market_slug, c_nationkey as release_id from customer),
lq as (select market_slug, max(ts_us) l from quotes group by 1), lt as (select market_slug, max(ts_us) l from trades group by 1)
select release_id, count(*) as required, count(lq.l) filter (where {AS_OF + 16 * DAY} - lq.l <= {3 * DAY}) as quote_ok, count(lt.l) as trade_ok,
 {s6(f"avg(cast(coalesce({AS_OF + 16 * DAY} - lq.l <= {3 * DAY}, false) and lt.l is not null as int))")} as covered from req left join lq using (market_slug) left join lt using (market_slug) group by 1""")
def j12(spark, sf):
    c = F.col
    req = tb.load(spark, sf, "customer").select(
        F.concat(F.lit("m"), c("c_custkey")).alias("market_slug"), c("c_nationkey").alias("release_id")
    )
    lq = tb.quotes(spark, sf).groupBy("market_slug").agg(F.max("ts_us").alias("lq"))
    lt = tb.trades(spark, sf).groupBy("market_slug").agg(F.max("ts_us").alias("lt"))
    fresh = F.coalesce(F.lit(AS_OF + 16 * DAY) - c("lq") <= 3 * DAY, F.lit(False))
    return req.join(lq, "market_slug", "left").join(lt, "market_slug", "left").groupBy("release_id").agg(
        F.count(F.lit(1)).alias("required"), F.count_if(fresh).alias("quote_ok"), F.count("lt").alias("trade_ok"),
        r6(F.avg((fresh & c("lt").isNotNull()).cast("int"))).alias("covered"),
    )


@query("j24_identifier_mapping", """with m as (select c_custkey as internal, c_nationkey || '-' || c_mktsegment || '-' || cast(floor(c_acctbal / 50) as bigint) as slug from customer),
d as (select slug, count(distinct internal) as internals from m group by 1)
select count(*) as slugs, count(*) filter (where internals > 1) as ambiguous, cast(sum(case when internals = 1 then 1 else 0 end) as bigint) as unique_slugs from d""")
def j24(spark, sf):
    slug = F.concat_ws("-", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 50).cast("bigint"))
    d = tb.load(spark, sf, "customer").groupBy(slug.alias("slug")).agg(F.countDistinct("c_custkey").alias("internals"))
    return d.agg(
        F.count(F.lit(1)).alias("slugs"), F.count_if(F.col("internals") > 1).alias("ambiguous"),
        F.count_if(F.col("internals") == 1).alias("unique_slugs"),
    )


@query("u01_collector_universe", f"""with {QT}, req as (select 'm' || s_suppkey as market_slug from supplier), str as (
 select market_slug from (select market_slug, row_number() over (partition by length(market_slug) order by count(*) desc, market_slug) rn from trades group by 1) where rn <= 10)
select market_slug from quotes union select market_slug from req union select market_slug from str""")
def u01(spark, sf):
    req = tb.load(spark, sf, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey")).alias("market_slug"))
    active = tb.quotes(spark, sf).select("market_slug")
    return active.union(req).union(k05_rows(spark, sf).select("market_slug")).distinct()


def k05_rows(spark, sf):
    per = tb.trades(spark, sf).groupBy("market_slug").agg(F.count(F.lit(1)).alias("trades")).withColumn(
        "stratum", F.length("market_slug")
    )
    w = Window.partitionBy("stratum").orderBy(F.desc("trades"), "market_slug")
    return per.withColumn("rn", F.row_number().over(w)).where("rn <= 10")


@query("k05_stratified_sample", f"""with {TRADES} select market_slug, cast(length(market_slug) as int) as stratum, trades, rn from (select market_slug, count(*) as trades,
 row_number() over (partition by length(market_slug) order by count(*) desc, market_slug) rn from trades group by 1) where rn <= 10""")
def k05(spark, sf):
    return k05_rows(spark, sf).select("market_slug", "stratum", "trades", F.col("rn").cast("bigint").alias("rn"))


@query("k06_nearest_rank_percentiles", f"""with {EV}, l as (select event_type, k as v, row_number() over (partition by event_type order by k) rn, count(*) over (partition by event_type) n from ev)
select event_type, max(n) as n, max(v) filter (where rn = least(n, floor(n * 95e-2) + 1)) as health_p95, max(v) filter (where rn = greatest(1, round_even(n * 95e-2, 0))) as latency_p95 from l group by 1""")
def k06(spark, sf):
    rows = tb.event_rows(spark, sf).select("event_type", F.col("k").alias("v"))
    return nearest_rank(rows, ["event_type"], "v", {
        "health_p95": lambda n: F.least(n, F.floor(n * F.lit(0.95)) + 1),
        "latency_p95": lambda n: F.greatest(F.lit(1), F.bround(n * F.lit(0.95))),
    })


@query("a52_collector_health", f"""with {EV}, l as (select event_type, k * 1000 as lag_ms, row_number() over (partition by event_type order by k) rn, count(*) over (partition by event_type) n from ev)
select event_type, max(n) as n, max(lag_ms) filter (where rn = least(n, floor(n * 5e-1) + 1)) as p50, max(lag_ms) filter (where rn = least(n, floor(n * 99e-2) + 1)) as p99,
 {s6('avg(cast(lag_ms < 50000 as int))')} as on_time from l group by 1""")
def a52(spark, sf):
    rows = tb.event_rows(spark, sf).select("event_type", (F.col("k") * 1000).alias("lag_ms"))
    ranks = nearest_rank(rows, ["event_type"], "lag_ms", {
        "p50": lambda n: F.least(n, F.floor(n * F.lit(0.5)) + 1), "p99": lambda n: F.least(n, F.floor(n * F.lit(0.99)) + 1),
    })
    rate = rows.groupBy("event_type").agg(r6(F.avg((F.col("lag_ms") < 50000).cast("int"))).alias("on_time"))
    return ranks.join(rate, "event_type")


@query("a73_feed_freshness", f"""with {EV} select event_type as feed, max(ts_us) as newest_us, count(*) filter (where ts_us > {AS_OF + 15 * DAY}) as recent,
 case when {AS_OF + 16 * DAY} - max(ts_us) <= {2 * HOUR} then 'healthy' when count(*) filter (where ts_us > {AS_OF + 15 * DAY}) >= 50 then 'crash_loop' else 'stale' end as health from ev group by 1""")
def a73(spark, sf):
    c = F.col
    g = tb.event_rows(spark, sf).groupBy(c("event_type").alias("feed")).agg(
        F.max("ts_us").alias("newest_us"), F.count_if(c("ts_us") > AS_OF + 15 * DAY).alias("recent")
    )
    health = F.when(F.lit(AS_OF + 16 * DAY) - c("newest_us") <= 2 * HOUR, "healthy").when(c("recent") >= 50, "crash_loop").otherwise("stale")
    return g.withColumn("health", health)


@query("f08_external_features", f"""with {DOCS}, kn as (select * from docs where greatest(published_us, retrieved_us) <= 1704500000000000)
select source, count(*) as facts, {s6('(1704500000000000 - max(published_us)) / 36e8')} as hours_since_newest, true as has_data, {s6('avg(length(text))')} as mean_length,
 {s6("avg(case when lang = 'en' then 1 else 0 end)")} as mean_english from kn group by 1""")
def f08(spark, sf):
    """Facts known at the instant: count, age of the newest, mean of every feature key."""
    c = F.col
    known = tb.documents(spark, sf).where(F.greatest("published_us", "retrieved_us") <= 1_704_500_000_000_000)
    feats = F.create_map(
        F.lit("length"), F.length("text").cast("double"), F.lit("english"), (c("lang") == "en").cast("double")
    )
    rows = known.select("source", "doc_id", "published_us", F.explode(feats).alias("key", "value"))
    return six(rows.groupBy("source").agg(
        F.count_if(c("key") == "length").alias("facts"),
        ((F.lit(1_704_500_000_000_000) - F.max("published_us")) / F.lit(3.6e9)).alias("hours_since_newest"),
        F.lit(True).alias("has_data"), F.avg(F.when(c("key") == "length", c("value"))).alias("mean_length"),
        F.avg(F.when(c("key") == "english", c("value"))).alias("mean_english"),
    ))


@query("f15_content_hashes", f"""with {DOCS} select doc_id, sha256(lower(trim(text)) || '|' || lower(trim(source))) as content_hash,
 sha256(lower(source) || ',' || lower(lang) || '|' || trim(regexp_replace(lower(text), '[ \\n\\r\\t]+', ' ', 'g'))) as claim_id from docs""")
def f15(spark, sf):
    names = F.array_join(F.transform(F.array("source", "lang"), lambda x: F.lower(x)), ",")
    text = F.trim(F.regexp_replace(F.lower("text"), r"[ \n\r\t]+", " "))
    return tb.documents(spark, sf).select(
        "doc_id", content_id(F.lower(F.trim("text")), F.lower(F.trim("source"))).alias("content_hash"),
        content_id(names, text).alias("claim_id"),
    )


@query("f25_deterministic_ids", f"""with {TRADES} select event_id, substr(sha256(market_slug || '|' || event_id || '|' || ts_us || '|v1'), 1, 16) as measurement_id from trades""")
def f25(spark, sf):
    return tb.trades(spark, sf).select(
        "event_id", content_id("market_slug", "event_id", "ts_us", F.lit("v1"), length=16).alias("measurement_id")
    )


@query("u07_manifest_difference", f"""with {SNAP}, a as (select category, count(*) as n, count(distinct market_id) as markets from snap where ts_us < {SPLIT_US} group by 1),
b as (select category, count(*) as n, count(distinct market_id) as markets from snap where ts_us >= {SPLIT_US} group by 1),
ua as (select category, unnest(['n', 'markets']) as field, unnest([n, markets]) as v from a), ub as (select category, unnest(['n', 'markets']) as field, unnest([n, markets]) as v from b)
select coalesce(ua.category, ub.category) as category, coalesce(ua.field, ub.field) as field, ua.v as first_value, ub.v as second_value, ua.v is not distinct from ub.v as matches
from ua full join ub on ua.category = ub.category and ua.field = ub.field""")
def u07(spark, sf):
    snap = tb.snapshots(spark, sf)

    def manifest(rows, name):
        return rows.groupBy("category").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("market_id").alias("markets")
        ).unpivot(["category"], ["n", "markets"], "field", name)

    a = manifest(snap.where(F.col("ts_us") < SPLIT_US), "first_value")
    b = manifest(snap.where(F.col("ts_us") >= SPLIT_US), "second_value")
    return a.join(b, ["category", "field"], "full_outer").withColumn(
        "matches", F.col("first_value").eqNullSafe(F.col("second_value"))
    )


@query("x06_payload_registry", f"""with {EV} select event_type as kind, count(*) as n, cast(sum(k) as bigint) as total from ev group by 1""")
def x06(spark, sf):
    """User extractors: one schema and one column function per record kind, and one for all other kinds."""
    usual = ("k bigint", lambda p: p["k"])
    registry = {kind: usual for kind in ("click", "error", "purchase", "signup", "view")}
    rows = tb.load(spark, sf, "events").select(F.col("event_type").alias("kind"), "props")
    value = None
    for kind, (schema, fn) in registry.items():
        cond = F.col("kind") == kind
        parsed = fn(F.from_json("props", schema))
        value = F.when(cond, parsed) if value is None else value.when(cond, parsed)
    value = value.otherwise(usual[1](F.from_json("props", usual[0])))
    return rows.withColumn("v", value).groupBy("kind").agg(F.count("v").alias("n"), F.sum("v").alias("total"))


IMPACT = DOCS + """, cl as (select source, doc_id, published_us, (length(text) % 21 - 10) / 50e0 as im from docs)"""


@query("x04_claim_impact_carryover", f"""with {IMPACT} select doc_id, {s6('1e0 / (1e0 + exp(-sum(im) over (partition by source order by published_us, doc_id)))')} as probability from cl""")
def x04(spark, sf):
    """Probability carried from claim to claim: impacts add up in log odds.

    The impact is a user function from claim columns to a log-likelihood ratio.
    """
    def impact(df):
        return (F.length("text") % 21 - 10) / F.lit(50.0)

    claims = tb.documents(spark, sf)
    rows = claims.select("source", "doc_id", "published_us", impact(claims).alias("im"))
    out = running(rows, ["source"], "published_us", ["doc_id"], {"l": ("sum", F.col("im"))})
    return out.select("doc_id", r6(F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("l")))).alias("probability"))


@query("x07_user_uncertainty", f"""with {SNAP} select category, {s6('avg(greatest(spread / 2e0, abs(model_p - mid) * 1e-1))')} as mean_uncertainty from snap group by 1""")
def x07(spark, sf):
    estimators = [lambda df: df["spread"] / F.lit(2.0), lambda df: F.abs(df["model_p"] - df["mid"]) * F.lit(0.1)]
    snap = tb.snapshots(spark, sf)
    widest = F.greatest(*[e(snap) for e in estimators])
    return six(snap.groupBy("category").agg(F.avg(widest).alias("mean_uncertainty")))
