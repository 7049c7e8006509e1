"""Every streaming job gives the rows of its batch twin on the same input."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift
from tidemark.operators import sequences as sq
from tidemark.plans import streams as st
from tidemark.sources import rawlog
from tidemark.sources import receipts as rc
from tidemark.sources import tables as tb
from tidemark.streaming import jobs


def as_files(df, path, n=3, order="ts_us"):
    """Write rows in time order as several files, one micro-batch each."""
    rows = df.withColumn("_part", F.ntile(n).over(__import__("pyspark").sql.Window.orderBy(order)))
    for i in range(1, n + 1):
        rows.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return df.schema


def stream_of(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def drain(query):
    query.processAllAvailable()
    query.stop()


def to_memory(df, name, tmp_path, mode="append"):
    return (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
    )


def test_book_rebuild_stream_equals_batch(spark, sf, tmp_path):
    rows = st.ws_rows(spark, sf)
    schema = as_files(rows, str(tmp_path / "ws"))
    drain(to_memory(jobs.rebuild_books(stream_of(spark, schema, str(tmp_path / "ws"))), "books", tmp_path))
    got = {r["event_id"]: r for r in spark.table("books").collect()}
    # inside one session the batch rebuild has the same levels; epochs differ across sessions
    brute = {}
    books, seq, epoch, session = {}, None, 0, None
    for r in rows.orderBy("ts_us", "event_id").collect():
        if r["session"] != session:
            books, seq, epoch, session = {}, None, 0, r["session"]
        if seq is not None and r["seq"] != seq + 1:
            epoch += 1
        seq = r["seq"]
        state = books.setdefault(r["ticker"], sq.BookFold()).step(jobs._Row(r, epoch))
        if state:
            brute[r["event_id"]] = dict(zip(sq.BOOK_COLUMNS, state))
    assert set(got) == set(brute)
    for k, b in brute.items():
        for c in ("best_bid", "bid_depth", "ask_depth", "gap_clean", "rejected"):
            assert got[k][c] == b[c]


def test_claims_stream_equals_batch(spark, sf, tmp_path):
    claims = tb.documents(spark, sf).select(
        "doc_id", F.col("retrieved_us").alias("t_us"), F.timestamp_micros("retrieved_us").alias("ts"),
        F.concat("source", "lang").alias("claim_id"),
    )
    schema = as_files(claims, str(tmp_path / "claims"), order="t_us")
    window = 6 * tb.HOUR_US
    drain(to_memory(jobs.accept_claims(stream_of(spark, schema, str(tmp_path / "claims")), window), "claims", tmp_path))
    got = {r["doc_id"]: r["accepted"] for r in spark.table("claims").collect()}
    want = {r["doc_id"]: r["accepted"] for r in
            sq.accept_spaced(claims, ["claim_id"], "t_us", "doc_id", window).collect()}
    assert got == want and len(got) > 100


def test_late_books_and_drift(spark, sf, tmp_path):
    ev = tb.event_rows(spark, sf).select(
        "event_id", "ts_us", F.col("user_id").cast("string").alias("market_slug"),
        (F.col("ts_us") + F.col("k") * 600_000_000).alias("arrived_us"), F.col("event_type").alias("key"), "value",
    )
    schema = as_files(ev, str(tmp_path / "late"), order="arrived_us")
    drain(to_memory(jobs.reject_late(stream_of(spark, schema, str(tmp_path / "late"))), "late", tmp_path))
    got = {r["event_id"]: r["late"] for r in spark.table("late").collect()}
    want, top = {}, {}
    for r in ev.orderBy("arrived_us", "event_id").collect():
        m = top.get(r["market_slug"])
        want[r["event_id"]] = m is not None and r["ts_us"] < m
        top[r["market_slug"]] = r["ts_us"] if m is None else max(m, r["ts_us"])
    assert got == want and any(want.values())

    schema = as_files(ev, str(tmp_path / "drift"))
    drain(to_memory(jobs.detect_drift(stream_of(spark, schema, str(tmp_path / "drift")), 500.0), "drift", tmp_path))
    got = {r["event_id"]: r["drift"] for r in spark.table("drift").collect()}
    batch = drift.detect_changes(
        ev, "key", "ts_us", ["event_id"], "value", lambda x, s: drift.page_hinkley(x, s, 500.0), lambda: drift.START)
    assert got == {r["event_id"]: r["drift"] for r in batch.collect()}
    assert sum(got.values()) > 0


def test_windows_sessions_dedup_match(spark, sf, tmp_path):
    trades = tb.trades(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))
    end = trades.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("market_slug", F.lit("end"))
    end = end.withColumn("ts_us", F.unix_micros("ts"))
    data = trades.unionByName(end)
    schema = as_files(data, str(tmp_path / "tr"), n=4)
    src = stream_of(spark, schema, str(tmp_path / "tr"))
    drain(to_memory(jobs.signed_flow(src, "1 day"), "flow", tmp_path))
    got = {(r["window"]["start"], r["market_slug"]): (r["flow"], r["n"]) for r in spark.table("flow").where("market_slug <> 'end'").collect()}
    sign = F.when(F.col("taker_side") == "BUY", F.col("size")).otherwise(-F.col("size"))
    want = {(r["window"]["start"], r["market_slug"]): (r["flow"], r["n"]) for r in trades.groupBy(
        F.window("ts", "1 day"), "market_slug").agg(F.sum(sign).alias("flow"), F.count(F.lit(1)).alias("n")).collect()}
    assert got == want

    drain(to_memory(jobs.sessions(src, "6 hours"), "sess", tmp_path))
    n = spark.table("sess").where("market_slug <> 'end'").agg(F.sum("n")).first()[0]
    assert n == trades.count()

    doubled = data.unionByName(data).dropDuplicates(["event_id", "ts"])
    twice = data.unionByName(doubled)
    schema = as_files(twice, str(tmp_path / "dd"))
    dd = jobs.dedup_messages(stream_of(spark, schema, str(tmp_path / "dd")), "ts", ["event_id"], "1 day")
    drain(to_memory(dd, "dd", tmp_path))
    assert spark.table("dd").where("market_slug <> 'end'").count() == trades.select("event_id").distinct().count()

    quotes = tb.quotes(spark, sf).select("market_slug", F.col("event_id").alias("quote_id"), F.timestamp_micros("ts_us").alias("quote_ts"))
    fills = trades.select("market_slug", F.col("event_id").alias("fill_id"), F.col("ts").alias("fill_ts"))
    qs = as_files(quotes, str(tmp_path / "q"), order="quote_ts")
    fs = as_files(fills, str(tmp_path / "f"), order="fill_ts")
    m = jobs.match_fills(stream_of(spark, fs, str(tmp_path / "f")), stream_of(spark, qs, str(tmp_path / "q")), late="60 days")
    drain(to_memory(m, "mt", tmp_path))
    per = spark.table("mt").groupBy("fill_id").count()
    got = {r["fill_id"]: r["count"] for r in per.collect()}
    want = {r["event_id"]: r["quotes"] for r in st.t13(spark, sf).collect()}
    assert got == want


def test_stale_timer(spark, sf, tmp_path):
    rows = [("a", 0), ("a", 60), ("b", 30), ("a", 4000), ("c", 9000), ("c", 9001)]
    df = spark.createDataFrame([(m, s * 1000) for m, s in rows], "market_slug string, t_ms long").withColumn(
        "ts", F.timestamp_millis("t_ms")
    )
    schema = as_files(df, str(tmp_path / "st"), n=6, order="t_ms")
    drain(to_memory(jobs.stale_feeds(stream_of(spark, schema, str(tmp_path / "st")), 600_000), "stale", tmp_path))
    got = {(r["market_slug"], r["stale_from_ms"]) for r in spark.table("stale").collect()}
    assert ("b", 630_000) in got and ("a", 4_600_000) in got and ("a", 660_000) in got


def test_sinks(spark, sf, tmp_path):
    env = rawlog.envelopes(spark, sf)
    schema = as_files(env, str(tmp_path / "raw_in"), order="seq")
    src = stream_of(spark, schema, str(tmp_path / "raw_in"))
    q = jobs.append_raw(src, str(tmp_path / "raw"), str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination()
    back = spark.read.parquet(str(tmp_path / "raw"))
    assert back.count() == env.count()
    assert rawlog.fingerprint(back).first() == rawlog.fingerprint(env).first()
    assert rawlog.integrity(back).agg(F.sum("mismatches")).first()[0] == 0

    twice = env.unionByName(env)
    schema = as_files(twice, str(tmp_path / "once_in"), order="seq")
    for i in range(2):
        jobs.append_new(
            stream_of(spark, schema, str(tmp_path / "once_in")), "seq", str(tmp_path / "once"),
            str(tmp_path / f"ck2_{i}"), availableNow=True,
        ).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "once")).count() == env.count()

    rec = rc.receipts(spark, sf)
    rc.append(rec, str(tmp_path / "rec"))
    again = rc.read(spark, str(tmp_path / "rec"))
    assert again.count() == rec.count()
    rc.export_jsonl(again, str(tmp_path / "json"), 1_705_276_800_000_000)
    with pytest.raises(Exception):
        rc.export_jsonl(again, str(tmp_path / "json"), 1_705_276_800_000_000)
    rc.create_views(again, ["book", "trade", "gap"])
    assert spark.sql("select count(*) from receipts_trade").first()[0] == rec.where("kind = 'trade'").count()


@pytest.mark.parametrize("hot", [5, 10**9])
def test_accept_spaced_matches_fold(spark, hot):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("aaab"), rnd.randrange(0, 400)) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, k string, t long")
    got = {r["id"]: r["accepted"] for r in sq.accept_spaced(df, ["k"], "t", "id", 7, hot_rows=hot).collect()}
    want, last = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        ok = k not in last or t - last[k] >= 7
        if ok:
            last[k] = t
        want[i] = ok
    assert got == want
