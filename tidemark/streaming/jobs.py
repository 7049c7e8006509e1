"""Structured Streaming jobs. Each has a batch twin that yields the same rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.drift import START, page_hinkley
from tidemark.operators.sequences import BOOK_COLUMNS, BOOK_STATE, BookFold, BookSide


def dedup_messages(stream: DataFrame, event_time: str, keys: list[str], window: str) -> DataFrame:
    """Drop repeats of a payload inside the watermark window; state expires by itself."""
    return stream.withWatermark(event_time, window).dropDuplicatesWithinWatermark(keys)


def signed_flow(stream: DataFrame, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    sign = F.when(F.col("taker_side") == "BUY", F.col("size")).otherwise(-F.col("size"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "market_slug").agg(
        F.sum(sign).alias("flow"), F.count(F.lit(1)).alias("n")
    )


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "market_slug").agg(
        F.count(F.lit(1)).alias("n")
    )


def lag_statistics(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Receive lag per window; the percentile is approximate, for monitoring only."""
    return stream.withWatermark("received", late).groupBy(F.window("received", width)).agg(
        F.count(F.lit(1)).alias("n"), F.avg("lag_ms").alias("mean_lag"),
        F.percentile_approx("lag_ms", 0.95, 1000).alias("p95"),
    )


def rolling_brier(stream: DataFrame, width: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour"):
    error = (F.col("p") - F.col("outcome")) * (F.col("p") - F.col("outcome"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "market_slug").agg(
        F.avg(error).alias("brier"), F.count(F.lit(1)).alias("n")
    )


def match_fills(fills: DataFrame, quotes: DataFrame, tolerance: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Stream-stream interval join of fills with the quotes around them."""
    f = fills.withWatermark("fill_ts", late).alias("f")
    q = quotes.withWatermark("quote_ts", late).alias("q")
    return f.join(q, F.expr(
        f"f.market_slug = q.market_slug and quote_ts >= fill_ts - interval {tolerance} "
        f"and quote_ts <= fill_ts + interval {tolerance}"
    )).select("f.fill_id", "f.market_slug", "fill_ts", "q.quote_id", "quote_ts")


def accept_claims(stream: DataFrame, window_us: int) -> DataFrame:
    """Claims not within the window of the last accepted claim of the same id.

    The state is one time per claim id, dropped when the watermark passes it.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t_us", "doc_id"])
        flags = []
        for t in rows["t_us"]:
            ok = last is None or t - last >= window_us
            if ok:
                last = int(t)
            flags.append(ok)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + window_us // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"doc_id": rows["doc_id"], "accepted": flags})

    return stream.withWatermark("ts", "1 hour").groupBy("claim_id").applyInPandasWithState(
        step, "doc_id bigint, accepted boolean", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def reject_late(stream: DataFrame) -> DataFrame:
    """Strict order per market: a book older than the newest seen is flagged, not dropped."""
    def step(key, batches, state: GroupState):
        top = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["arrived_us", "event_id"])
        late = []
        for t in rows["ts_us"]:
            late.append(top is not None and t < top)
            top = int(t) if top is None else max(top, int(t))
        state.update((top,))
        yield pd.DataFrame({"event_id": rows["event_id"], "late": late})

    return stream.groupBy("market_slug").applyInPandasWithState(
        step, "event_id bigint, late boolean", "top bigint", "append", GroupStateTimeout.NoTimeout
    )


def rebuild_books(stream: DataFrame) -> DataFrame:
    """Book rebuild keyed by session: sequence gaps dirty every book of the session.

    State holds the last sequence number, the epoch and the levels of each ticker seen in
    the session; a session that falls silent times out.
    """
    # the levels of all tickers travel as one JSON text inside the state row
    schema = "seq bigint, epoch bigint, books string"

    def load(raw) -> BookFold:
        book = BookFold()
        book.yes, book.no = BookSide(*raw[0]), BookSide(*raw[1])
        book.epoch, book.dirty = raw[2], raw[3]
        return book

    def dump(book: BookFold):
        sides = [[list(s.levels), list(s.levels.values())] for s in (book.yes, book.no)]
        return [*sides, book.epoch, book.dirty]

    def step(key, batches, state: GroupState):
        seq, epoch, text = state.get if state.exists else (None, 0, "{}")
        books = {k: load(v) for k, v in json.loads(text).items()}
        rows = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        out = []
        for r in rows.itertuples():
            if seq is not None and r.seq <= seq:
                continue  # a frame that was applied before
            if seq is not None and r.seq != seq + 1:
                epoch += 1
            seq = int(r.seq)
            book = books.setdefault(r.ticker, BookFold())
            done = book.step(_Row(r, epoch))
            if done is not None:
                out.append(done)
        live = {k: dump(b) for k, b in books.items() if b.epoch is not None}
        state.update((seq, epoch, json.dumps(live)))
        yield pd.DataFrame(out, columns=BOOK_COLUMNS)

    return stream.groupBy("session").applyInPandasWithState(
        step, BOOK_STATE, schema, "append", GroupStateTimeout.NoTimeout
    )


class _Row:
    """A feed row with the epoch it was applied in."""

    def __init__(self, row, epoch):
        self._row, self.epoch = row, epoch

    def __getattr__(self, name):
        return getattr(self._row, name)


def detect_drift(stream: DataFrame, threshold: float) -> DataFrame:
    """Page-Hinkley per key with its four numbers as state."""
    def step(key, batches, state: GroupState):
        rows = pd.concat(list(batches)).sort_values(["ts_us", "event_id"])
        flags, after = page_hinkley(rows["value"].to_numpy(float), state.get if state.exists else START, threshold)
        state.update(after)
        yield pd.DataFrame({"event_id": rows["event_id"], "drift": flags})

    return stream.groupBy("key").applyInPandasWithState(
        step, "event_id bigint, drift boolean", "n double, total double, cum double, low double",
        "append", GroupStateTimeout.NoTimeout,
    )


def stale_feeds(stream: DataFrame, silence_ms: int) -> DataFrame:
    """A row when a market has been silent for longer than allowed (event-time timer)."""
    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"market_slug": [key[0]], "stale_from_ms": [last + silence_ms]})
            return
        last = state.get[0] if state.exists else None
        stale = []
        for t in sorted(int(t) for pdf in batches for t in pdf["t_ms"]):
            # the next message may arrive before the timer fires
            if last is not None and t - last > silence_ms:
                stale.append(last + silence_ms)
            last = t if last is None else max(last, t)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + silence_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"market_slug": [key[0]] * len(stale), "stale_from_ms": pd.Series(stale, dtype="int64")})

    return stream.withWatermark("ts", "1 minute").groupBy("market_slug").applyInPandasWithState(
        step, "market_slug string, stale_from_ms bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def compare_books(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Level-by-level comparison of two book tables per market."""
    def tall(df, name):
        def one(levels, side):
            return F.transform(levels, lambda x: F.struct(
                F.lit(side).alias("side"), x["price"].alias("price"), x["size"].alias("size")
            ))

        return df.select("market_slug", F.explode(F.concat(one("bids", "bid"), one("asks", "ask"))).alias("l")).select(
            "market_slug", "l.side", "l.price", F.col("l.size").alias(name)
        )

    both = tall(local, "a").join(tall(remote, "b"), ["market_slug", "side", "price"], "full_outer")
    diff = F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    return both.groupBy("market_slug").agg(
        F.count_if(diff > 0).alias("differing"), (F.max(diff) == 0).alias("matches")
    )


def reconcile_each_batch(stream: DataFrame, remote_path: str, out_path: str, checkpoint: str, **trigger):
    """Compare every micro-batch of books with the reference table and append the report."""
    def check(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("market_slug").agg(
            F.max_by(F.struct("bids", "asks"), F.struct("ts_us", "event_id")).alias("b")
        ).select("market_slug", "b.*")
        remote = spark.read.parquet(remote_path).join(latest.select("market_slug"), "market_slug", "left_semi")
        compare_books(latest, remote).withColumn("batch", F.lit(epoch)).write.mode("append").parquet(out_path)

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def append_raw(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Exactly-once file sink partitioned by day and source."""
    return (
        stream.writeStream.format("parquet").partitionBy("day", "source").option("path", path)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()
    )


def append_new(stream: DataFrame, key: str, path: str, checkpoint: str, **trigger):
    """Idempotent append: only ids the table does not hold yet, also after a retried batch."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if _exists(spark, path):
            fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
