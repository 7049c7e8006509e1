"""Raw event envelopes: partitioned append, replay order, integrity and day roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import running
from tidemark.session import checkpointed
from tidemark.sources import tables as tb

FANOUT = 1000


def envelopes(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Wire text with its clocks, local sequence, self-hash and partition columns."""
    ev = tb.event_rows(spark, sf_dir, since, until)
    wire = F.concat_ws("|", "event_id", "user_id", "event_type", "k")
    return ev.select(
        F.col("event_id").alias("seq"), wire.alias("wire"), F.col("event_type").alias("source"),
        F.floor(F.col("ts_us") / F.lit(1000)).cast("bigint").alias("exchange_ms"),
        ((F.col("ts_us") + F.col("k") * 1000) * 1000).alias("received_ns"),
        F.sha2(wire, 256).alias("sha256"),
        F.floor(F.col("ts_us") / F.lit(tb.DAY_US)).cast("bigint").alias("day"), "k",
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("day", "source").parquet(path)


def replay_order(df: DataFrame) -> DataFrame:
    """Position of every record in the deterministic order (day, source, received, seq)."""
    return running(df, ["day", "source"], "received_ns", ["seq"], {"position": ("count", None)})


def tampered(df: DataFrame, column: str, every: int = 97) -> DataFrame:
    """A copy in which one record in ``every`` (by md5 of its text) was altered after it was sealed."""
    hit = F.conv(F.substring(F.md5(column), 1, 8), 16, 10).cast("bigint") % every == 0
    return df.withColumn(column, F.when(hit, F.concat(column, F.lit("!"))).otherwise(F.col(column)))


def integrity(df: DataFrame) -> DataFrame:
    return df.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.sha2("wire", 256) != F.col("sha256")).alias("mismatches"),
    )


def tree_levels(df: DataFrame, keys: Sequence[str], position: str, digest: str) -> list[DataFrame]:
    """Hash tree over an ordered group: FANOUT digests at a time, so no task holds a group.

    Levels from the digests (0) to the root, rows ``*keys, _p, _d``. Their number follows the
    largest position: at least three above the digests, one more per factor of FANOUT beyond.
    """
    rows = df.select(*keys, (F.col(position) - 1).alias("_p"), F.col(digest).alias("_d"))
    top = (rows.agg(F.max("_p")).first()[0] or 0) + 1
    levels = 3
    while FANOUT**levels < top:
        levels += 1
    out = [rows]
    for _ in range(levels):
        parent = F.floor(F.col("_p") / F.lit(FANOUT)).cast("bigint")
        joined = F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"]), ""
        )
        out.append(out[-1].groupBy(*keys, parent.alias("_q")).agg(F.sha2(joined, 256).alias("_d")).select(
            *keys, F.col("_q").alias("_p"), "_d"
        ))
    return out


def tree_root(df: DataFrame, keys: Sequence[str], position: str, digest: str) -> DataFrame:
    return tree_levels(df, keys, position, digest)[-1].select(*keys, F.col("_d").alias("root"))


def tree_difference(stored: list[DataFrame], actual: list[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Positions whose digests differ between two trees.

    From the root down, only children of nodes that differ are compared, so an unchanged
    subtree costs one comparison and a changed record one path.
    """
    at = [*keys, "_p"]
    bad = None
    for left, right in zip(reversed(stored), reversed(actual)):
        right = right.withColumnRenamed("_d", "_e")
        if bad is not None:
            parent = F.floor(F.col("_p") / F.lit(FANOUT)).cast("bigint")
            under = bad.withColumnRenamed("_p", "_q")
            left = left.withColumn("_q", parent).join(under, [*keys, "_q"], "left_semi").drop("_q")
            right = right.withColumn("_q", parent).join(under, [*keys, "_q"], "left_semi").drop("_q")
        bad = checkpointed(left.join(right, at, "full_outer").where(~F.col("_d").eqNullSafe(F.col("_e"))).select(*at))
    return bad


def verify(sealed: DataFrame, manifests: DataFrame, found: DataFrame) -> DataFrame:
    """Check of every day's manifest against the records found, the changed records and the link to the day before.

    ``sealed`` holds the digests written with the manifest, ``found`` the records as they are.
    """
    stored = running(sealed, ["day"], "received_ns", ["seq"], {"position": ("count", None)})
    actual = running(found.withColumn("sha256", F.sha2("wire", 256)), ["day"], "received_ns", ["seq"], {"position": ("count", None)})
    levels = [tree_levels(x, ["day"], "position", "sha256") for x in (stored, actual)]
    changed = tree_difference(*levels, ["day"]).withColumn("position", F.col("_p") + 1)
    named = changed.join(stored.select("day", "position", "seq"), ["day", "position"], "left").groupBy("day").agg(
        F.count(F.lit(1)).alias("changed_records"), F.min("seq").alias("first_changed"), F.max("seq").alias("last_changed"))
    counts = found.groupBy("day").agg(F.count(F.lit(1)).alias("found"))
    by_day = Window.partitionBy(F.lit(1)).orderBy("day")  # one row per day
    linked = manifests.withColumn("chain_ok", F.col("previous").eqNullSafe(F.lag("root").over(by_day)))
    out = linked.join(counts, "day", "left").join(named, "day", "left").na.fill(0, ["found", "changed_records"])
    status = (F.when(~F.col("chain_ok"), "chain broken").when(F.col("found") != F.col("n"), "count mismatch")
              .when(F.col("changed_records") > 0, "root mismatch").otherwise("ok"))
    return out.select("day", "n", "changed_records", "first_changed", "last_changed", "chain_ok", status.alias("status"))


def manifest(df: DataFrame) -> DataFrame:
    """One row per day chained to the previous day's root."""
    placed = running(df, ["day"], "received_ns", ["seq"], {"position": ("count", None)})
    roots = tree_root(placed, ["day"], "position", "sha256")
    counts = df.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))
    by_day = Window.partitionBy(F.lit(1)).orderBy("day")  # one row per day
    chained = counts.join(roots, "day").withColumn("previous", F.lag("root").over(by_day))
    return chained.withColumn(
        "manifest_sha256",
        F.sha2(F.concat_ws("|", "day", "n", "sources", "root", F.coalesce("previous", F.lit("genesis"))), 256),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Fingerprint of a replay: repeats dropped, every record hashed with its place in the order."""
    placed = replay_order(df.dropDuplicates(["source", "seq", "wire"]))
    part = F.conv(F.substring(F.md5(F.concat_ws("|", "position", "wire")), 1, 8), 16, 10).cast("bigint")
    return placed.agg(F.count(F.lit(1)).alias("n"), F.sum(part).alias("checksum"))
