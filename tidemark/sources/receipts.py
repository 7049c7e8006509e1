"""Append-only, content-hashed receipts: building, writing, replaying and typed views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ordered import running
from tidemark.sources import tables as tb

RECEIPTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("entity_id", T.StringType(), False),
    T.StructField("received_us", T.LongType(), False),
    T.StructField("source_us", T.LongType(), True),
    T.StructField("payload", T.StringType(), False),
    T.StructField("sha256", T.StringType(), False),
    T.StructField("schema_version", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
])

PAYLOAD = T.StructType([
    T.StructField("event", T.LongType()), T.StructField("k", T.LongType()),
    T.StructField("type", T.StringType()),
])


def receipts(spark: SparkSession, sf_dir: str, until: int | None = None) -> DataFrame:
    """Receipts of every event: quotes are books, purchases and signups trades, errors gaps.

    ``until`` prunes the scan for a replay: nothing is received before it happened.
    """
    ev = tb.event_rows(spark, sf_dir, until=until)
    kind = (
        F.when(F.col("event_type").isin("view", "click"), "book")
        .when(F.col("event_type").isin("purchase", "signup"), "trade")
        .otherwise("gap")
    )
    payload = F.concat(
        F.lit('{"event":'), F.col("event_id"), F.lit(',"k":'), F.col("k"),
        F.lit(',"type":"'), F.col("event_type"), F.lit('"}'),
    )
    return ev.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("m"), F.col("user_id")).alias("entity_id"),
        (F.col("ts_us") + F.col("k") * 1_000_000).alias("received_us"),
        F.when(F.col("event_type") != "signup", F.col("ts_us")).alias("source_us"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("sha256"),
        F.lit(1).alias("schema_version"),
        kind.alias("kind"),
    )


def append(df: DataFrame, path: str) -> None:
    """Append receipts, one folder per kind; there is no update or delete."""
    df.select(*RECEIPTS.fieldNames()).write.mode("append").partitionBy("kind").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECEIPTS).parquet(path)


def replay(df: DataFrame, as_of: int, kind: str | None = None) -> DataFrame:
    """Rows known at ``as_of`` on both clocks; the kind predicate prunes partitions."""
    out = df.where(
        (F.col("received_us") <= as_of)
        & (F.col("source_us").isNull() | (F.col("source_us") <= as_of))
    )
    return out.where(F.col("kind") == kind) if kind else out


def ordered_replay(df: DataFrame, as_of: int, kind: str | None = None) -> DataFrame:
    """Replay in the total order (received, id)."""
    return replay(df, as_of, kind).orderBy("received_us", "id")


def export_jsonl(df: DataFrame, path: str, as_of: int) -> None:
    """Write-once JSON lines of the receipts visible at ``as_of``."""
    ordered_replay(df, as_of).write.mode("errorifexists").json(path)


def import_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed read of JSON lines: valid rows, and rows that are corrupt or out of order."""
    schema = T.StructType([*RECEIPTS.fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.schema(schema).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt"
    ).json(path)
    good = raw.where("_corrupt is null and sha256 = sha2(payload, 256)").drop("_corrupt")
    late = out_of_order(good).where("reversal").drop("reversal")
    return good.join(late.select("id"), "id", "left_anti"), raw.join(
        good.select("id"), "id", "left_anti"
    ).drop("_corrupt").unionByName(late)


def out_of_order(df: DataFrame) -> DataFrame:
    """Flag rows received before a row that precedes them in file (id) order."""
    keyed = df.withColumn("_all", F.lit(1))
    out = running(keyed, ["_all"], "id", [], {"_max": ("max_before", F.col("received_us"))})
    return out.withColumn(
        "reversal", F.coalesce(F.col("received_us") < F.col("_max"), F.lit(False))
    ).drop("_all", "_max")


def typed_view(df: DataFrame, kind: str) -> DataFrame:
    """One kind with its payload opened by an explicit schema."""
    return df.where(F.col("kind") == kind).select(
        "id", "entity_id", "received_us", "source_us",
        F.from_json("payload", PAYLOAD).alias("p"),
    ).select("id", "entity_id", "received_us", "source_us", "p.*")


def create_views(df: DataFrame, kinds: list[str]) -> None:
    """Register one temporary view per kind."""
    for kind in kinds:
        typed_view(df, kind).createOrReplaceTempView(f"receipts_{kind}")


def altered(df: DataFrame, every: int = 97) -> DataFrame:
    """A copy in which one payload in ``every`` (by md5 of its text) was changed after its hash was stored."""
    hit = F.conv(F.substring(F.md5("payload"), 1, 8), 16, 10).cast("bigint") % every == 0
    return df.withColumn("payload", F.when(hit, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))


def verify(df: DataFrame) -> DataFrame:
    """Recompute payload hashes per kind and count the mismatches."""
    return df.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.sha2("payload", 256) != F.col("sha256")).alias("mismatches"),
    )
