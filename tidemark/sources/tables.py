"""Domain tables bound to the warehouse parquet files.

Clocks are kept as epoch microseconds (``*_us``, BIGINT): they order exactly, do not
depend on the session zone, and can be cut into blocks arithmetically.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def d(x: float) -> Column:
    return F.lit(float(x))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def micros(col: str) -> Column:
    return F.unix_micros(F.col(col).cast("timestamp"))


def event_rows(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None,
               users: list[int] | None = None) -> DataFrame:
    """The event log with its clock in microseconds and ``k`` taken from the props.

    Bounds (microseconds, inclusive) and users filter the stored columns, so they reach the scan.
    """
    rows = load(spark, sf_dir, "events")
    kind = rows.schema["ts"].dataType
    if since is not None:
        rows = rows.where(F.col("ts") >= F.timestamp_micros(F.lit(since)).cast(kind))
    if until is not None:
        rows = rows.where(F.col("ts") <= F.timestamp_micros(F.lit(until)).cast(kind))
    if users is not None:
        rows = rows.where(F.col("user_id").isin(users))
    return rows.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        micros("ts").alias("ts_us"),
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("bigint").alias("k"),
    )


def quotes(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None,
           users: list[int] | None = None) -> DataFrame:
    mid = d(0.02) + d(0.96) * F.col("value") / d(500.0)
    spread = d(0.01) + d(0.01) * (F.col("event_id") % 5)
    return (
        event_rows(spark, sf_dir, since, until, users)
        .where(F.col("event_type").isin("view", "click"))
        .select(
            F.concat(F.lit("m"), F.col("user_id")).alias("market_slug"),
            "event_id",
            "ts_us",
            mid.alias("mid"),
            spread.alias("spread"),
            (mid - spread / d(2)).alias("best_bid"),
            (mid + spread / d(2)).alias("best_ask"),
            F.col("k").alias("k"),
        )
    )


def trades(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    return (
        event_rows(spark, sf_dir, since, until)
        .where(F.col("event_type").isin("purchase", "signup"))
        .select(
            F.concat(F.lit("m"), F.col("user_id")).alias("market_slug"),
            "event_id",
            "ts_us",
            (d(0.02) + d(0.96) * F.col("value") / d(500.0)).alias("price"),
            F.col("k").alias("size"),
            F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL").alias("taker_side"),
        )
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection outages: one ``[start, end]`` per error event, ``k`` minutes long."""
    return (
        event_rows(spark, sf_dir)
        .where("event_type = 'error'")
        .select(
            "event_id",
            F.concat(F.lit("m"), F.col("user_id")).alias("market_slug"),
            F.col("ts_us").alias("start_us"),
            (F.col("ts_us") + F.col("k") * 60_000_000).alias("end_us"),
        )
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysis fact table: one market snapshot per line item."""
    li = load(spark, sf_dir, "lineitem")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    bid = d(0.02) + d(0.9) * (F.col("l_partkey") % 89) / d(89.0)
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(
        F.concat(F.lit("m"), F.col("l_partkey")).alias("market_id"),
        F.col("p_brand").alias("event_cluster"),
        F.col("p_type").alias("category"),
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        ).alias("rid"),
        micros("l_shipdate").alias("ts_us"),
        ((F.col("l_quantity") - d(0.5)) / d(50.0)).alias("model_p"),
        bid.alias("bid"),
        (bid + d(0.01) + F.col("l_discount") / d(2.0)).alias("ask"),
        F.col("l_quantity").alias("bid_size"),
        (d(51.0) - F.col("l_quantity")).alias("ask_size"),
        F.col("l_extendedprice").alias("liquidity"),
        (F.col("l_extendedprice") * F.col("l_quantity") / d(100.0)).alias("volume"),
        (F.col("l_quantity") * F.col("l_quantity")).alias("hours"),
        F.col("l_tax").alias("fee_rate"),
        (F.col("l_linestatus") == "O").alias("filled"),
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0)
        .cast("int").alias("outcome"),
    )
    return rows.withColumns(
        {
            "mid": (F.col("bid") + F.col("ask")) / d(2.0),
            "spread": F.col("ask") - F.col("bid"),
            "resolved_us": F.col("ts_us") + (F.col("hours") * d(HOUR_US)).cast("bigint"),
            "net_edge": F.col("model_p") - F.col("ask")
            - F.col("fee_rate") * F.col("ask") * (d(1.0) - F.col("ask")),
        }
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration observations: outcome per market, label known 30 days after its last row."""
    li = load(spark, sf_dir, "lineitem")
    part = load(spark, sf_dir, "part").select("p_partkey", "p_brand")
    known = li.groupBy("l_partkey").agg(
        (F.max(micros("l_shipdate")) + 30 * DAY_US).alias("label_known_us")
    )
    rows = li.join(part, F.col("l_partkey") == F.col("p_partkey")).join(known, "l_partkey")
    slot = F.col("l_partkey") % 3
    outcome = F.when(slot == 0, 0).when(slot == 1, 1).cast("int")
    return rows.select(
        F.concat(F.lit("m"), F.col("l_partkey")).alias("market_id"),
        F.col("p_brand").alias("cluster"),
        micros("l_shipdate").alias("predicted_us"),
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        ).alias("rid"),
        F.when(outcome.isNotNull(), F.col("label_known_us")).alias("label_known_us"),
        ((F.col("l_quantity") - d(0.5)) / d(50.0)).alias("p"),
        outcome.alias("outcome"),
    )


def books(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Five-level order books: arrays of ``struct<price, size>``, best level first."""
    q = quotes(spark, sf_dir, since, until)

    def side(sign: int, best: str, shift: int) -> Column:
        levels = F.transform(
            F.sequence(F.lit(0), F.lit(4)),
            lambda i: F.struct(
                F.round(F.col(best) + d(0.01 * sign) * i, 6).alias("price"),
                (d(1.0) + (F.col("event_id") + i + F.lit(shift)) % 50).alias("size"),
            ),
        )
        return F.filter(levels, lambda x: (x["price"] > 0) & (x["price"] < 1))

    return q.select(
        "market_slug", "event_id", "ts_us", "k", "mid",
        side(-1, "best_bid", 0).alias("bids"),
        side(1, "best_ask", 7).alias("asks"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executed orders: one fill per line item with its cash value and signed PnL."""
    li = load(spark, sf_dir, "lineitem")
    price = (F.col("l_quantity") - d(0.5)) / d(50.0)
    return li.select(
        F.col("l_orderkey").alias("order_id"),
        F.concat(F.lit("m"), F.col("l_partkey")).alias("token_id"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("strategy"),
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_suppkey",
            F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        ).alias("rid"),
        micros("l_shipdate").alias("ts_us"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").alias("shares"),
        price.alias("price"),
        (price * F.col("l_quantity")).alias("notional"),
        F.col("l_tax").alias("fee_rate"),
        F.col("l_discount").alias("slippage"),
        F.when(F.col("l_returnflag") == "R", d(1.0) - price)
        .when(F.col("l_returnflag") == "A", -price)
        .otherwise(d(0.0))
        .alias("pnl_per_share"),
    )


def daily_load(spark: SparkSession, sf_dir: str, until_day: int | None = None) -> DataFrame:
    """Hourly load readings per operating day (order values stand in for MW)."""
    rows = load(spark, sf_dir, "orders")
    if until_day is not None:
        end = F.timestamp_micros(F.lit((until_day + 1) * DAY_US)).cast(rows.schema["o_orderdate"].dataType)
        rows = rows.where(F.col("o_orderdate") < end)
    return rows.select(
        F.floor(micros("o_orderdate") / DAY_US).cast("bigint").alias("day"),
        (F.col("o_orderkey") % 24).alias("hour"),
        F.col("o_orderkey").alias("doc_id"),
        F.col("o_totalprice").alias("mw"),
    )


def documents(spark: SparkSession, sf_dir: str, until: int | None = None) -> DataFrame:
    """External claims: text with a source, a publication and a retrieval clock.

    ``until`` bounds the publication clock, through the stored id it is derived from.
    """
    rows = load(spark, sf_dir, "documents")
    if until is not None:
        rows = rows.where(F.col("doc_id") <= (until - 1_704_067_200_000_000) // 600_000_000)
    return rows.select(
        "doc_id",
        "text",
        "lang",
        "source",
        (F.lit(1_704_067_200_000_000) + F.col("doc_id") * 600_000_000).alias("published_us"),
        (
            F.lit(1_704_067_200_000_000) + F.col("doc_id") * 600_000_000
            + (F.col("n_chars") % 977) * 1_000_000
        ).alias("retrieved_us"),
    )
