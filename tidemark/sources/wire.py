"""Strict readers of venue JSON: typed record or the list of reasons for its rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVEL = T.StructType([T.StructField("px", T.StringType()), T.StructField("qty", T.StringType())])
BOOK = T.StructType([
    T.StructField("marketSlug", T.StringType()), T.StructField("ts", T.LongType()),
    T.StructField("bids", T.ArrayType(LEVEL)), T.StructField("offers", T.ArrayType(LEVEL)),
    T.StructField("state", T.StringType()),
])
TRADE = T.StructType([
    T.StructField("marketSlug", T.StringType()), T.StructField("side", T.StringType()),
    T.StructField("price", T.StringType()), T.StructField("qty", T.StringType()),
    T.StructField("ts", T.LongType()),
])
MARKET = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("outcomes", T.ArrayType(T.StringType())),
    T.StructField("active", T.BooleanType()), T.StructField("closed", T.BooleanType()),
    T.StructField("category", T.StringType()), T.StructField("volume", T.StringType()),
])


def _levels(raw: Column) -> Column:
    return F.transform(raw, lambda x: F.struct(
        F.try_to_number(x["px"], F.lit("9.999999")).cast("double").alias("price"),
        x["qty"].try_cast("double").alias("size"),
    ))


def reasons(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(r)) for cond, r in rules]))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row, however many expressions and filters use them.

    As generated rows they are no part of the expressions above them; plain columns are copied
    into each of their uses, so a text would be parsed again for every field of every rule.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def parse_books(df: DataFrame, wire: str, tick: float | None = None) -> DataFrame:
    """Book record with ``rejects``: malformed, one-sided, unsorted, crossed, off grid."""
    parsed = once(once(df, b=F.from_json(wire, BOOK)), bids=_levels(F.col("b.bids")), asks=_levels(F.col("b.offers")))
    prices = F.concat(F.transform("bids", lambda x: x["price"]), F.transform("asks", lambda x: x["price"]))

    def ordered(col: str, sign: int) -> Column:
        px = F.transform(col, lambda x: x["price"] * sign)
        return (px == F.array_sort(px)) & (F.size(F.array_distinct(px)) == F.size(px))

    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    rules = [
        (F.col("b").isNull() | F.col("b.marketSlug").isNull() | F.col("b.ts").isNull(), "malformed"),
        ((F.coalesce(F.size("bids"), F.lit(0)) <= 0) | (F.coalesce(F.size("asks"), F.lit(0)) <= 0), "one_sided"),
        (F.exists(prices, lambda p: p.isNull() | (p <= 0) | (p >= 1)), "price_out_of_range"),
        (~ordered("bids", -1) | ~ordered("asks", 1), "levels_not_sorted_unique"),
        (bid >= ask, "crossed"),
    ]
    if tick is not None:
        rules.append((
            F.exists(prices, lambda p: F.abs(p / F.lit(tick) - F.round(p / F.lit(tick))) > 1e-6), "off_tick_grid"
        ))
    return parsed.withColumn("rejects", reasons(rules)).select(
        *df.columns, F.col("b.marketSlug").alias("market_slug"), F.col("b.ts").alias("venue_us"),
        F.col("b.state").alias("state"), "bids", "asks", "rejects",
    )


def parse_trades(df: DataFrame, wire: str) -> DataFrame:
    parsed = df.withColumn("t", F.from_json(wire, TRADE))
    side = F.regexp_replace("t.side", "^ORDER_SIDE_", "")
    price, qty = F.col("t.price").try_cast("double"), F.col("t.qty").try_cast("double")
    rules = [
        (F.col("t").isNull() | F.col("t.marketSlug").isNull() | F.col("t.ts").isNull(), "malformed"),
        (side.isNull() | ~side.isin("BUY", "SELL"), "unknown_side"),
        (price.isNull() | (price <= 0) | (price >= 1), "price_out_of_range"),
        (qty.isNull() | (qty <= 0), "size_not_positive"),
    ]
    return parsed.select(
        *df.columns, F.col("t.marketSlug").alias("market_slug"), side.alias("side"), price.alias("price"),
        qty.alias("size"), F.col("t.ts").alias("venue_us"), reasons(rules).alias("rejects"),
    )


def parse_markets(df: DataFrame, wire: str) -> DataFrame:
    parsed = df.withColumn("m", F.from_json(wire, MARKET))
    volume = F.col("m.volume").try_cast("double")
    labels = F.transform("m.outcomes", lambda x: F.upper(x))
    rules = [
        (F.col("m").isNull() | F.col("m.id").isNull(), "malformed"),
        (F.coalesce(labels != F.array(F.lit("YES"), F.lit("NO")), F.lit(True)), "not_binary"),
        (F.col("m.active").isNull() | F.col("m.closed").isNull(), "flags_missing"),
        (volume.isNull() | (volume < 0), "volume_invalid"),
    ]
    return parsed.select(
        *df.columns, F.col("m.id").alias("market_id"), F.col("m.category").alias("category"),
        F.col("m.active").alias("active"), F.col("m.closed").alias("closed"), volume.alias("volume"),
        reasons(rules).alias("rejects"),
    )


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.size("rejects") == 0).drop("rejects")


def quarantine(df: DataFrame) -> DataFrame:
    return df.where(F.size("rejects") > 0)


def drift(df: DataFrame, kind: str, payload: str, required: list[str], known: list[str]) -> DataFrame:
    """Missing, unknown and unparsable payload fields per record kind, counted."""
    keys = F.map_keys(F.from_json(payload, "map<string,string>"))
    have = F.coalesce(keys, F.array().cast("array<string>"))
    found = F.concat(
        F.transform(F.array_except(F.array(*[F.lit(x) for x in required]), have),
                    lambda x: F.struct(F.lit("missing").alias("issue"), x.alias("field"))),
        F.transform(F.array_except(have, F.array(*[F.lit(x) for x in known])),
                    lambda x: F.struct(F.lit("unknown").alias("issue"), x.alias("field"))),
    )
    return df.select(F.col(kind).alias("kind"), F.explode(found).alias("f")).groupBy(
        "kind", "f.issue", "f.field"
    ).agg(F.count(F.lit(1)).alias("n"))
