"""Order-book expressions over ``array<struct<price, size>>`` columns, best level first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def top(levels: Column, k: int) -> Column:
    return F.slice(levels, 1, k)


def depth(levels: Column, k: int | None = None) -> Column:
    """Total size of the best ``k`` levels, of all levels without ``k``."""
    return F.aggregate(levels if k is None else top(levels, k), F.lit(0.0), lambda acc, x: acc + x["size"])


def best(levels: Column) -> Column:
    return F.get(levels, 0)["price"]


def best_size(levels: Column) -> Column:
    return F.get(levels, 0)["size"]


def mid(bids: Column, asks: Column) -> Column:
    return (best(bids) + best(asks)) / F.lit(2.0)


def imbalance(bids: Column, asks: Column, k: int = 5) -> Column:
    b, a = depth(bids, k), depth(asks, k)
    return F.when(b + a == 0, 0.0).otherwise((b - a) / F.nullif(b + a, F.lit(0.0)))


def microprice(bids: Column, asks: Column) -> Column:
    b, a = best_size(bids), best_size(asks)
    return F.when(b + a == 0, mid(bids, asks)).otherwise(
        (best(asks) * b + best(bids) * a) / F.nullif(b + a, F.lit(0.0))
    )


def slope(levels: Column, k: int = 5) -> Column:
    """Price distance of the k-th level per unit of depth; null below two levels."""
    last = F.get(levels, F.least(F.size(levels), F.lit(k)) - 1)["price"]
    return F.when(
        (F.size(levels) >= 2) & (best_size(levels) > 0),
        F.abs(last - best(levels)) / F.greatest(depth(levels, k), F.lit(1.0)),
    )


def concentration(levels: Column, k: int = 5) -> Column:
    """Herfindahl index of level sizes."""
    total = depth(levels, k)
    squares = F.aggregate(top(levels, k), F.lit(0.0), lambda acc, x: acc + x["size"] * x["size"])
    return squares / F.nullif(total * total, F.lit(0.0))


def features(bids: Column, asks: Column, k: int = 5) -> dict[str, Column]:
    m = mid(bids, asks)
    spread = best(asks) - best(bids)
    safe = F.nullif(m, F.lit(0.0))
    return {
        "midpoint": m, "best_bid": best(bids), "best_ask": best(asks), "spread": spread,
        "relative_spread": spread / safe, "spread_bps": spread / safe * F.lit(10000.0),
        "microprice": microprice(bids, asks), "bid_depth": depth(bids, k),
        "ask_depth": depth(asks, k), "imbalance": imbalance(bids, asks, k),
        "depth_imbalance_10": imbalance(bids, asks, 10),
        "bid_slope": slope(bids, k), "ask_slope": slope(asks, k),
        "bid_concentration": concentration(bids, k), "ask_concentration": concentration(asks, k),
    }


def taker_fee(shares: Column, price: Column, rate: Column) -> Column:
    """Cash fee of one consumed level: rate * q * p * (1 - p), half up to 5 decimals.

    Rounded in decimals after removing binary noise, so exact halves go up.
    """
    raw = F.round(shares * rate * price * (F.lit(1.0) - price), 9).cast("decimal(18,9)")
    return F.round(raw, 5).cast("double")


def order_fee_cents(count: Column, price: Column, rate: Column) -> Column:
    """Fee of one order rounded up to the next cent; noise below 1e-9 is not a cent."""
    raw = rate * count * price * (F.lit(1.0) - price)
    return F.ceil(F.round(raw * F.lit(100.0), 9)).cast("double") / F.lit(100.0)


def fee_per_contract(price: Column, rate: Column) -> Column:
    return rate * price * (F.lit(1.0) - price)


def walk(levels: Column, shares: Column, rate: Column, limit: Column | None = None,
         side: str = "BUY") -> Column:
    """Consume ``shares`` from the book: one fold over the level array, no UDF.

    Returns struct<filled, notional, fees, levels, vwap, slippage>; levels beyond
    ``limit`` are not touched.
    """
    usable = levels
    if limit is not None:
        usable = F.filter(
            levels, lambda x: x["price"] <= limit if side == "BUY" else x["price"] >= limit
        )
    zero = F.lit(0.0)
    start = F.struct(
        shares.cast("double").alias("left"), zero.alias("notional"), zero.alias("fees"),
        F.lit(0).alias("levels"),
    )

    def step(acc, x):
        q = F.least(acc["left"], x["size"])
        return F.struct(
            (acc["left"] - q).alias("left"),
            (acc["notional"] + q * x["price"]).alias("notional"),
            (acc["fees"] + taker_fee(q, x["price"], rate)).alias("fees"),
            (acc["levels"] + F.when(q > 0, 1).otherwise(0)).alias("levels"),
        )

    def finish(acc):
        filled = shares.cast("double") - acc["left"]
        vwap = acc["notional"] / F.nullif(filled, zero)
        return F.struct(
            filled.alias("filled"), acc["notional"].alias("notional"), acc["fees"].alias("fees"),
            acc["levels"].alias("levels"), vwap.alias("vwap"),
            F.abs(vwap - best(levels)).alias("slippage"),
        )

    return F.aggregate(usable, start, step, finish)
