"""Column expressions for forecast scoring and the bucket edges of the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bucket edges [lower, upper) and their labels.
DISAGREEMENT_EDGES = [
    (0.0, 0.01, "0-1%"), (0.01, 0.02, "1-2%"), (0.02, 0.05, "2-5%"), (0.05, 0.10, "5-10%"),
    (0.10, 0.15, "10-15%"), (0.15, 0.20, "15-20%"), (0.20, float("inf"), ">20%"),
]
HORIZON_EDGES = [
    (0, 1, "0h-1h"), (1, 6, "1h-6h"), (6, 24, "6h-24h"), (24, 72, "24h-72h"),
    (72, 168, "72h-168h"), (168, 336, "168h-336h"), (336, 720, "336h-720h"),
    (720, 1440, "720h-1440h"), (1440, 2160, "1440h-2160h"), (2160, float("inf"), ">2160h"),
]
LIQUIDITY_EDGES = [
    (0, 1_000, "<$1k"), (1_000, 5_000, "$1k-5k"), (5_000, 25_000, "$5k-25k"),
    (25_000, 100_000, "$25k-100k"), (100_000, float("inf"), ">$100k"),
]
SPREAD_EDGES = [
    (0, 0.01, "<1c"), (0.01, 0.02, "1-2c"), (0.02, 0.05, "2-5c"), (0.05, 0.10, "5-10c"),
    (0.10, float("inf"), ">10c"),
]


def bucket(col: Column, edges) -> Column:
    """Label of the half-open bucket holding ``col``; null outside all of them."""
    out = None
    for lo, hi, label in edges:
        cond = col >= F.lit(float(lo))
        if hi != float("inf"):
            cond = cond & (col < F.lit(float(hi)))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def squared_error(p: Column, y: Column) -> Column:
    return (p - y) * (p - y)


def clipped(p: Column, eps: float) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))


def log_loss_term(p: Column, y: Column, eps: float = 1e-15) -> Column:
    """Negative log likelihood of one forecast; datasets clip at 1e-15, calibration at 1e-12."""
    c = clipped(p, eps)
    return -F.when(y == 1, F.ln(c)).otherwise(F.ln(F.lit(1.0) - c))


def unit_bin(p: Column, bins: int = 10) -> Column:
    """Equal-width bin of a probability; 1.0 falls in the last bin."""
    return F.least(F.floor(p * F.lit(float(bins))), F.lit(bins - 1)).cast("int")


def microprice(bid: Column, ask: Column, bid_size: Column, ask_size: Column) -> Column:
    total = bid_size + ask_size
    weighted = (ask * bid_size + bid * ask_size) / F.nullif(total, F.lit(0.0))
    return F.coalesce(weighted, (bid + ask) / F.lit(2.0), F.lit(0.5))


def ttr_bucket(hours: Column) -> Column:
    """Time-to-resolution classes of the family tests."""
    return (
        F.when(hours.isNull(), "unknown")
        .when(hours < 1, "<1h")
        .when(hours < 24, "1h-24h")
        .when(hours < 168, "1d-7d")
        .otherwise(">=168h")
    )


def ttr_days_bucket(hours: Column) -> Column:
    """Time classes of the edge records."""
    return (
        F.when(hours.isNull(), "unknown").when(hours < 24, "<1d").when(hours < 72, "1-3d")
        .when(hours < 168, "3-7d").otherwise(">7d")
    )


def liquidity_class(liquidity: Column) -> Column:
    return F.when(liquidity < 1000, "thin").when(liquidity < 10000, "medium").otherwise("deep")


def spread_regime(spread: Column) -> Column:
    return F.when(spread <= 0.02, "tight").when(spread.isNotNull(), "wide")


def normalized_category(category: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(category)), F.lit("")), F.lit("unknown"))
