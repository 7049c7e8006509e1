"""Equity curves, drawdowns, persistence windows and loss breakers per strategy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import chain, nearest_rank


def curve(df: DataFrame, key: str, t: str, order: Sequence[str], pnl, start: float) -> DataFrame:
    """Cumulative PnL, equity, running peak, drawdown and period return of every row."""
    equity = F.lit(start) + F.col("cum_pnl")
    return chain(
        df.withColumn("pnl", pnl), [key], t, order,
        {"cum_pnl": ("sum", F.col("pnl")), "seq": ("count", None)},
        lambda d: d.withColumn("equity", equity),
        {"peak": ("max", F.col("equity")), "prev": ("lag", F.col("equity"))},
        lambda d: d.withColumns({
            "drawdown": F.when(F.col("peak") > 0, F.lit(1.0) - F.col("equity") / F.col("peak")).otherwise(0.0),
            "ret": F.col("equity") / F.nullif(F.col("prev"), F.lit(0.0)) - F.lit(1.0),
        }).drop("prev"),
    )


def ratios(points: DataFrame, key: str, periods: float = 365.0) -> DataFrame:
    """Sharpe-like, Sortino, Calmar and information ratio from per-row returns."""
    r = F.col("ret")
    down = F.sqrt(F.avg(F.pow(F.least(r, F.lit(0.0)), F.lit(2.0))))
    year = F.sqrt(F.lit(periods))
    zero = F.lit(0.0)
    return points.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.max("drawdown").alias("max_drawdown"),
        F.max_by("equity", "seq").alias("final_equity"),
        (F.avg(r) / F.nullif(F.stddev_samp(r), zero) * year).alias("sharpe_like"),
        (F.avg(r) / F.nullif(down, zero) * year).alias("sortino"),
        (F.avg(r) * F.lit(periods) / F.nullif(F.max("drawdown"), zero)).alias("calmar"),
        (F.avg(r) / F.nullif(F.stddev_samp(r), zero)).alias("information_ratio"),
    )


def tail_risk(returns: DataFrame, key: str, value: str, confidence: float = 0.95) -> DataFrame:
    """Nearest-rank VaR, tail mean (CVaR) and tail ratio; null below the minimum samples."""
    level = 1 - confidence

    def low(n):
        return F.floor(F.lit(level) * n) + 1

    ranks = nearest_rank(
        returns, [key], value,
        {
            "var_v": low, "p95": lambda n: F.floor(F.lit(0.95) * n) + 1,
            "p05": lambda n: F.floor(F.lit(0.05) * n) + 1,
            "cut_v": lambda n: F.greatest(F.lit(1), F.floor(F.lit(level) * n)),
        },
    )
    # the tail holds every value below the cut value and enough copies of it to fill the count
    rows = returns.select(key, F.col(value).alias("v")).join(ranks, key)
    tail = rows.groupBy(key).agg(
        F.sum(F.when(F.col("v") < F.col("cut_v"), F.col("v"))).alias("below"),
        F.count_if(F.col("v") < F.col("cut_v")).alias("nb"),
    )
    size = F.greatest(F.lit(1), F.floor(F.lit(level) * F.col("n")))
    return ranks.join(tail, key).select(
        key, "n", F.when(F.col("n") >= 10, -F.col("var_v")).alias("var"),
        F.when(
            F.col("n") >= 10,
            -(F.coalesce("below", F.lit(0.0)) + (size - F.col("nb")) * F.col("cut_v")) / size,
        ).alias("cvar"),
        F.when(
            (F.col("n") >= 20) & (F.col("p05") < 0),
            F.col("p95") / F.nullif(F.abs(F.col("p05")), F.lit(0.0)),
        ).alias("tail_ratio"),
    )


def blocks(points: DataFrame, key: str, size: int, kind: str) -> DataFrame:
    """Performance of consecutive blocks of ``size`` trades.

    ``pnl`` is last minus first cumulative value (the first trade of a block drops out);
    ``block_pnl`` counts every trade.
    """
    block = F.floor((F.col("seq") - 1) / F.lit(size)).cast("bigint")
    out = points.groupBy(key, block.alias("block")).agg(
        F.count(F.lit(1)).alias("trades"),
        (F.max_by("cum_pnl", "seq") - F.min_by("cum_pnl", "seq")).alias("pnl"),
        F.sum("pnl").alias("block_pnl"),
    )
    if kind == "regime":
        out = out.where(F.col("trades") >= size // 2).withColumn(
            "kind", F.when(F.round("pnl", 9) > 0, "regime-up").when(F.round("pnl", 9) < 0, "regime-down")
            .otherwise("regime-flat"),
        )
    else:
        out = out.withColumn("kind", F.lit(kind))
    return out


def breakers(df: DataFrame, key: str, t: str, order: Sequence[str], pnl, start: float,
             drawdown: float, daily: float, day) -> DataFrame:
    """First loss-breaker trip per key: drawdown from the peak, or loss since the day began."""
    equity = F.lit(start) + F.col("cum")
    flag = F.when(
        (F.col("equity") <= 0) | (F.col("equity") <= F.col("peak") * F.lit(1 - drawdown)), "drawdown"
    ).when(F.col("equity") <= F.col("day_start") * F.lit(1 - daily), "daily_loss")
    fresh = ~F.col("day").eqNullSafe(F.col("prev_day"))
    rows = chain(
        df.withColumns({"pnl": pnl, "day": day}), [key], t, order,
        {"cum": ("sum", F.col("pnl")), "prev_day": ("lag", F.col("day"))},
        lambda d: d.withColumn("equity", equity),
        {
            "top": ("max", F.col("equity")),
            "day_start": ("last", F.when(fresh, F.col("equity"))), "seq": ("count", None),
        },
        lambda d: d.withColumn("peak", F.greatest(F.col("top"), F.lit(start))),
    ).withColumn("flag", flag)
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("flag").isNotNull(), F.col("seq"))).alias("halted_at"),
        F.min_by("flag", F.when(F.col("flag").isNotNull(), F.col("seq"))).alias("reason"),
    )
