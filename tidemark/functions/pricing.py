"""Probability, edge, sizing and penalty arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = 1.0


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def logit(p: Column, eps: float | None = None) -> Column:
    """Log odds; null outside (0, 1) unless a clamp is asked for."""
    if eps is not None:
        p = clamp(p, eps, ONE - eps)
        return F.ln(p / (F.lit(ONE) - p))
    return F.when((p > 0) & (p < 1), F.ln(p / (F.lit(ONE) - p)))


def sigmoid(x: Column) -> Column:
    return F.lit(ONE) / (F.lit(ONE) + F.exp(-x))


def bayes(prior: Column, ratio: Column) -> Column:
    """Posterior after one likelihood ratio, everything clamped to [0.01, 0.99]."""
    p = clamp(prior, 0.01, 0.99)
    lr = clamp(ratio, 0.01, 100.0)
    post = clamp(p * lr / (p * lr + (F.lit(ONE) - p)), 0.01, 0.99)
    return F.when(ratio > 0, post).otherwise(prior)


def feature_ratio(value: Column, positive: bool = True) -> Column:
    lr = clamp(F.exp(F.lit(2.0) * clamp(value, -1.0, 1.0)), 0.135, 7.39)
    return lr if positive else F.lit(ONE) / lr


def gross_edge(p: Column, price: Column, yes: Column) -> Column:
    return F.when(yes, p - price).otherwise(F.lit(ONE) - p - price)


def liquidity_penalty(depth: Column, shares: Column, base: float = 0.005) -> Column:
    ratio = F.least(shares / F.nullif(depth, F.lit(0.0)), F.lit(2.0))
    return F.when(depth <= 0, F.lit(base * 2)).otherwise(F.lit(base) * ratio)


def stale_penalty(age_s: Column, max_age: float = 30.0, base: float = 0.003) -> Column:
    return F.when(age_s <= 0, 0.0).otherwise(
        F.lit(base) * F.least(age_s / F.lit(max_age), F.lit(2.0))
    )


def kelly(p: Column, price: Column) -> Column:
    """Kelly fraction of a binary contract; zero outside the valid domain."""
    win = F.lit(ONE) - price
    edge = p * win - (F.lit(ONE) - p) * price
    valid = (price > 0) & (price < 1) & (p >= 0) & (p <= 1) & (edge > 0)
    return F.when(valid, clamp(edge / F.nullif(win, F.lit(0.0)), 0.0, 1.0)).otherwise(0.0)


def capped_size(equity: Column, budget: Column, price: Column, normal: float = 0.005,
                market: float = 0.02, kelly_notional: Column | None = None) -> Column:
    """Notional after risk and market caps, with the name of the binding cap."""
    base = equity * F.lit(normal)
    if kelly_notional is not None:
        base = F.least(base, kelly_notional)
    cap = equity * F.lit(market)
    size = F.least(base, budget, cap)
    why = F.when(size < base, F.when(size == budget, "risk_budget").when(size == cap, "market_cap"))
    return F.struct(
        size.alias("notional"), F.round(size / price, 2).alias("shares"), why.alias("capped_by")
    )


def resolution_penalty(ambiguity: Column, dispute: Column, age_days: Column,
                       decay_days: float = 90.0) -> Column:
    periods = F.greatest(F.lit(0.0), F.floor(age_days / F.lit(decay_days)).cast("double"))
    return F.lit(0.01) + F.lit(0.05) * (ambiguity + dispute) + F.least(
        F.lit(0.03), F.lit(0.005) * periods
    )


# Words that mark sources and questions in the automated quality score.
OFFICIAL_WORDS = ("official", "government")
NEWS_WORDS = ("news", "reuters", "ap", "bloomberg")
SUBJECTIVE_WORDS = ("best", "most", "should", "will", "opinion", "feel")
OBJECTIVE_WORDS = ("number", "percentage", "above", "below", "date", "time")


def _contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def quality_score(question: Column, description: Column, source: Column, has_deadline: Column,
                  official=OFFICIAL_WORDS) -> Column:
    """Automated resolution quality in [0, 1] from the market's own text."""
    q = F.lower(F.coalesce(question, F.lit("")))
    src = F.lower(F.coalesce(source, F.lit("")))
    desc_len = F.length(F.coalesce(description, F.lit("")))
    clarity = (
        F.lit(ONE) - F.when(F.length(q) > 200, 0.1).otherwise(0.0)
        - F.when(desc_len > 1000, 0.1).otherwise(0.0) - F.when(desc_len == 0, 0.2).otherwise(0.0)
    )
    reliability = (
        F.when(_contains_any(src, official), 0.9).when(_contains_any(src, NEWS_WORDS), 0.7)
        .when(F.length(src) > 0, 0.5).otherwise(0.3)
    )
    objective = _contains_any(q, OBJECTIVE_WORDS) & ~_contains_any(q, SUBJECTIVE_WORDS)
    score = (
        clarity * F.lit(0.4) + reliability * F.lit(0.3)
        + F.when(has_deadline, 0.15).otherwise(0.0) + F.when(objective, 0.15).otherwise(0.0)
        - F.when(desc_len < 50, 0.1).otherwise(0.0)
    )
    return clamp(score, 0.0, 1.0)


def historical_uncertainty(p: Column, category_error: Column) -> Column:
    return category_error * (F.lit(0.5) + F.lit(0.5) * F.lit(4.0) * p * (F.lit(ONE) - p))


def band(p: Column, width: Column) -> Column:
    return F.struct(
        F.greatest(F.lit(0.0), p - width).alias("lower"), F.least(F.lit(ONE), p + width).alias("upper")
    )
