"""Deterministic identifiers and random draws from MD5/SHA-256, equal in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(*parts: Column | str, length: int = 64) -> Column:
    """SHA-256 of the parts joined by ``|``; nulls are skipped as ``concat_ws`` does."""
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    return digest if length == 64 else F.substring(digest, 1, length)


def uniform(seed: int | Column, *parts: Column) -> Column:
    """A reproducible draw in [0, 1) from the first 32 bits of an MD5 digest.

    Unlike ``rand()`` it does not depend on partitioning, so a retried task draws the
    same numbers.
    """
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    text = F.concat_ws("|", seed, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def poisson_one(u: Column) -> Column:
    """Poisson(1) count by inversion of one uniform: the bootstrap weight of a unit."""
    # Cumulative Poisson(1) probabilities for 0..8.
    steps = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
             0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253,
             0.999998874797402]
    out = F.lit(0)
    for s in steps:
        out = out + F.when(u >= F.lit(s), 1).otherwise(0)
    return out


def normal(u1: Column, u2: Column) -> Column:
    """Standard normal draw by the Box-Muller transform."""
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1)) * F.cos(F.lit(6.283185307179586) * u2)
