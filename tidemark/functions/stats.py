"""Distribution functions that Spark SQL has no built-in for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF (rational approximation of erf, absolute error below 2e-7)."""
    # Coefficients of formula 7.1.26 in Abramowitz and Stegun.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / F.lit(1.4142135623730951)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * x)
    poly = F.lit(0.0)
    for c in reversed(a):
        poly = (poly + F.lit(c)) * t
    tail = poly * F.exp(-x * x)
    return F.when(z >= 0, F.lit(1.0) - tail / F.lit(2.0)).otherwise(tail / F.lit(2.0))


def two_sided_p(z: Column) -> Column:
    return F.lit(2.0) * (F.lit(1.0) - normal_cdf(F.abs(z)))


def normal_cdf_sql(z: str) -> str:
    """SQL text of :func:`normal_cdf`."""
    x = f"(abs({z}) / 14142135623730951e-16)"
    t = f"(1e0 / (1e0 + 3275911e-7 * {x}))"
    poly = (
        f"((((1061405429e-9 * {t} - 1453152027e-9) * {t} + 1421413741e-9) * {t}"
        f" - 284496736e-9) * {t} + 254829592e-9) * {t}"
    )
    tail = f"({poly} * exp(-{x} * {x}))"
    return f"(case when {z} >= 0 then 1e0 - {tail} / 2e0 else {tail} / 2e0 end)"
