"""Point-in-time joins: as-of, nearest within a tolerance, at a horizon, with a delay.

All of them merge the two sides into one ordered stream per key and carry the last
right-hand row along it, so a probe costs one shuffle whatever the number of matches
and never looks past its own clock. The carried value is a struct: a newer row whose
fields are null still replaces an older one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import Profile, chain, profile, running


def _merged(left, right, keys, left_t, right_t, payload, tie, sides):
    struct = F.struct(*[F.col(c) for c in payload])
    rhs = right.select(
        *keys, F.col(right_t).alias("_t"), F.lit(sides[1]).alias("_side"), tie.alias("_tie"), struct.alias("_r"),
    )
    lhs = left.withColumns(
        {"_t": F.col(left_t), "_side": F.lit(sides[0]), "_tie": F.lit(None).cast(rhs.schema["_tie"].dataType)}
    )
    return lhs.unionByName(rhs, allowMissingColumns=True)


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
    payload: Sequence[str], name: str = "asof", strict: bool = False, forward: bool = False, *,
    tie: Column, hot_rows: int | None = None, prof: Profile | None = None,
) -> DataFrame:
    """Attach to every left row the struct of the latest right row at or before it.

    ``strict`` excludes equal times, ``forward`` takes the first right row at or after.
    Right rows with equal times are ordered by ``tie``, in the order of its own type.
    """
    # at equal times the right row must be met before the left row unless strict
    meets_first = not strict
    side = (2 if meets_first else 0) if forward else (0 if meets_first else 2)
    merged = _merged(left, right, keys, left_t, right_t, payload, tie, (1, side))
    kind = "next" if forward else "last"
    out = running(
        merged, keys, "_t", ["_side", "_tie"], {name: (kind, F.col("_r"))}, hot_rows=hot_rows, prof=prof,
    )
    return out.where("_side = 1").drop("_t", "_side", "_tie", "_r")


def neighbours(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
    payload: Sequence[str], *, tie: Column, hot_rows: int | None = None, prof: Profile | None = None,
) -> DataFrame:
    """Both neighbours in one shuffle: ``prev`` (at or before) and ``next`` (strictly after)."""
    merged = _merged(left, right, keys, left_t, right_t, payload, tie, (1, 0))
    out = running(
        merged, keys, "_t", ["_side", "_tie"],
        {"prev": ("last", F.col("_r")), "next": ("next", F.col("_r"))}, hot_rows=hot_rows, prof=prof,
    )
    return out.where("_side = 1").drop("_t", "_side", "_tie", "_r")


def nearest_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
    payload: Sequence[str], tolerance: Column, name: str = "near", *, tie: Column,
    hot_rows: int | None = None, prof: Profile | None = None,
) -> DataFrame:
    """Closest right row in either direction within ``tolerance``; the earlier wins a tie."""
    fields = list(dict.fromkeys([*payload, right_t]))
    both = neighbours(left, right, keys, left_t, right_t, fields, tie=tie, hot_rows=hot_rows, prof=prof)
    back = F.col(left_t) - F.col(f"prev.{right_t}")
    ahead = F.col(f"next.{right_t}") - F.col(left_t)
    picked = F.when(
        F.col("prev").isNotNull() & (F.col("next").isNull() | (back <= ahead)), F.col("prev")
    ).otherwise(F.col("next"))
    gap = F.abs(F.col(left_t) - picked[right_t])
    return both.withColumn(name, F.when(gap <= tolerance, picked)).drop("prev", "next")


def at_horizons(left: DataFrame, t: str, horizons: Sequence[int], unit_us: int = 1_000_000):
    """One probe row per horizon: ``horizon`` and ``target_us`` = t + horizon."""
    return left.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn(
        "target_us", F.col(t) + F.col("horizon").cast("bigint") * F.lit(unit_us)
    )


def latest(df: DataFrame, keys: Sequence[str], source: str, received: str, row_id: str,
           as_of: int, payload: Sequence[str]) -> DataFrame:
    """Newest visible row per key: both clocks at or before ``as_of``."""
    order = F.struct(F.coalesce(source, received), received, row_id)
    seen = df.where(
        (F.col(received) <= as_of) & (F.col(source).isNull() | (F.col(source) <= as_of))
    )
    return seen.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), order).alias("_r")
    ).select(*keys, "_r.*")


def versions(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], content: Column,
             hot_rows: int | None = None) -> DataFrame:
    """SCD-2 history: rows where the content hash changes, valid until the next change."""
    hashed = df.withColumn("content_hash", F.sha2(content, 256))
    changed = ~F.col("content_hash").eqNullSafe(F.col("_prev"))
    return chain(
        hashed, keys, t, order, {"_prev": ("lag", F.col("content_hash"))},
        lambda d: d.where(changed).drop("_prev"), {"valid_until": ("lead", F.col(t))},
        hot_rows=hot_rows,
    ).withColumnRenamed(t, "valid_from")


def stream_profile(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str,
                   right_t: str, hot_rows: int | None = None) -> Profile:
    """Profile of both sides together, from (cheap) base tables."""
    rows = left.select(*keys, F.col(left_t).alias("_t")).unionByName(
        right.select(*keys, F.col(right_t).alias("_t"))
    )
    return profile(rows, keys, "_t", hot_rows)
