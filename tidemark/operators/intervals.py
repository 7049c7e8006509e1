"""Interval algebra: union, overlap, subtraction, pairing and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.ordered import chain, running


def union_intervals(
    df: DataFrame, keys: Sequence[str], start: str, end: str, hot_rows: int | None = None
) -> DataFrame:
    """Merge overlapping or touching ``[start, end]`` intervals per key."""
    base = df.where(F.col(end) > F.col(start)).select(*keys, start, end)
    # identical starts collapse to their longest interval before anything is ordered
    base = base.groupBy(*keys, start).agg(F.max(end).alias(end))
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    numbered = chain(
        base, keys, start, [], {"_reach": ("max_before", F.col(end))},
        {"_isle": ("sum", F.when(opens, 1).otherwise(0))}, hot_rows=hot_rows,
    )
    return numbered.groupBy(*keys, "_isle").agg(
        F.min(start).alias(start), F.max(end).alias(end)
    ).drop("_isle")


def overlap_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], width: int,
    ls: str, le: str, rs: str, re: str,
) -> DataFrame:
    """Pairs with ``ls < re and rs < le``: equi-join on time cells plus residual.

    Cells come in levels of ``width`` times a power of two. An interval enters the cells of
    its own level, the first whose cells are as long as itself, and of the levels above it,
    at most two each, so its copies grow with the logarithm of the longest interval. A pair
    is kept at the higher of its two own levels, in the cell where the later start falls,
    so no distinct is needed.
    """
    longest = max(df.agg(F.max(F.col(e) - F.col(s))).first()[0] or 0 for df, s, e in ((left, ls, le), (right, rs, re)))
    top = 0
    while width * 2**top < longest:
        top += 1

    def cell(at: Column) -> Column:
        return F.floor(at / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_level")))).cast("long")

    def cells(df: DataFrame, s: str, e: str, own: str) -> DataFrame:
        level = F.lit(0)
        for v in range(top):
            level = level + (F.col(e) - F.col(s) > width * 2**v).cast("int")
        placed = df.withColumn(own, level).withColumn("_level", F.explode(F.sequence(F.col(own), F.lit(top))))
        return placed.withColumn("_cell", F.explode(F.sequence(cell(F.col(s)), cell(F.col(e)))))

    joined = cells(left, ls, le, "_own_l").join(cells(right, rs, re, "_own_r"), [*keys, "_level", "_cell"])
    return joined.where(
        (F.col(ls) < F.col(re)) & (F.col(rs) < F.col(le)) & (F.col("_level") == F.greatest("_own_l", "_own_r"))
        & (F.col("_cell") == cell(F.greatest(ls, rs)))
    ).drop("_cell", "_level", "_own_l", "_own_r")


def clip(df: DataFrame, start: str, end: str, lo: int, hi: int) -> DataFrame:
    """Parts of the intervals inside ``[lo, hi]``."""
    return df.withColumns(
        {start: F.greatest(F.col(start), F.lit(lo)), end: F.least(F.col(end), F.lit(hi))}
    ).where(F.col(end) > F.col(start))


def coverage(df: DataFrame, keys: Sequence[str], start: str, end: str, lo: int, hi: int) -> DataFrame:
    """Share of ``[lo, hi]`` not covered by the union of the intervals."""
    merged = union_intervals(clip(df, start, end, lo, hi), keys, start, end)
    return merged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("gaps"),
        F.sum(F.col(end) - F.col(start)).alias("unobserved_us"),
        F.greatest(
            F.lit(0.0), F.lit(1.0) - F.sum(F.col(end) - F.col(start)) / F.lit(float(hi - lo))
        ).alias("coverage"),
    )


def subtract(
    left: DataFrame, covered: DataFrame, keys: Sequence[str], row_id: str, width: int,
    ls: str, le: str, cs: str, ce: str, hot_rows: int | None = None,
) -> DataFrame:
    """Parts of each left interval that the union of ``covered`` leaves open."""
    union = union_intervals(covered, keys, cs, ce, hot_rows)
    hits = overlap_join(left.select(*keys, row_id, ls, le), union, keys, width, ls, le, cs, ce)
    bounds = running(
        hits, [*keys, row_id], cs, [], {"_prev": ("lag", F.col(ce)), "_next": ("lead", F.col(cs))},
        hot_rows=hot_rows,
    )
    before = F.struct(
        F.greatest(F.coalesce("_prev", ls), F.col(ls)).alias("s"), F.col(cs).alias("e")
    )
    tail = F.when(F.col("_next").isNull(), F.struct(F.col(ce).alias("s"), F.col(le).alias("e")))
    parts = bounds.select(
        *keys, row_id, F.explode(F.array_compact(F.array(before, tail))).alias("p")
    ).where("p.e > p.s").select(*keys, row_id, F.col("p.s").alias(ls), F.col("p.e").alias(le))
    untouched = left.select(*keys, row_id, ls, le).where(F.col(le) > F.col(ls)).join(
        hits.select(*keys, row_id).distinct(), [*keys, row_id], "left_anti"
    )
    return parts.unionByName(untouched)


def pair_fifo(
    df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], opens, closes,
    payload: Sequence[str], hot_rows: int | None = None,
) -> DataFrame:
    """Pair opens and closes first in, first out; a close with nothing open is ignored.

    With S the running (opens - closes), a close is ignored exactly when it pushes S
    below every earlier value and below zero.
    """
    step = F.when(opens, 1).when(closes, -1)
    effective = (F.col("_step") == 1) | (
        F.col("_s") >= F.least(F.lit(0), F.coalesce("_min", F.lit(0)))
    )
    numbered = chain(
        df.where(opens | closes).withColumn("_step", step), keys, t, order,
        {"_s": ("sum", F.col("_step"))},
        {"_min": ("min_before", F.col("_s"))},
        lambda d: d.where(effective),
        {
            "_no": ("sum", F.when(F.col("_step") == 1, 1).otherwise(0)),
            "_nc": ("sum", F.when(F.col("_step") == -1, 1).otherwise(0)),
        },
        hot_rows=hot_rows,
    )
    left = numbered.where("_step = 1").select(
        *keys, F.col("_no").alias("seq"), *[F.col(c).alias(f"open_{c}") for c in payload]
    )
    right = numbered.where("_step = -1").select(
        *keys, F.col("_nc").alias("seq"), *[F.col(c).alias(f"close_{c}") for c in payload]
    )
    return left.join(right, [*keys, "seq"], "left")


def covered_time(
    windows: DataFrame, covered: DataFrame, keys: Sequence[str], ws: str, we: str, cs: str, ce: str,
    name: str = "covered", hot_rows: int | None = None,
) -> DataFrame:
    """Time of each window that the union of ``covered`` fills, without pairing the two.

    With C(x) the covered time before x, the answer is C(we) - C(ws); C comes from one
    running sum over the merged intervals and an as-of probe per window end.
    """
    union = union_intervals(covered, keys, cs, ce, hot_rows)
    length = F.col(ce) - F.col(cs)
    sums = running(union, keys, cs, [], {"_sum": ("sum_before", length)}, hot_rows=hot_rows)
    out = windows
    for end, tag in ((ws, "_c0"), (we, "_c1")):
        out = asof_join(out, sums, keys, end, cs, [cs, ce, "_sum"], name="_iv", tie=F.col(ce), hot_rows=hot_rows)
        upto = F.coalesce("_iv._sum", F.lit(0)) + F.least(F.col(end), F.col(f"_iv.{ce}")) - F.col(f"_iv.{cs}")
        out = out.withColumn(tag, F.coalesce(upto, F.lit(0))).drop("_iv")
    return out.withColumn(name, F.col("_c1") - F.col("_c0")).drop("_c0", "_c1")
