"""Ordered computations that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key)`` sends all rows of a key to one task. That is fine
until a key owns a large share of the table, so every operator here first takes a
*profile*: the keys with more than ``1/MAX_HOT_KEYS`` of the rows. Usually there are
none and the operator is one ordinary window. Otherwise the hot keys are cut into
blocks along their order column and each block becomes its own window partition. What
a block has to know of the rows before it (a running total, the last value, the
preceding N rows) reaches it as extra *carry rows* sorted in front of its own rows.

At most ``MAX_HOT_KEYS`` keys can own more than ``1/MAX_HOT_KEYS`` of the rows, so a
profile has a fixed size bound; it is the only thing collected or broadcast here. A
profile decides how the work is split, never the result.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpointed

MAX_HOT_KEYS = 20_000
HOT_ROWS = 1_000_000

UNBOUNDED = Window.unboundedPreceding


@dataclass(frozen=True)
class Profile:
    """Hot keys with the borders of their blocks; ``hot`` is None if there are none.

    Borders are quantiles of the order column, so bursts and outliers do not fill one block.
    They come in two levels (``_heads``, ``_tails``), which keeps the search per row short.
    """

    keys: tuple[str, ...]
    hot: DataFrame | None
    rows: int

    def attach(self, df: DataFrame) -> DataFrame:
        """Left-join the block geometry of hot keys (bounded, hence broadcast)."""
        on = None
        for k in self.keys:
            cond = F.col(k).eqNullSafe(F.col(f"_hot_{k}"))
            on = cond if on is None else on & cond
        return df.join(F.broadcast(self.hot), on, "left").drop(*[f"_hot_{k}" for k in self.keys])

    def blocks(self, df: DataFrame, t: str) -> DataFrame:
        """Add ``_hot`` and the block number ``_blk`` (0 for cold keys)."""
        return self.attach(df).withColumns(
            {"_blk": block_number(F.col(t)), "_hot": F.col("_heads").isNotNull()}).drop("_heads", "_tails")

    def thinned(self, span: float) -> Profile:
        """The same keys with borders at least ``span`` apart."""
        rows = []
        for r in self.hot.collect():
            cuts, kept = [c for i, part in enumerate(r["_tails"]) for c in [*part, *r["_heads"][i:i + 1]]], []
            for c in cuts:
                if not kept or c - kept[-1] >= span:
                    kept.append(c)
            rows.append((*r[:-2], *_two_levels(kept)))
        return Profile(self.keys, self.hot.sparkSession.createDataFrame(rows, self.hot.schema), self.rows)

    def settle(self, df: DataFrame) -> DataFrame:
        """Materialize between stages, but only where skew makes a recomputation costly."""
        return df if self.hot is None else checkpointed(df)


# Borders of one level, and profiles that the driver remembers.
BORDERS, REMEMBERED = 150, 64
_PROFILES: OrderedDict = OrderedDict()


def block_number(at: Column) -> Column:
    """Block of a position on a row with borders; 0 on rows of cold keys. It grows with the position."""
    passed = F.size(F.filter("_heads", lambda e: e <= at))
    inside = F.size(F.filter(F.get("_tails", passed), lambda e: e <= at))
    return F.when(F.col("_heads").isNotNull(), passed * (BORDERS + 1) + inside).otherwise(F.lit(0)).cast("long")


def _borders(df: DataFrame, keys: Sequence[str], t: str, sizes: list) -> list[tuple]:
    """Keys with the quantiles of ``t`` that cut each into its number of pieces.

    Keys are taken by size class, so the quantiles asked of a key are at most four times its
    pieces and all of them together stay within the bound of a profile.
    """
    out, grid = [], 4
    while sizes:
        here, sizes = [r for r in sizes if r["_pieces"] <= grid], [r for r in sizes if r["_pieces"] > grid]
        if here:
            spark = df.sparkSession
            fields = [f"_hot_{k}" for k in keys]
            table = spark.createDataFrame([tuple(r[f] for f in fields) for r in here], ", ".join(f"{f} {dict(df.dtypes)[k]}" for f, k in zip(fields, keys)))
            on = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
            match = on[0]
            for cond in on[1:]:
                match = match & cond
            cuts = F.percentile_approx(F.col(t).cast("double"), [i / grid for i in range(1, grid)], max(10_000, 20 * grid))
            found = df.join(F.broadcast(table), match).groupBy(*fields).agg(cuts.alias("q")).collect()
            out += [(tuple(r[f] for f in fields), sorted(set(r["q"] or []))) for r in found]
        grid *= 4
    return out


def _two_levels(cuts: list[float]) -> tuple[list[float], list[list[float]]]:
    """Sorted borders as heads, and per gap between heads the borders inside it."""
    step = max(1, -(-len(cuts) // (BORDERS + 1)))
    at = list(range(step - 1, len(cuts), step))[:BORDERS]
    starts, ends = [0, *(i + 1 for i in at)], [*at, len(cuts)]
    return [cuts[i] for i in at], [cuts[a:b] for a, b in zip(starts, ends)]


def profile(df: DataFrame, keys: Sequence[str], t: str, hot_rows: int | None = None) -> Profile:
    """Count rows per key (map-side combined) and keep the keys above the share limit.

    Profiles are remembered per plan: a profile that has grown stale still gives exact
    results, only less even blocks.
    """
    floor_rows = HOT_ROWS if hot_rows is None else hot_rows
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    slot = (df.sparkSession.sparkContext.applicationId, floor_rows, MAX_HOT_KEYS, stats.semanticHash())
    known = _PROFILES.get(slot)
    if known is not None and known[0].sameSemantics(stats):
        _PROFILES.move_to_end(slot)
        return known[1]
    total = stats.agg(F.sum("_n").alias("total")).scalar()
    limit = F.greatest(F.lit(float(floor_rows)), total / F.lit(float(MAX_HOT_KEYS)))
    hot = stats.withColumn("_limit", limit).where(F.col("_n") > F.col("_limit")).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], F.ceil(F.col("_n") / F.col("_limit")).cast("int").alias("_pieces"))
    sizes = hot.collect()
    table = None
    if sizes:
        schema = T.StructType([*hot.schema.fields[:-1], T.StructField("_heads", T.ArrayType(T.DoubleType())),
                               T.StructField("_tails", T.ArrayType(T.ArrayType(T.DoubleType())))])
        rows = [(*key, *_two_levels(cuts)) for key, cuts in _borders(df, keys, t, sizes)]
        table = df.sparkSession.createDataFrame(rows, schema)
    made = Profile(tuple(keys), table, floor_rows)
    _PROFILES[slot] = (stats, made)
    while len(_PROFILES) > REMEMBERED:
        _PROFILES.popitem(last=False)
    return made


# Kinds of running results; the second group looks at later rows instead of earlier ones.
_FORWARD = {"next": "last", "lead": "lag", "next_before": "last_before", "sum_after": "sum"}


def running(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    order: Sequence[str],
    specs: dict[str, tuple[str, Column | None]],
    descending: bool = False,
    hot_rows: int | None = None,
    prof: Profile | None = None,
) -> DataFrame:
    """Unbounded window results, exact for keys of any size.

    ``specs`` maps an output name to ``(kind, column)``:

    ``sum`` / ``count`` / ``max`` / ``min``  inclusive running aggregate
    ``sum_before`` / ``max_before`` / ``min_before``  the same without the current row
    ``last`` / ``last_before``               last non-null value so far / of earlier rows
    ``lag``                                  value (null or not) of the preceding row
    ``first``                                value of the key's first row
    ``next`` / ``next_before`` / ``lead`` / ``sum_after``  mirror images over later rows

    Rows are ordered by ``t`` (numeric) and then ``order``; ``descending`` reverses both.
    Every spec shares one shuffle.
    """
    prof = prof or profile(df, keys, t, hot_rows)
    if prof.hot is None:
        return _plain_pass(df, keys, t, order, specs, descending)
    return _blocked_pass(prof.blocks(df, t), keys, t, order, specs, descending).drop("_blk", "_hot")


def chain(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    order: Sequence[str],
    *steps,
    hot_rows: int | None = None,
    prof: Profile | None = None,
) -> DataFrame:
    """Several dependent passes over one ordering.

    A step is a spec dict as for :func:`running` or a function from DataFrame to
    DataFrame (row filters, new columns). Cold keys run all passes after a single
    shuffle; hot keys are settled between passes.
    """
    prof = prof or profile(df, keys, t, hot_rows)

    def cold_steps(rows: DataFrame) -> DataFrame:
        for step in steps:
            rows = step(rows) if callable(step) else _plain_pass(rows, keys, t, order, step, False)
        return rows

    if prof.hot is None:
        return cold_steps(df)
    blocked = prof.blocks(df, t)
    hot = blocked.where("_hot")
    for step in steps:
        hot = step(hot) if callable(step) else checkpointed(
            _blocked_pass(hot, keys, t, order, step, False)
        )
    return cold_steps(blocked.where(~F.col("_hot")).drop("_blk", "_hot")).unionByName(
        hot.drop("_blk", "_hot")
    )


def _plain_pass(df, keys, t, order, specs, descending) -> DataFrame:
    base, plan = _with_values(df, specs)
    cols = [t, *order]

    def window(backwards: bool):
        return Window.partitionBy(*keys).orderBy(
            *[F.desc(c) if backwards != descending else F.asc(c) for c in cols]
        )

    return base.withColumns(_results(plan, window)).drop(*[f"_v_{n}" for n in plan])


def _with_values(df: DataFrame, specs):
    """Add the input column of each spec; returns the normalized kinds."""
    plan = {}
    for name, (kind, column) in specs.items():
        backwards = kind in _FORWARD
        kind = _FORWARD.get(kind, kind)
        value = F.lit(1) if column is None else column
        if kind in ("lag", "first"):
            value = F.struct(value.alias("v"))
        df = df.withColumn(f"_v_{name}", value)
        plan[name] = (kind, backwards)
    return df, plan


def _results(plan, window) -> dict[str, Column]:
    outs = {}
    for name, (kind, backwards) in plan.items():
        v = F.col(f"_v_{name}")
        w = window(backwards)
        frame = w.rowsBetween(UNBOUNDED, -1 if kind.endswith("_before") else 0)
        what = kind.replace("_before", "")
        if what in ("sum", "count"):
            outs[name] = F.sum(v).over(frame)
        elif what == "max":
            outs[name] = F.max(v).over(frame)
        elif what == "min":
            outs[name] = F.min(v).over(frame)
        elif what == "last":
            outs[name] = F.last(v, ignorenulls=True).over(frame)
        elif what == "lag":
            outs[name] = F.lag(v).over(w)["v"]
        else:
            outs[name] = F.first(v, ignorenulls=True).over(frame)["v"]
    return outs


def _blocked_pass(base, keys, t, order, specs, descending) -> DataFrame:
    """One pass over blocked rows; hot blocks receive carry rows from the others."""
    base, plan = _with_values(base, specs)
    rows = base.withColumn("_tag", F.lit(1))
    ordering = F.struct(t, *order)
    for backwards in sorted({b for _, b in plan.values()}):
        flip = backwards != descending  # this group walks from high t to low t
        pick, pick_first = (F.min_by, F.max_by) if flip else (F.max_by, F.min_by)
        blocks = Window.partitionBy(*keys).orderBy(F.desc("_blk") if flip else F.asc("_blk"))
        before = blocks.rowsBetween(UNBOUNDED, -1)
        aggs, prefixes = [], []
        for name, (kind, group) in plan.items():
            if group != backwards:
                continue
            out = f"_v_{name}"
            v = F.col(out)
            what = kind.replace("_before", "")
            if what in ("sum", "count"):
                agg, prefix = F.sum(v), F.sum(out).over(before)
            elif what == "max":
                agg, prefix = F.max(v), F.max(out).over(before)
            elif what == "min":
                agg, prefix = F.min(v), F.min(out).over(before)
            elif what == "last":
                agg = pick(v, F.when(v.isNotNull(), ordering))
                prefix = F.last(out, ignorenulls=True).over(before)
            elif what == "lag":
                agg, prefix = pick(v, ordering), F.last(out).over(before)
            elif what == "first":
                agg, prefix = pick_first(v, ordering), F.first(out).over(before)
            else:
                raise ValueError(f"unknown kind {kind}")
            aggs.append(agg.alias(out))
            prefixes.append(prefix.alias(out))
        carry = (
            base.where("_hot")
            .groupBy(*keys, "_blk")
            .agg(*aggs)
            .select(*keys, "_blk", F.lit(2 if backwards else 0).alias("_tag"), *prefixes)
        )
        rows = rows.unionByName(carry, allowMissingColumns=True)

    cols = [t, *order]

    def window(backwards: bool):
        direction = [F.desc(c) if backwards != descending else F.asc(c) for c in cols]
        tag = F.desc("_tag") if backwards else F.asc("_tag")
        return Window.partitionBy(*keys, "_blk").orderBy(tag, *direction)

    out = rows.withColumns(_results(plan, window)).where("_tag = 1")
    return out.drop("_tag", *[f"_v_{n}" for n in specs])


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    order: Sequence[str],
    depth: int,
    fn: Callable[[DataFrame, object], DataFrame],
    after: int = 0,
    hot_rows: int | None = None,
    prof: Profile | None = None,
) -> DataFrame:
    """Bounded row frames: ``fn(df, w)`` may look ``depth`` rows back and ``after`` ahead.

    Hot keys are re-blocked by exact row number; the rows a neighbouring block needs
    are repeated there as a halo and removed afterwards.
    """
    prof = prof or profile(df, keys, t, hot_rows)
    if prof.hot is None:
        return fn(df, Window.partitionBy(*keys).orderBy(t, *order))
    size = max(prof.rows, depth + 1, after + 1)
    blocked = prof.blocks(df, t)
    cold = blocked.where(~F.col("_hot")).drop("_hot").withColumns(
        {"_blk": F.lit(0).cast("long"), "_halo": F.lit(False)}
    )
    numbered = _blocked_pass(
        blocked.where("_hot"), keys, t, order, {"_rn": ("count", None)}, False
    ).drop("_blk", "_hot").withColumn("_rn", F.col("_rn") - 1)
    own = F.floor(F.col("_rn") / F.lit(size)).cast("long")
    spot = F.col("_rn") % F.lit(size)

    def target(block: Column, halo: bool) -> Column:
        return F.struct(block.alias("b"), F.lit(halo).alias("h"))

    targets = [
        target(own, False),
        F.when(spot >= F.lit(size - depth), target(own + 1, True)),
        F.when(spot < F.lit(after), target(own - 1, True)),
    ]
    hot = (
        numbered.withColumn("_to", F.explode(F.array_compact(F.array(*targets))))
        .withColumns({"_blk": F.col("_to.b"), "_halo": F.col("_to.h")})
        .drop("_to", "_rn")
    )
    w = Window.partitionBy(*keys, "_blk").orderBy(t, *order)
    return fn(cold.unionByName(hot), w).where(~F.col("_halo")).drop("_halo", "_blk")


def rolling_range(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    span: float,
    fn: Callable[[DataFrame, object], DataFrame],
    hot_rows: int | None = None,
    prof: Profile | None = None,
) -> DataFrame:
    """Value-range windows ``[t - span, t]``: ``fn(df, w)`` uses ``w.rangeBetween``."""
    prof = prof or profile(df, keys, t, hot_rows)
    if prof.hot is None:
        return fn(df, Window.partitionBy(*keys).orderBy(t))
    # With borders a span apart a row is needed in its own block and at most the two after it.
    ends = F.array_distinct(F.array(
        block_number(F.col(t)), block_number(F.col(t) + F.lit(float(span) / 2)), block_number(F.col(t) + F.lit(float(span)))))
    rows = prof.thinned(float(span)).attach(df).withColumn("_own", block_number(F.col(t))).withColumn(
        "_blk", F.explode(ends)).drop("_heads", "_tails")
    w = Window.partitionBy(*keys, "_blk").orderBy(t)
    return fn(rows, w).where("_blk = _own").drop("_blk", "_own")


def islands(
    df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str], previous: Column,
    starts: Column, name: str, hot_rows: int | None = None, prof: Profile | None = None,
) -> DataFrame:
    """Number the runs of rows (gaps and islands).

    ``starts`` tells where a run begins and may use ``_prev``, the value that
    ``previous`` had on the preceding row.
    """
    return chain(
        df, keys, t, order, {"_prev": ("lag", previous)},
        {name: ("sum", F.when(starts, 1).otherwise(0))}, hot_rows=hot_rows, prof=prof,
    )


def nearest_rank(
    df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]],
    hot_rows: int | None = None, weight: str | None = None, prof: Profile | None = None,
) -> DataFrame:
    """Exact order statistics: ``ranks`` maps a name to f(n) giving a 1-based rank.

    ``weight`` names a column that tells how many equal rows a row stands for.

    Values are counted first, so repeated values cost one row; the running count over
    distinct values then locates each rank. No group is collected.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_c")
    )
    both = running(
        counted, keys, value, [],
        {"_cum": ("sum", F.col("_c")), "_rest": ("sum_after", F.col("_c"))}, hot_rows=hot_rows, prof=prof,
    )
    both = both.withColumn("n", F.col("_cum") + F.col("_rest") - F.col("_c"))
    hit = {
        name: (F.col("_cum") - F.col("_c") < rank(F.col("n"))) & (rank(F.col("n")) <= F.col("_cum"))
        for name, rank in ranks.items()
    }
    picks = [F.max(F.when(cond, F.col(value))).alias(name) for name, cond in hit.items()]
    return both.groupBy(*keys, "n").agg(*picks)
