"""Order-dependent operators: spaced acceptance, gap epochs and the book fold of a stream.

The folds are small Python helpers; Spark splits the work into independent segments or
streams rows past a constant-size state, so no whole key is ever held in memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.ordered import chain
from tidemark.session import checkpointed


def in_order(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows hash-partitioned by group and sorted inside each partition.

    A ``mapInPandas`` on top sees whole groups one after another in Arrow batches, which
    keeps memory constant and costs nothing per group.
    """
    return df.repartition(*group).sortWithinPartitions(*group, *order)


def accept_spaced(df: DataFrame, keys: Sequence[str], t: str, row_id: str, window: int,
                  hot_rows: int | None = None) -> DataFrame:
    """Add ``accepted``: not within ``window`` of the key's last accepted row.

    A gap of ``window`` always starts afresh, so the first row after one is accepted without
    looking further back. From there every row points to the first row that may follow it,
    and pointer doubling follows the chain: the rounds grow with the logarithm of its length
    and no key is ever one task. Times and ids keep their types and orders.
    """
    follows = chain(df.select(*keys, F.col(t).alias("_t"), F.col(row_id).alias("_id")), keys, "_t", ["_id"],
                    {"_prev": ("lag", F.col("_t"))}, hot_rows=hot_rows)
    base = checkpointed(follows.withColumn("_fresh", F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") >= F.lit(window))).drop("_prev"))
    right = base.select(*keys, F.col("_t").alias("_rt"), F.col("_id").alias("_rid"), F.col("_fresh").alias("_rf"))
    nxt = asof_join(
        base.withColumn("_want", F.col("_t") + F.lit(window)), right, keys, "_want", "_rt", ["_rid", "_rf"], forward=True,
        tie=F.col("_rid"), hot_rows=hot_rows,
    )
    # A pointer to a fresh row adds nothing: that row is accepted anyway.
    jump = checkpointed(nxt.select(F.col("_id").alias("a"), F.col("asof._rid").alias("b")).where("b is not null and not asof._rf"))
    reached = base.where("_fresh").select(F.col("_id").alias("a"))
    count = -1
    while True:
        reached = checkpointed(reached.union(reached.join(jump, "a").select(F.col("b").alias("a"))).distinct())
        n = reached.count()
        if n == count:
            break
        count = n
        jump = checkpointed(jump.select("a", F.col("b").alias("m")).join(
            jump.select(F.col("a").alias("m"), "b"), "m").select("a", "b"))
    hit = reached.select(F.col("a").alias(row_id), F.lit(True).alias("_hit"))
    return df.join(hit, row_id, "left").withColumn("accepted", F.coalesce("_hit", F.lit(False))).drop("_hit")


def gap_epochs(df: DataFrame, connection: Sequence[str], t: str, order: Sequence[str],
               hot_rows: int | None = None) -> DataFrame:
    """Sequence-gap flag and running gap epoch of a connection.

    The epoch grows at every session change and every jump of the sequence number.
    """
    prev = F.struct("session", "seq")
    new_session = F.col("_p").isNotNull() & (F.col("_p.session") != F.col("session"))
    jump = F.col("_p").isNotNull() & ~new_session & (F.col("seq") != F.col("_p.seq") + 1)
    return chain(
        df, connection, t, order, {"_p": ("lag", prev)},
        lambda d: d.withColumn("sequence_gap", F.coalesce(jump, F.lit(False))),
        {"epoch": ("sum", F.when(new_session | F.col("sequence_gap"), 1).otherwise(0))},
        hot_rows=hot_rows,
    ).drop("_p")


BOOK_STATE = (
    "event_id bigint, ticker string, best_bid double, best_ask double, bid_depth double, ask_depth double, "
    "mid double, microprice double, imbalance double, gap_clean boolean, rejected boolean"
)


class BookSide:
    """Price -> size with the venue's rules: a removal beyond what exists is refused."""

    def __init__(self, prices=(), sizes=()):
        self.levels = {p: s for p, s in zip(prices, sizes)}

    def apply(self, price: float, delta: float) -> bool:
        size = self.levels.get(price, 0.0) + delta
        if size < 0:
            return False
        if size == 0:
            self.levels.pop(price, None)
        else:
            self.levels[price] = size
        return True

    def top(self, k: int = 5):
        best = sorted(self.levels, reverse=True)[:k]
        return (best[0] if best else None), sum(self.levels[p] for p in best)


class BookFold:
    """State of one ticker since its last snapshot."""

    def __init__(self):
        self.yes, self.no, self.epoch, self.dirty = BookSide(), BookSide(), None, False

    def step(self, row) -> tuple | None:
        rejected = False
        if row.kind == "snapshot":
            self.yes = BookSide(row.yes_px, row.yes_sz)
            self.no = BookSide(row.no_px, row.no_sz)
            self.epoch, self.dirty = row.epoch, False
        elif self.epoch is None:
            return None
        else:
            side = self.yes if row.side == "yes" else self.no
            rejected = not side.apply(row.price, row.delta)
            self.dirty = self.dirty or rejected
        bid, bd = self.yes.top()
        nb, ad = self.no.top()
        ask = None if nb is None else 1.0 - nb
        mid = None if bid is None or ask is None else (bid + ask) / 2.0
        micro = None if mid is None or bd + ad <= 0 else (ask * bd + bid * ad) / (bd + ad)
        imb = (bd - ad) / (bd + ad) if bd + ad > 0 else 0.0
        clean = self.epoch == row.epoch and not self.dirty
        return (row.event_id, row.ticker, bid, ask, float(bd), float(ad), mid, micro, imb, clean, rejected)


BOOK_COLUMNS = [c.split()[0] for c in BOOK_STATE.split(", ")]
