"""Book rebuild from snapshots and deltas, level by level and block by block.

A removal beyond what a level holds is refused, and that depends on the level's own size only.
So every level of a segment (a ticker's rows since a snapshot) is folded on its own, by running
sums between refusals, and a segment is then cut into blocks of rows: each block starts from
the last size of every level before it. A ticker with one snapshot is rebuilt by as many tasks
as it has levels, then by as many as it has blocks; no row is stepped through.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import chain
from tidemark.operators.sequences import BOOK_COLUMNS, BOOK_STATE, gap_epochs
from tidemark.session import checkpointed

BLOCK_ROWS, TOP = 2000, 5
_LEVEL = ["ticker", "segment", "side", "price"]


def refusing_sums(start: np.ndarray, group: np.ndarray, delta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes after each delta and which deltas are refused.

    ``start`` is the size before each row's group. The running sum of a group holds until it
    falls below zero; that delta is refused and the sums after it are taken anew, for all groups
    at once, so the passes are as many as one group's refusals.
    """
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(group)))
    delta, refused = delta.copy(), np.zeros(len(group), bool)
    while True:
        total = np.cumsum(delta)
        before = np.repeat(total[first] - delta[first], size) if len(first) else total
        value = np.round(start + total - before, 9)
        below = np.flatnonzero((value < 0) & ~refused)
        if not len(below):
            return value, refused
        _, at = np.unique(group[below], return_index=True)
        refused[below[at]] = True
        delta[below[at]] = 0.0


def _level_sizes(batches):
    """Stream levels in order; size after each row and refusals. A snapshot's row sets the size."""
    held: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        code = np.zeros(batch.num_rows, np.int64)
        for name in _LEVEL:
            encoded = batch.column(name).dictionary_encode()
            code = code * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy()
        sets, x = batch.column("sets").to_numpy(zero_copy_only=False), batch.column("x").to_numpy()
        new = np.concatenate([[True], code[1:] != code[:-1]])
        group = np.cumsum(new | sets)
        start = np.zeros(batch.num_rows)
        key = tuple(batch.column(name)[0].as_py() for name in _LEVEL)
        if held is not None and held[0] == key and not sets[0]:
            start[group == group[0]] = held[1]
        value, refused = refusing_sums(start, group, x)
        held = (tuple(batch.column(name)[batch.num_rows - 1].as_py() for name in _LEVEL), value[-1])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*_LEVEL, "rn")], pa.array(value), pa.array(refused)], names=[*_LEVEL, "rn", "size", "refused"])


def _tops(side: np.ndarray, wanted: int, group: np.ndarray, at: np.ndarray, price: np.ndarray, size: np.ndarray, virtual: np.ndarray, rows: np.ndarray,
          event_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best price and depth of the best levels of one side at every event.

    ``at`` is the row of the state table in which a level gets its size; ``virtual`` are the
    rows in which groups start, empty but for carried levels.
    """
    mine = np.flatnonzero(side == wanted)
    total = len(rows) + len(virtual)
    if not len(mine):
        return np.full(len(rows), np.nan), np.zeros(len(rows))
    levels, level = np.unique(np.stack([group[mine], -price[mine]]), axis=1, return_inverse=True)
    level = level.ravel()
    first = np.searchsorted(levels[0], np.arange(len(virtual)))
    slot = np.arange(levels.shape[1]) - first[levels[0].astype(np.int64)]
    width = int(slot.max()) + 1
    prices = np.full((len(virtual), width), np.nan)
    prices[levels[0].astype(np.int64), slot] = -levels[1]
    value, last = np.zeros((total, width)), np.zeros((total, width), np.int32)
    last[virtual] = virtual[:, None]
    value[at[mine], slot[level]] = size[mine]
    last[at[mine], slot[level]] = at[mine]
    np.maximum.accumulate(last, axis=0, out=last)
    now = np.take_along_axis(value, last, axis=0)[rows]
    held = now > 0
    best = np.where(held.any(axis=1), prices[event_group, held.argmax(axis=1)], np.nan)
    return best, (now * (held & (np.cumsum(held, axis=1) <= TOP))).sum(axis=1)


def _states(table: pa.Table) -> pa.RecordBatch:
    """Book states of whole groups: carried levels first, then per row its level changes and the row itself."""
    names = ["ticker", "segment", "block"]
    code = np.zeros(table.num_rows, np.int64)
    for name in names:
        encoded = table.column(name).combine_chunks().dictionary_encode()
        code = code * (len(encoded.dictionary) + 1) + encoded.indices.to_numpy()
    group = np.cumsum(np.concatenate([[True], code[1:] != code[:-1]])) - 1
    kind = table.column("kind").to_numpy()
    event = np.flatnonzero(kind == 2)
    upcoming = np.cumsum(kind == 2) - (kind == 2)
    virtual_at = np.searchsorted(event, np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])))
    virtual = virtual_at + np.arange(len(virtual_at))
    at = np.where(kind == 0, virtual[group], upcoming + group + 1)
    rows = at[event]
    level = np.flatnonzero(kind < 2)
    side, price, size = (table.column(c).to_numpy()[level] for c in ("side_no", "price", "size"))
    args = (group[level], at[level], price, size, virtual, rows, group[event])
    bid, bd = _tops(side, 0, *args)
    no, ad = _tops(side, 1, *args)
    ask = 1.0 - no
    mid = (bid + ask) / 2.0
    with np.errstate(invalid="ignore", divide="ignore"):
        micro = np.where(bd + ad > 0, (ask * bd + bid * ad) / (bd + ad), np.nan)
        imbalance = np.where(bd + ad > 0, (bd - ad) / (bd + ad), 0.0)
    refused = np.zeros(len(event), bool)
    hit = (kind == 1) & table.column("refused").to_numpy(zero_copy_only=False).astype(bool)
    refused[upcoming[hit]] = True
    picked = table.take(pa.array(event))
    numbers = [pa.array(v, from_pandas=True) for v in (bid, ask, bd, ad, mid, micro, imbalance)]
    columns = [picked.column("event_id").combine_chunks(), picked.column("ticker").combine_chunks(), *numbers, picked.column("clean").combine_chunks(), pa.array(refused)]
    return pa.RecordBatch.from_arrays(columns, names=BOOK_COLUMNS)


def _rebuilt(batches):
    """Whole groups at a time; the last group of a batch waits for the rest of it."""
    waiting: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if waiting is None else pa.concat_tables([waiting, table])
        if not table.num_rows:
            continue
        last = [table.column(c)[table.num_rows - 1].as_py() for c in ("ticker", "segment", "block")]
        same = np.logical_and.reduce([np.array(table.column(c).to_pylist(), object) == v for c, v in zip(("ticker", "segment", "block"), last)])
        ready = int(np.flatnonzero(same)[0])
        if ready:
            yield _states(table.slice(0, ready))
        waiting = table.slice(ready)
    if waiting is not None and waiting.num_rows:
        yield _states(waiting)


def rebuild_books(rows: DataFrame, connection: Sequence[str], t: str, hot_rows: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Book state after every snapshot and delta; a repeated frame (session and number) counts once.

    One ordered pass over the connection gives the gap epoch, one over the ticker the segments.
    """
    c = F.col
    staged = gap_epochs(rows.dropDuplicates([*connection, "session", "seq"]), connection, t, ["event_id"], hot_rows)
    snapshot = c("kind") == "snapshot"
    numbered = chain(staged, ["ticker"], t, ["event_id"], {
        "segment": ("sum", F.when(snapshot, 1).otherwise(0)), "rn": ("count", None), "_e": ("last", F.when(snapshot, F.struct("epoch")))}, hot_rows=hot_rows)
    kept = checkpointed(numbered.where("segment > 0").select(
        "ticker", "segment", "rn", "event_id", snapshot.alias("sets"), (c("_e.epoch") == c("epoch")).alias("same"), F.floor(c("rn") / block_rows).cast("int").alias("block"),
        "side", "price", "delta", "yes_px", "yes_sz", "no_px", "no_sz"))

    def levels(px, sz, side):
        at = kept.where("sets").select("ticker", "segment", "rn", "sets", F.lit(side).alias("side"), F.posexplode(F.arrays_zip(px, sz)).alias("i", "z"))
        return at.select("ticker", "segment", "rn", "sets", "side", c(f"z.{px}").alias("price"), c(f"z.{sz}").cast("double").alias("x"), "i")

    deltas = kept.where("not sets").select("ticker", "segment", "rn", "sets", "side", "price", c("delta").cast("double").alias("x"), F.lit(0).alias("i"))
    changes = levels("yes_px", "yes_sz", "yes").unionByName(levels("no_px", "no_sz", "no")).unionByName(deltas)
    order = [*_LEVEL, "rn", "i"]
    sized = checkpointed(changes.repartition(*_LEVEL).sortWithinPartitions(*order).select(*_LEVEL, "rn", "sets", "x").mapInArrow(
        _level_sizes, "ticker string, segment long, side string, price double, rn long, size double, refused boolean"))
    sized = sized.withColumns({"block": F.floor(c("rn") / block_rows).cast("int"), "side_no": F.when(c("side") == "no", 1).otherwise(0)})
    dirty = sized.where("refused").groupBy(c("ticker").alias("d_ticker"), c("segment").alias("d_segment")).agg(F.min("rn").alias("dirty_from"))
    events = kept.join(dirty, (c("ticker") == c("d_ticker")) & (c("segment") == c("d_segment")), "left").withColumn(
        "clean", c("same") & (c("dirty_from").isNull() | (c("rn") < c("dirty_from"))))
    # Each level's last size of a block goes on to the blocks up to its next change; one row per block and level.
    ends = kept.groupBy("ticker", "segment").agg(F.max("block").alias("end"), F.min("block").alias("start")).where("start < end")
    lasts = sized.join(ends, ["ticker", "segment"]).groupBy(*_LEVEL, "side_no", "block", "end").agg(F.max_by("size", "rn").alias("size"))
    until = F.coalesce(F.lead("block").over(Window.partitionBy(*_LEVEL).orderBy("block")), c("end"))
    carried = lasts.withColumn("until", until).where((c("until") > c("block")) & (c("size") > 0)).select(
        "ticker", "segment", F.explode(F.sequence(c("block") + 1, c("until"))).alias("block"), F.lit(-1).cast("long").alias("rn"), F.lit(0).alias("kind"), "side_no", "price", "size")
    state = sized.select("ticker", "segment", "block", "rn", F.lit(1).alias("kind"), "side_no", "price", "size", "refused").unionByName(carried, allowMissingColumns=True).unionByName(
        events.select("ticker", "segment", "block", "rn", F.lit(2).alias("kind"), "event_id", "clean"), allowMissingColumns=True)
    filled = state.na.fill({"side_no": -1, "price": 0.0, "size": 0.0, "refused": False})
    groups = ["ticker", "segment", "block"]
    return filled.repartition(*groups).sortWithinPartitions(*groups, "rn", "kind").mapInArrow(_rebuilt, BOOK_STATE)
