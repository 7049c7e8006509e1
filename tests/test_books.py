"""Book rebuild by levels and blocks against the row-by-row fold of the stream."""

import random
from types import SimpleNamespace

import numpy as np
import pytest

from tidemark.operators import books
from tidemark.operators.sequences import BookFold

SCHEMA = ("event_id long, ticker string, ts_us long, kind string, session long, connection string, seq long, yes_px array<double>, yes_sz array<double>, "
          "no_px array<double>, no_sz array<double>, side string, price double, delta double")


def feed(seed, tickers, n, snapshots):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ticker = rng.choice(tickers)
        px = sorted(rng.sample(range(1, 60), rng.randrange(0, 8)), reverse=True)
        snap = i < len(tickers) or rng.random() < snapshots
        ticker = tickers[i] if i < len(tickers) else ticker
        rows.append((i, ticker, i // 2 * 10, "snapshot" if snap else "delta", i // 1000, "c", i + i // 97, [p / 100 for p in px], [float(rng.randrange(1, 40)) for _ in px],
                     [p / 100 for p in px[::2]], [0.5 * rng.randrange(1, 40) for _ in px[::2]], rng.choice(["yes", "no"]), rng.randrange(1, 60) / 100, rng.randrange(-30, 31) * 0.5))
    return rows


def folded(rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    out, held, last, epoch = {}, {}, None, 0
    seen, ordered = set(), []
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if (r[4], r[6]) not in seen:
            seen.add((r[4], r[6]))
            ordered.append(r)
    for r in ordered:
        if last is not None and (last[0] != r[4] or r[6] != last[1] + 1):
            epoch += 1
        last = (r[4], r[6])
        state = held.setdefault(r[1], BookFold()).step(SimpleNamespace(**dict(zip(names, r)), epoch=epoch))
        if state is not None:
            out[state[0]] = state
    return out


@pytest.mark.parametrize("tickers, n, snapshots, block", [(["a", "b", "c"], 900, 0.1, 2000), (["hot"], 2500, 0.0, 64), (["hot", "cold"], 1500, 0.002, 100)])
def test_blocks_equal_the_fold(spark, tickers, n, snapshots, block):
    rows = feed(n, tickers, n, snapshots)
    rows += rows[::13]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "173")
    try:
        got = books.rebuild_books(spark.createDataFrame(rows, SCHEMA).repartition(3), ["connection"], "ts_us", hot_rows=300, block_rows=block).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = folded(rows)
    assert len(got) == len(want) and any(r.rejected for r in got)
    for r in got:
        for name, a, b in zip(r.__fields__, r, want[r.event_id]):
            assert a == b or (isinstance(b, float) and a == pytest.approx(b)), (name, r, want[r.event_id])


def test_refusals_are_settled_in_order():
    rng = np.random.default_rng(1)
    group = np.sort(rng.integers(0, 20, 500))
    start, delta = rng.integers(0, 10, 20)[group].astype(float), rng.integers(-9, 8, 500).astype(float)
    value, refused = books.refusing_sums(start, group, delta)
    for g in np.unique(group):
        size = start[group == g][0]
        for i in np.flatnonzero(group == g):
            no = size + delta[i] < 0
            size = size if no else size + delta[i]
            assert refused[i] == no and value[i] == size
