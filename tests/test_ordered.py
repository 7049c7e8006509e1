"""The blocked form of every ordered primitive equals a brute-force fold, hot key included."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered as o
from tidemark.operators.asof import asof_join, nearest_join
from tidemark.operators.intervals import pair_fifo, subtract, union_intervals


def rows(n=400, seed=1, keys=("a", "b", "c")):
    rnd = random.Random(seed)
    # one key holds two thirds of the rows; many equal times
    return [
        (i, rnd.choice([keys[0]] * 4 + list(keys[1:])), rnd.randrange(0, n // 2),
         rnd.choice([None, 1.0, 2.0, 5.0, -3.0]))
        for i in range(n)
    ]


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


@pytest.mark.parametrize("hot", [7, 10**9])
def test_running_matches_fold(spark, hot):
    data = rows()
    df = spark.createDataFrame(data, "id int, k string, t int, v double")
    v = F.col("v")
    out = o.running(
        df, ["k"], "t", ["id"],
        {
            "s": ("sum", v), "sb": ("sum_before", v), "c": ("count", None), "mx": ("max", v),
            "mnb": ("min_before", v), "l": ("last", v), "lb": ("last_before", v),
            "lg": ("lag", v), "f": ("first", v), "nx": ("next", v), "ld": ("lead", v),
            "nb": ("next_before", v),
        },
        hot_rows=hot,
    )
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(data)

    def fold(seq, fn):
        seq = [x for x in seq if x is not None]
        return fn(seq) if seq else None

    for group in by_key(data).values():
        vals = [r[3] for r in group]
        for i, r in enumerate(group):
            g = got[r[0]]
            assert g["s"] == fold(vals[: i + 1], sum)
            assert g["sb"] == fold(vals[:i], sum)
            assert g["c"] == i + 1
            assert g["mx"] == fold(vals[: i + 1], max)
            assert g["mnb"] == fold(vals[:i], min)
            assert g["l"] == fold(vals[: i + 1], lambda x: x[-1])
            assert g["lb"] == fold(vals[:i], lambda x: x[-1])
            assert g["lg"] == (vals[i - 1] if i else None)
            assert g["f"] == vals[0]
            assert g["nx"] == fold(vals[i:], lambda x: x[0])
            assert g["nb"] == fold(vals[i + 1:], lambda x: x[0])
            assert g["ld"] == (vals[i + 1] if i + 1 < len(vals) else None)


@pytest.mark.parametrize("hot", [7, 10**9])
def test_rolling_matches_fold(spark, hot):
    data = rows(seed=2)
    df = spark.createDataFrame(data, "id int, k string, t int, v double")
    out = o.rolling(
        df, ["k"], "t", ["id"], 5,
        lambda d, w: d.withColumns({
            "n": F.count("v").over(w.rowsBetween(-5, -1)),
            "s": F.sum("v").over(w.rowsBetween(-5, 3)),
        }),
        after=3, hot_rows=hot,
    )
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(data)
    for group in by_key(data).values():
        vals = [r[3] for r in group]
        for i, r in enumerate(group):
            prev = [x for x in vals[max(0, i - 5): i] if x is not None]
            span = [x for x in vals[max(0, i - 5): i + 4] if x is not None]
            assert got[r[0]]["n"] == len(prev)
            assert got[r[0]]["s"] == (sum(span) if span else None)


@pytest.mark.parametrize("hot", [7, 10**9])
def test_rolling_range_matches_fold(spark, hot):
    data = rows(seed=3)
    df = spark.createDataFrame(data, "id int, k string, t int, v double")
    out = o.rolling_range(
        df, ["k"], "t", 9,
        lambda d, w: d.withColumn("n", F.count(F.lit(1)).over(w.rangeBetween(-9, 0))),
        hot_rows=hot,
    )
    got = {r["id"]: r["n"] for r in out.collect()}
    assert len(got) == len(data)
    for r in data:
        assert got[r[0]] == sum(1 for q in data if q[1] == r[1] and r[2] - 9 <= q[2] <= r[2])


@pytest.mark.parametrize("hot", [7, 10**9])
def test_nearest_rank(spark, hot):
    data = rows(seed=4)
    df = spark.createDataFrame(data, "id int, k string, t int, v double")
    out = o.nearest_rank(
        df, ["k"], "t",
        {"p50": lambda n: F.floor(n / 2) + 1, "p90": lambda n: F.ceil(n * 0.9)}, hot_rows=hot,
    )
    for r in out.collect():
        vals = sorted(q[2] for q in data if q[1] == r["k"])
        assert r["n"] == len(vals)
        assert r["p50"] == vals[len(vals) // 2]


@pytest.mark.parametrize("hot", [7, 10**9])
def test_asof_and_nearest(spark, hot):
    left = rows(150, seed=5)
    right = rows(150, seed=6)
    schema = "id int, k string, t int, v double"
    ldf = spark.createDataFrame(left, schema)
    rdf = spark.createDataFrame(right, schema).withColumnsRenamed({"id": "rid", "t": "rt", "v": "rv"})
    tie = F.lpad(F.col("rid").cast("string"), 6, "0")

    def check(strict, forward, ok, best):
        got = asof_join(ldf, rdf, ["k"], "t", "rt", ["rid", "rv"], strict=strict, forward=forward,
                        tie=tie, hot_rows=hot)
        for r in got.collect():
            cand = [q for q in right if q[1] == r["k"] and ok(q[2], r["t"])]
            want = best(cand, key=lambda q: (q[2], q[0])) if cand else None
            assert (r["asof"]["rid"] if r["asof"] else None) == (want[0] if want else None)
            if want:
                assert r["asof"]["rv"] == want[3]

    check(False, False, lambda a, b: a <= b, max)
    check(True, False, lambda a, b: a < b, max)
    check(False, True, lambda a, b: a >= b, min)
    check(True, True, lambda a, b: a > b, min)

    near = nearest_join(ldf, rdf, ["k"], "t", "rt", ["rid"], F.lit(2), tie=tie, hot_rows=hot)
    for r in near.collect():
        cand = [abs(q[2] - r["t"]) for q in right if q[1] == r["k"] and abs(q[2] - r["t"]) <= 2]
        assert (r["near"] is None) == (not cand)
        if cand:
            assert abs(r["near"]["rt"] - r["t"]) == min(cand)


@pytest.mark.parametrize("hot", [7, 10**9])
def test_intervals(spark, hot):
    rnd = random.Random(7)
    iv = [(rnd.choice("aaab"), s, s + rnd.randrange(0, 12)) for s in
          (rnd.randrange(0, 900) for _ in range(150))]
    df = spark.createDataFrame(iv, "k string, s int, e int")

    def union(items):
        out = []
        for s, e in sorted(x for x in items if x[1] > x[0]):
            if out and s <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([s, e])
        return [tuple(x) for x in out]

    merged = union_intervals(df, ["k"], "s", "e", hot_rows=hot)
    for k in "ab":
        want = union([(s, e) for kk, s, e in iv if kk == k])
        assert sorted((r["s"], r["e"]) for r in merged.where(F.col("k") == k).collect()) == want
    again = union_intervals(merged, ["k"], "s", "e", hot_rows=hot)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))

    base = spark.createDataFrame(
        [(k, i, i * 60, i * 60 + 45) for k in "abz" for i in range(15)], "k string, id int, ls int, le int"
    )
    parts = subtract(base, df, ["k"], "id", 50, "ls", "le", "s", "e", hot_rows=hot).collect()
    got = {}
    for r in parts:
        got.setdefault((r["k"], r["id"]), set()).update(range(r["ls"], r["le"]))
    for k in "abz":
        cover = set()
        for s, e in union([(s, e) for kk, s, e in iv if kk == k]):
            cover.update(range(s, e))
        for i in range(15):
            assert got.get((k, i), set()) == set(range(i * 60, i * 60 + 45)) - cover


@pytest.mark.parametrize("hot", [7, 10**9])
def test_pair_fifo(spark, hot):
    rnd = random.Random(8)
    ev = [(i, rnd.choice("aab"), i // 2, rnd.choice(["o", "c"])) for i in range(200)]
    df = spark.createDataFrame(ev, "id int, k string, t int, e string")
    got = pair_fifo(df, ["k"], "t", ["id"], F.col("e") == "o", F.col("e") == "c", ["id"],
                    hot_rows=hot)
    pairs = {(r["k"], r["open_id"]): r["close_id"] for r in got.collect()}
    for k in "ab":
        queue, want = [], {}
        for i, kk, _, e in ev:
            if kk != k:
                continue
            if e == "o":
                queue.append(i)
                want[i] = None
            elif queue:
                want[queue.pop(0)] = i
        assert {o: c for (kk, o), c in pairs.items() if kk == k} == want


@pytest.mark.parametrize("shape", ["outlier", "bursts"])
def test_blocks_are_even(spark, shape):
    """One far outlier, or nearly all rows in two short bursts: no block over twice its share."""
    n = 4000
    if shape == "outlier":
        times = [*range(n - 1), 10**12]
    else:
        times = [i if i % 2 else 10**9 + i for i in range(n - 40)] + [i * 10**7 for i in range(40)]
    df = spark.createDataFrame([("k", int(t), i) for i, t in enumerate(times)], "k string, t long, id long")
    prof = o.profile(df, ["k"], "t", 250)
    sizes = [r["count"] for r in prof.blocks(df, "t").groupBy("_blk").count().collect()]
    assert sum(sizes) == n and len(sizes) >= 12
    assert max(sizes) <= 2 * 250


def test_borders_in_two_levels():
    for size in (0, 1, 7, 150, 151, 5000):
        cuts = [float(i) for i in range(size)]
        heads, tails = o._two_levels(cuts)
        assert len(tails) == len(heads) + 1 and len(heads) <= o.BORDERS and all(len(x) <= o.BORDERS for x in tails)
        rebuilt = []
        for i, part in enumerate(tails):
            rebuilt += part + heads[i:i + 1]
        assert rebuilt == cuts
