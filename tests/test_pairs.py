"""Pair statistics inside events and resampling, against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.operators import pairs
from tidemark.operators import resampling as rs

SCHEMA = "event int, member string, `order` long, t long, value double"


def sparse_series(seed=4):
    rng = random.Random(seed)
    base = {(e, t): rng.gauss(0, 1) for e in range(3) for t in range(40)}
    rows = []
    for m in range(36):
        event, weight = m % 3, rng.choice([0.0, 0.6, 2.0])
        rows += [(event, f"m{m}", m, t, weight * base[event, t] + rng.gauss(0, 1)) for t in range(40) if rng.random() < 0.8]
    return rows + [(0, "m90", 90, t, 5.0) for t in range(40)] + [(1, "m91", 91, 3, 1.0)]


def by_pair(rows):
    held = defaultdict(dict)
    for event, member, order, t, value in rows:
        held[event, order, member][t] = value
    for (e1, o1, a), x in held.items():
        for (e2, o2, b), y in held.items():
            if e1 == e2 and o1 < o2:
                common = sorted(x.keys() & y.keys())
                yield a, b, common, np.array([x[t] for t in common]), np.array([y[t] for t in common])


def corr(x, y):
    return float(np.corrcoef(x, y)[0, 1]) if len(x) > 1 and x.std() > 1e-9 and y.std() > 1e-9 else math.nan


@pytest.mark.parametrize("block", [4, 256])
def test_correlated_pairs_with_missing_times(spark, block):
    rows = sparse_series()
    want = {(a, b): corr(x, y) for a, b, _, x, y in by_pair(rows) if len(x) >= 3 and abs(corr(x, y)) >= 0.3}
    got = {(r.a, r.b): r.correlation for r in pairs.correlated_pairs(spark.createDataFrame(rows, SCHEMA), 0.3, block=block).collect()}
    assert got.keys() == want.keys() and len(want) > 30
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


@pytest.mark.parametrize("block", [4, 256])
def test_newest_common_times(spark, block):
    rows = sparse_series()
    want = {(a, b): corr(x[-8:], y[-8:]) for a, b, _, x, y in by_pair(rows) if len(x) >= 8}
    got = {(r.a, r.b): (r.n, r.correlation) for r in pairs.latest_correlations(spark.createDataFrame(rows, SCHEMA), 8, block=block).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == 8 and (math.isnan(want[k]) or got[k][1] == pytest.approx(want[k], abs=1e-9)) for k in want)


def test_rolling_windows_share_a_pass(spark):
    rng = random.Random(2)
    rows = [(0, f"m{m}", m, t, 10 + 0.1 * t * (m % 2) + rng.random()) for m in range(6) for t in range(70) if rng.random() < 0.7]
    held = defaultdict(dict)
    for _, member, order, t, value in rows:
        held[order][t] = value
    bars = range(min(r[3] for r in rows), max(r[3] for r in rows) + 1)
    returns = {}
    for m, x in held.items():
        price, out = None, []
        for t in bars:
            now = x.get(t, price)
            out.append(now / price - 1 if price is not None else None)
            price = now
        returns[m] = out
    want = {}
    for a in held:
        for b in held:
            for w in (20, 50):
                for i in range(w - 1, len(bars)):
                    x, y = returns[a][i - w + 1:i + 1], returns[b][i - w + 1:i + 1]
                    if a < b and None not in x and None not in y and abs(c := corr(np.array(x), np.array(y))) >= 0.2:
                        want[f"m{a}", f"m{b}", w, bars[i]] = c
    got = pairs.rolling_correlations(spark.createDataFrame(rows, SCHEMA), (20, 50), 0.2, block=3).collect()
    assert {(r.a, r.b, r.window, r.bar): pytest.approx(r.correlation, abs=1e-8) for r in got} == want and {k[2] for k in want} == {20, 50}


def test_an_event_of_ten_thousand_markets(spark):
    rng = np.random.default_rng(3)
    n, times = 10_000, 12
    value = rng.normal(size=(n, times))
    value[5000:5040] = value[:40] + 0.02 * rng.normal(size=(40, times))
    rows = spark.createDataFrame([(1, f"m{i}", i, t, float(value[i, t])) for i in range(n) for t in range(times)], SCHEMA)
    got = {(r.a, r.b) for r in pairs.correlated_pairs(rows, 0.985, block=512).collect()}
    z = value - value.mean(axis=1, keepdims=True)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    want = set()
    for at in range(0, n, 1000):
        for i, j in zip(*np.nonzero(np.abs(z[at:at + 1000] @ z.T) >= 0.985)):
            if at + i < j:
                want.add((f"m{at + i}", f"m{j}"))
    assert got == want and {(f"m{i}", f"m{i + 5000}") for i in range(40)} <= got


@pytest.mark.parametrize("block", [7, 256])
def test_forest_connects_what_the_links_connect(spark, block):
    series = spark.createDataFrame(sparse_series(), SCHEMA)
    links = pairs.correlated_pairs(series, 0.5).select("a", "b").collect()
    forest = pairs.correlated_forest(series, 0.5, block=block).collect()

    def components(edges):
        root = {}

        def top(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for r in edges:
            root[top(r.a)] = top(r.b)
        groups = defaultdict(set)
        for x in list(root):
            groups[top(x)].add(x)
        return {frozenset(g) for g in groups.values()}

    assert components(forest) == components(links)
    assert len(forest) < len(links)


def test_a_small_event_takes_few_copies(spark):
    """A series is copied once per block of its event: an event of two thousand is one block."""
    rows = spark.range(4000).selectExpr("1 event", "concat('m', id) member", "id `order`", "1L t", "1.0D value")
    assert pairs._dealt(rows, pairs.BLOCK_MEMBERS).count() == 8000


def test_ridge_lines(spark):
    rows = sparse_series()
    want = {}
    for a, b, common, x, y in by_pair(rows):
        weeks = np.array(common) // 7
        if len(x) >= 8 and len(set(weeks)) >= 3:
            w = np.array([1 / (weeks == g).sum() for g in weeks]) / len(set(weeks))
            design = np.stack([np.ones(len(x)), x])
            want[a, b] = np.linalg.solve((design * w) @ design.T + 1e-3 * np.eye(2), (design * w) @ y)
    got = pairs.ridge_pairs(spark.createDataFrame(rows, SCHEMA), lambda t: t // 7, 8, 3, block=5).collect()
    assert {(r.a, r.b): (pytest.approx(r.alpha), pytest.approx(r.beta)) for r in got} == {k: tuple(v) for k, v in want.items()}


def test_vector_sums_equal_drawn_weights(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xyz"), f"c{i % 40}", rng.random(), float(i % 3)) for i in range(300)] + [("x", "hot", 1.0, 2.0)] * 500
    df = spark.createDataFrame(rows, "k string, cluster string, s double, n double").repartition(3)
    names = sorted({r[1] for r in rows})
    weight = dict(zip(names, rs.cluster_weights(names, 600, 7)))
    for keys in (["k"], []):
        got = {tuple(r[k] for k in keys): (r.s, r.n) for r in rs.replicate_sums(df, "cluster", keys, ["s", "n"], 600, 7).collect()}
        want = defaultdict(lambda: np.zeros((2, 600)))
        for k, c, s, n in rows:
            want[(k,) if keys else ()] += np.outer([s, n], weight[c])
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k]) for k in want)
    assert abs(np.mean([w.mean() for w in weight.values()]) - 1) < 0.1


@pytest.mark.parametrize("size", [1, 2, 5, 64, 100, 4097])
def test_bijections(size):
    found = {tuple(rs.bijection(size, rs.round_keys(5, r))) for r in range(1, 6)}
    assert all(sorted(p) == list(range(size)) for p in found) and (size < 60 or len(found) == 5)


@pytest.mark.parametrize("group, block", [([], 7), (["g"], 7), (["g"], 4096)])
def test_permutations_keep_the_values_of_a_group(spark, group, block):
    rows = [("a" if i < 60 else "b" if i < 63 else "c", i, float(i), float(i % 2)) for i in range(64)]
    df = spark.createDataFrame(rows, "g string, id long, p double, y double")
    # With the loss x * y a replicate's total tells labels that moved; with y alone the sum never changes.
    sums = rs.permuted_losses(df, group, ["id"], ["p"], ["y"], lambda p, y: np.stack([y, p * y]), 40, 3, block).collect()
    total = {(r.rep, r.kind): (r.loss, r.n) for r in sums}
    assert len(total) == 80 and all(total[r, 0] == (32.0, 64) for r in range(1, 41))
    moved = [total[r, 1][0] for r in range(1, 41)]
    assert len(set(moved)) > 10
    assert np.mean(moved) == pytest.approx(32 * 31.5, rel=0.05)


def test_groupings_share_one_order_and_slices_deal_as_one(spark, monkeypatch):
    from tidemark.functions.hashing import uniform

    rows = [("a" if i < 600 else "b" if i < 603 else None, f"r{i % 900:03}", float(i), i % 2) for i in range(1000)]
    df = spark.createDataFrame(rows, "g string, id string, p double, y byte").repartition(5)
    drawn = {r.p: r.u for r in df.select("p", uniform(3, df.id, df.p).alias("u")).collect()}
    found = []
    for size in (1 << 20, 50):
        monkeypatch.setattr(rs, "SLICE_ROWS", size)
        held = rs.ranked_blocks(df, [[], ["g"]], ["id", "p"], ["p", "y"], 3, 64).collect()
        found.append({(r["_grouping"], r["_g"], r["_block"]): (r["_n"], r["_size"], list(r["p"]), list(r["y"])) for r in held})
    order = sorted(rows, key=lambda r: (drawn[r[2]], r[1], r[2]))
    want = {}
    for which, name, part in [(0, "", order), (1, "a", [r for r in order if r[0] == "a"]), (1, "b", [r for r in order if r[0] == "b"])]:
        blocks = -(-len(part) // 64)
        for b in range(blocks):
            mine = part[b::blocks]
            want[which, name, b] = (len(part), len(mine), [r[2] for r in mine], [r[3] for r in mine])
    assert found == [want, want]


def test_labels_travel_as_bits():
    flags, other = np.array([0.0, 1, 1, 0, 1, 0, 0, 0, 1]), np.array([0.5, -1.0, np.nan])
    assert len(rs.coded(flags)) == 3 and len(rs.coded(other)) == 25
    for x in (flags, other, np.zeros(0)):
        assert np.array_equal(rs.decoded(rs.coded(x), len(x)), x, equal_nan=True)


@pytest.mark.parametrize("rows, hot", [(50_000, None), (3, None), (3, 4)])
def test_isotonic_hulls_merge_to_the_pooled_fit(spark, rows, hot):
    from tidemark.operators import calibrate as cal

    rng = random.Random(8)
    data = [(round(rng.random(), 2), None) for _ in range(400)]
    data = [(p, int(rng.random() < p * p)) for p, _ in data]
    sums = defaultdict(lambda: [0, 0])
    for p, y in data:
        sums[p][0] += y
        sums[p][1] += 1
    blocks = []  # pool adjacent violators
    for p in sorted(sums):
        blocks.append([p, *sums[p]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    steps = cal.isotonic_steps(spark.createDataFrame(data, "p double, outcome int"), rows, hot).orderBy("start").collect()
    assert [(r.start, r.value) for r in steps] == [(p, pytest.approx(y / n)) for p, y, n in blocks]
    assert cal.isotonic_steps(spark.createDataFrame([], "p double, outcome int")).count() == 0


@pytest.mark.parametrize("block, stretch", [(2048, 65_536), (5, 7)])
def test_fan_out_is_made_where_blocks_meet(spark, block, stretch):
    rng, rows = random.Random(8), sparse_series()
    names = sorted({r[1] for r in rows})
    shocks = {m: [(rng.randrange(60), f"{m}-{i}") for i in range(rng.randrange(4))] for m in names}
    reads = {m: [(rng.randrange(60), None if rng.random() < 0.2 else rng.gauss(0, 1)) for _ in range(rng.randrange(9))] for m in names}
    held = spark.createDataFrame([(m, [t for t, _ in shocks[m]], [i for _, i in shocks[m]], [t for t, _ in reads[m]], [v for _, v in reads[m]]) for m in names if m != "m7"],
                                 "member string, incident_t array<long>, incident_id array<string>, reading_t array<long>, reading array<double>")
    want = {}
    for a, b, common, x, y in by_pair(rows):
        c = corr(x, y)
        if len(common) < 3 or math.isnan(c) or abs(c) < 0.3 or "m7" in (a, b):
            continue
        for source, target in ((a, b), (b, a)):
            for t, i in shocks[source]:
                inside = [v for u, v in reads[target] if t <= u <= t + 10]
                if inside:
                    known = [v for v in inside if v is not None]
                    want[i, target] = (len(inside), sum(known) / len(known) if known else None)
    found = pairs.fan_out(spark.createDataFrame(rows, SCHEMA), held, 0.3, 10, block=block, stretch=stretch).collect()
    assert len(found) == len(want) > 50 and any(n > 0 and m is None for n, m in want.values())
    for r in found:
        n, mean = want[r["id"], r["member"]]
        assert r["n"] == n and (r["mean"] == mean or r["mean"] == pytest.approx(mean))
