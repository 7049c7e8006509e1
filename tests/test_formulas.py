"""Literal cases, brute-force checks and properties of the column formulas."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import book as bk
from tidemark.functions import pricing as pr
from tidemark.functions import scoring as sc
from tidemark.functions.hashing import normal, poisson_one, uniform
from tidemark.functions.stats import normal_cdf, two_sided_p
from tidemark.operators import calibrate as cal
from tidemark.operators import inference as inf
from tidemark.operators import resampling as rs
from tidemark.operators import graph, intervals, scores
from tidemark.operators.graph import connected_components
from tidemark.operators.drift import START, adaptive_window, page_hinkley
from tidemark.operators.sequences import BookSide
from tidemark.plans.execution import basket
from tidemark.plans.inference import mahalanobis
from tidemark.plans.pit import canonical
from tidemark.session import checkpointed


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def lit(x):
    return F.lit(float(x))


def levels(pairs):
    return F.array(*[F.struct(lit(p).alias("price"), lit(q).alias("size")) for p, q in pairs])


def test_fees(spark):
    assert one(spark, bk.taker_fee(lit(100), lit(0.5), lit(0.02))) == 0.5
    assert one(spark, bk.taker_fee(lit(0.03), lit(0.5), lit(0.0027))) == pytest.approx(0.00002, abs=1e-9)
    # an exact half goes up, at both sides of 1/2 the fee is the same
    assert one(spark, bk.taker_fee(lit(1), lit(0.5), lit(0.00002))) == 0.00001
    for p in (0.1, 0.23, 0.4):
        assert one(spark, bk.taker_fee(lit(7), lit(p), lit(0.05))) == one(spark, bk.taker_fee(lit(7), lit(1 - p), lit(0.05)))
    assert one(spark, bk.order_fee_cents(lit(1), lit(0.5), lit(0.07))) == 0.02
    assert one(spark, bk.order_fee_cents(lit(100), lit(0.5), lit(0.04))) == 1.0


def test_walk(spark):
    asks = levels([(0.40, 10), (0.42, 5), (0.50, 100)])
    w = one(spark, bk.walk(asks, lit(20), lit(0.0)))
    assert w["filled"] == 20 and w["levels"] == 3
    assert w["notional"] == pytest.approx(0.40 * 10 + 0.42 * 5 + 0.50 * 5)
    w = one(spark, bk.walk(asks, lit(20), lit(0.0), limit=lit(0.45)))
    assert w["filled"] == 15 and w["levels"] == 2
    w = one(spark, bk.walk(asks, lit(1000), lit(0.0)))
    assert w["filled"] == 115


def test_basket_surplus(spark):
    """Four legs at 0.39, 0.32, 0.17 and 0.08, 100 shares, no fees: -0.80 after buffers."""
    legs = spark.createDataFrame(
        [("r", a, 0.0, 0) for a in (0.39, 0.32, 0.17, 0.08)], "rule string, ask double, fee_rate double, ts_us long"
    )
    got = basket(legs, ["rule"], 100.0).first()
    assert got["net_surplus"] == pytest.approx(-0.80) and got["legs"] == 4 and not got["asynchronous"]


def test_book_features(spark):
    f = bk.features(levels([(0.40, 10), (0.39, 30)]), levels([(0.44, 20), (0.45, 20)]))
    row = spark.range(1).select(*[c.alias(n) for n, c in f.items()]).first()
    assert row["midpoint"] == pytest.approx(0.42)
    assert row["microprice"] == pytest.approx((0.44 * 10 + 0.40 * 20) / 30)
    assert row["imbalance"] == 0.0 and row["bid_concentration"] == pytest.approx((100 + 900) / 1600)
    empty = one(spark, bk.mid(F.array().cast("array<struct<price:double,size:double>>"), levels([(0.4, 1)])))
    assert empty is None


@pytest.mark.parametrize("p,price", [(0.6, 0.5), (0.4, 0.5), (0.99, 0.01), (0.5, 1.0), (1.2, 0.5)])
def test_kelly(spark, p, price):
    got = one(spark, pr.kelly(lit(p), lit(price)))
    want = max(0.0, min(1.0, (p - price) / (1 - price))) if 0 < price < 1 and 0 <= p <= 1 else 0.0
    assert got == pytest.approx(want) and 0 <= got <= 1


def test_probability_formulas(spark):
    assert one(spark, pr.logit(lit(0.0))) is None and one(spark, pr.logit(lit(1.0))) is None
    assert one(spark, pr.sigmoid(pr.logit(lit(0.3)))) == pytest.approx(0.3)
    assert one(spark, pr.bayes(lit(0.5), lit(3))) == pytest.approx(0.75)
    assert one(spark, pr.bayes(lit(0.5), lit(-1))) == 0.5
    assert one(spark, pr.resolution_penalty(lit(0.1), lit(0.2), lit(200))) == pytest.approx(0.01 + 0.015 + 0.01)
    assert one(spark, pr.liquidity_penalty(lit(0), lit(5))) == 0.01
    assert one(spark, pr.stale_penalty(lit(90))) == pytest.approx(0.006)
    for z in (-3.0, -1.0, 0.0, 0.5, 2.5):
        assert one(spark, normal_cdf(lit(z))) == pytest.approx(0.5 * (1 + math.erf(z / math.sqrt(2))), abs=2e-7)
    assert one(spark, two_sided_p(lit(1.959964))) == pytest.approx(0.05, abs=1e-6)


def test_draws(spark):
    d = spark.range(20000).select(
        uniform(1, F.col("id")).alias("u"), poisson_one(uniform(2, F.col("id"))).alias("w"),
        normal(uniform(3, F.col("id")), uniform(4, F.col("id"))).alias("z"),
    ).agg(
        F.avg("u").alias("u"), F.avg("w").alias("w"), F.var_pop("w").alias("wv"), F.avg("z").alias("z"),
        F.stddev_pop("z").alias("zs"), F.min("u").alias("lo"), F.max("u").alias("hi"),
    ).first()
    assert abs(d["u"] - 0.5) < 0.01 and abs(d["w"] - 1) < 0.03 and abs(d["wv"] - 1) < 0.05
    assert abs(d["z"]) < 0.03 and abs(d["zs"] - 1) < 0.03 and 0 <= d["lo"] and d["hi"] < 1


def test_scores_and_reliability(spark):
    rows = [(0.2, 0), (0.8, 1), (0.6, 0), (1.0, 1), (0.05, 0)]
    df = spark.createDataFrame(rows, "p double, y int")
    table = {r["bin"]: r for r in scores.reliability_table(df, "p", "y").collect()}
    assert len(table) == 10 and table[9]["n"] == 1 and table[3]["n"] == 0 and table[3]["predicted"] is None
    got = scores.ece(df, "p", "y").first()["ece"]
    assert got == pytest.approx((0.2 + 0.2 + 0.6 + 0.0 + 0.05) / 5) and 0 <= got <= 1


def test_adjustments(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.2]
    df = spark.createDataFrame([(1, f"t{i}", p) for i, p in enumerate(ps)], "f int, name string, p double")
    got = {r["name"]: r for r in inf.adjust(df, ["f"], "p", "name").collect()}
    m, order = len(ps), sorted(range(len(ps)), key=lambda i: ps[i])
    holm, run = {}, 0.0
    for rank, i in enumerate(order):
        run = max(run, min(1.0, ps[i] * (m - rank)))
        holm[i] = run
    bh, run = {}, 1.0
    for rank in range(m - 1, -1, -1):
        i = order[rank]
        run = min(run, ps[i] * m / (rank + 1))
        bh[i] = run
    for i in range(m):
        assert got[f"t{i}"]["holm"] == pytest.approx(holm[i])
        assert got[f"t{i}"]["bh"] == pytest.approx(bh[i])
        assert got[f"t{i}"]["bonferroni"] == pytest.approx(min(1.0, ps[i] * m))


def test_bootstrap_covers_the_mean(spark):
    rnd = random.Random(5)
    rows = [(f"c{i}", rnd.gauss(1.0, 0.5), 1) for i in range(60)]
    df = spark.createDataFrame(rows, "event_cluster string, s double, n int")
    out = rs.bootstrap(df, "event_cluster", ["s", "n"], F.try_divide, 500).first()
    se = np.std([r[1] for r in rows]) / math.sqrt(60)
    assert out["ci_lower"] < out["estimate"] < out["ci_upper"]
    assert out["std_error"] == pytest.approx(se, rel=0.25)


def test_canonical_forecasts(spark):
    rows = [
        ("a", "x", 10, "1", None, 0.2, None), ("a", "x", 20, "2", 50, 0.7, 1), ("a", "x", 10, "0", 60, 0.3, 1),
        ("b", "x", 5, "1", None, 0.5, None), ("c", "x", 5, "1", 9, 0.5, 0), ("c", "y", 6, "1", 8, 0.6, 1),
    ]
    df = spark.createDataFrame(rows, "market_id string, cluster string, predicted_us long, rid string, label_known_us long, p double, outcome int")
    got = {r["market_id"]: r for r in canonical(df).collect()}
    assert got["a"]["p"] == 0.3 and got["a"]["label_known_us"] == 50 and got["a"]["forecast_conflict"]
    assert got["b"]["outcome"] is None and not got["b"]["label_conflict"]
    assert got["c"]["cluster_conflict"] and got["c"]["label_conflict"]


def test_platt_against_newton(spark):
    rnd = np.random.default_rng(3)
    p = rnd.uniform(0.05, 0.95, 300)
    y = (rnd.uniform(size=300) < p**1.5).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, outcome int")
    a, b = cal.platt_fit(df)
    x, w = np.log(p / (1 - p)), np.zeros(2)
    X = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        q = 1 / (1 + np.exp(-X @ w))
        grad = X.T @ (q - y) + np.array([0.0, w[1]])
        w -= np.linalg.solve(X.T @ (X * (q * (1 - q))[:, None]) + np.diag([0.0, 1.0]), grad)
    assert a == pytest.approx(w[0], abs=1e-3) and b == pytest.approx(w[1], abs=1e-3)


def test_temperature_equals_full_grid(spark):
    rnd = np.random.default_rng(4)
    for power in (0.5, 1.0, 3.0):
        p = rnd.uniform(0.02, 0.98, 200)
        truth = 1 / (1 + np.exp(-np.log(p / (1 - p)) * power))
        y = (rnd.uniform(size=200) < truth).astype(int)
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, outcome int")

        def nll(t):
            q = np.clip(1 / (1 + np.exp(-np.log(p / (1 - p)) / t)), 1e-12, 1 - 1e-12)
            return float(-np.mean(np.where(y == 1, np.log(q), np.log(1 - q))))

        want = min(range(10, 500), key=lambda k: (round(nll(k / 100), 12), k))
        assert cal.temperature(df).first()["temperature"] == want / 100


def test_isotonic_monotone(spark):
    rnd = np.random.default_rng(6)
    p = np.round(rnd.uniform(0, 1, 400), 2)
    y = (rnd.uniform(size=400) < p).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, outcome int")
    steps = cal.isotonic_steps(df)
    out = cal.isotonic_predict(df.select("p").distinct(), steps).orderBy("p").collect()
    q = [r["q"] for r in out]
    assert all(a <= b + 1e-12 for a, b in zip(q, q[1:])) and 0 <= min(q) and max(q) <= 1


def test_mahalanobis_full_dimension(spark):
    rnd = np.random.default_rng(7)
    x = rnd.normal(size=(200, 5)) @ rnd.normal(size=(5, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id int, embedding array<double>")
    got = {r["vec_id"]: r for r in mahalanobis(df).collect()}
    inv, mu = np.linalg.inv(np.cov(x.T)), x.mean(axis=0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", x - mu, inv, x - mu))
    assert all(got[i]["score"] == pytest.approx(want[i]) for i in range(200))
    assert sum(r["flagged"] for r in got.values()) == 200 - (int(0.95 * 200) + 1)


def test_components(spark):
    rnd = random.Random(8)
    edges = [(f"n{rnd.randrange(80):03d}", f"n{rnd.randrange(80):03d}") for _ in range(60)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]  # a long path
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    assert got == {x: find(x) for x in parent}


def test_components_of_stars_need_no_round(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(graph, "checkpointed", lambda df: stored.append(1) or checkpointed(df))
    stars = spark.createDataFrame([(i, i % 3) for i in range(3, 40)] + [(5, 2), (1, 1)], "a long, b long")
    assert {r["node"]: r["component"] for r in connected_components(stars, "a", "b").collect()} == {i: i % 3 for i in range(40)}
    assert len(stored) == 1  # the edges only
    chain = spark.createDataFrame([(4, 3), (3, 2), (9, 8), (7, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(chain, "a", "b").collect()}
    assert got == {4: 2, 3: 2, 2: 2, 9: 7, 8: 7, 7: 7} and len(stored) > 2


def test_covered_time(spark):
    w = spark.createDataFrame([("a", 1, 10, 50), ("a", 2, 0, 5), ("b", 3, 0, 100), ("a", 4, 45, 80)], "k string, id int, ws long, we long")
    g = spark.createDataFrame([("a", 12, 20), ("a", 18, 30), ("a", 40, 60), ("b", 50, 60)], "k string, s long, e long")
    for hot in (1, 10**9):
        got = {r["id"]: r["covered"] for r in intervals.covered_time(w, g, ["k"], "ws", "we", "s", "e", hot_rows=hot).collect()}
        assert got == {1: 28, 2: 0, 3: 10, 4: 15}


def test_detectors():
    step = np.array([0.0] * 50 + [1.0] * 50)
    flags, _ = page_hinkley(step, START, 5.0, warmup=10, slack=0.0)
    assert not flags[:50].any() and flags[50:].any()
    state, pieces = START, []
    for part in np.array_split(step, 7):  # the state carries over
        out, state = page_hinkley(part, state, 5.0, warmup=10, slack=0.0)
        pieces.append(out)
    assert (np.concatenate(pieces) == flags).all()
    flags, buckets = adaptive_window(np.array([0.1] * 600 + [0.9] * 600), [])
    assert not flags[:600].any() and flags[600:640].any() and len(buckets) < 60
    assert all(abs(s / n - 0.9) < 1e-9 for n, s in buckets)


def test_adaptive_window_against_a_plain_one(monkeypatch):
    """With buckets that never merge the borders are all cuts of the window."""
    monkeypatch.setattr("tidemark.operators.drift.PER_SIZE", 10**9)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(m, 0.1, 60) for m in (0.2, 0.7, 0.4)])
    flags, _ = adaptive_window(values, [])
    window, want = [], []
    for x in values:
        window.append(x)
        n, alarm = len(window), False
        for cut in range(5, n - 5):
            gap = abs(np.mean(window[:cut]) - np.mean(window[cut:]))
            if gap >= math.sqrt(math.log(4 / 0.002) / 2 * (1 / cut + 1 / (n - cut))):
                window, alarm = window[cut:], True
                break
        want.append(alarm)
    assert flags.tolist() == want and any(want)


def test_book_side_rules():
    s = BookSide([0.4, 0.39], [10.0, 5.0])
    assert s.apply(0.4, -10.0) and 0.4 not in s.levels
    assert not s.apply(0.39, -6.0) and s.levels[0.39] == 5.0
    assert s.apply(0.41, 3.0) and s.top() == (0.41, 8.0)


def test_buckets(spark):
    vals = [(0.0,), (0.01,), (0.1999999,), (0.2,), (5.0,)]
    got = [r["b"] for r in spark.createDataFrame(vals, "x double").select(
        sc.bucket(F.col("x"), sc.DISAGREEMENT_EDGES).alias("b")).collect()]
    assert got == ["0-1%", "1-2%", "15-20%", ">20%", ">20%"]
    assert one(spark, sc.unit_bin(lit(1.0))) == 9
    assert one(spark, sc.ttr_bucket(lit(168))) == ">=168h"
