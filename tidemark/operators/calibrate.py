"""Calibrators and ensemble weights."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import pricing as pr
from tidemark.operators.asof import asof_join
from tidemark.operators.ordered import running
from tidemark.session import checkpointed


HULL_ROWS, HULL_FAN = 50_000, 16


def lower_hull(w: np.ndarray, s: np.ndarray) -> list[int]:
    """Indices of the vertices of the greatest convex minorant of points sorted by ``w``."""
    held: list[int] = []
    for i in range(len(w)):
        while len(held) > 1 and (s[held[-1]] - s[held[-2]]) * (w[i] - w[held[-2]]) >= (s[i] - s[held[-2]]) * (w[held[-1]] - w[held[-2]]):
            held.pop()
        held.append(i)
    return held


def isotonic_steps(train: DataFrame, rows: int = HULL_ROWS, hot_rows: int | None = None) -> DataFrame:
    """Isotonic fit as a step table (start, value).

    Equal probabilities are pooled first. The fit is the slope of the convex minorant of the
    cumulative outcomes over the cumulative counts: running sums give its points, blocks of
    neighbouring points keep their own hull's vertices, and hulls of neighbouring blocks are
    merged, sixteen at a time, until one is left. Only vertices move, and what the last merge
    holds is the fit itself. An empty table has no steps.
    """
    pooled = train.groupBy("p").agg(F.sum(F.col("outcome").cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("n")).withColumn("_g", F.lit(1))
    points = running(pooled, ["_g"], "p", [], {"s": ("sum", F.col("y")), "w": ("sum", F.col("n")), "k": ("count", None), "after": ("lead", F.col("p"))}, hot_rows=hot_rows)
    # The origin starts the first step, at the smallest probability.
    origin = pooled.agg(F.min("p").alias("after"), F.count(F.lit(1)).alias("_n")).where("_n > 0").select(
        F.lit(0.0).alias("w"), F.lit(0.0).alias("s"), "after", F.lit(0).cast("long").alias("block"))
    hull = points.select("w", "s", "after", F.floor(F.col("k") / rows).cast("long").alias("block")).unionByName(origin)

    def vertices(table: pa.Table) -> pa.Table:
        table = table.sort_by("w")
        return table.take(pa.array(lower_hull(table.column("w").to_numpy(), table.column("s").to_numpy())))

    blocks = pooled.count() // rows + 1
    while True:
        hull = checkpointed(hull.groupBy("block").applyInArrow(vertices, hull.schema))
        if blocks == 1:
            break
        blocks = -(-blocks // HULL_FAN)
        hull = hull.withColumn("block", F.floor(F.col("block") / HULL_FAN).cast("long"))
    ends = running(hull.withColumn("_g", F.lit(1)), ["_g"], "w", [], {"w2": ("lead", F.col("w")), "s2": ("lead", F.col("s"))}, hot_rows=hot_rows)
    return ends.where("w2 is not null").select(F.col("after").alias("start"), ((F.col("s2") - F.col("s")) / (F.col("w2") - F.col("w"))).alias("value"))


def isotonic_predict(df: DataFrame, steps: DataFrame) -> DataFrame:
    """Left-continuous step prediction ``q``; below the first block its value applies."""
    first = steps.agg(F.min_by("value", "start").alias("v")).scalar()
    probes = df.withColumn("_g", F.lit(1))
    out = asof_join(probes, steps.withColumn("_g", F.lit(1)), ["_g"], "p", "start", ["value"], name="_s", tie=F.col("value"))
    return out.withColumn("q", F.coalesce("_s.value", first)).drop("_s", "_g")


def platt_fit(train: DataFrame, c: float = 1.0):
    """Logistic fit on the clamped logit with an L2 penalty of strength 1/C."""
    rows = train.select(
        pr.logit(F.col("p"), 1e-9).alias("x"), F.col("outcome").cast("double").alias("label")
    )
    n = rows.count()
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    model = LogisticRegression(
        regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10
    ).fit(data)
    return float(model.intercept), float(model.coefficients[0])


def platt_predict(p: Column, intercept: float, slope: float) -> Column:
    return pr.sigmoid(F.lit(intercept) + F.lit(slope) * pr.logit(p, 1e-9))


def temperature(train: DataFrame) -> DataFrame:
    """Best temperature on the grid 0.10 .. 4.99 by mean negative log likelihood.

    From T = 0.5 on no likelihood term reaches its clip, so the loss is convex in 1/T and
    a coarse pass followed by the neighbourhood of its minimum is exact; below 0.5 every
    grid point is evaluated.
    """
    rows = train.select(pr.logit(F.col("p"), 1e-6).alias("x"), "outcome")
    q = pr.clamp(pr.sigmoid(F.col("x") / (F.col("t") / F.lit(100.0))), 1e-12, 1 - 1e-12)
    loss = -F.when(F.col("outcome") == 1, F.ln(q)).otherwise(F.ln(F.lit(1.0) - q))

    def best(points: list[int]) -> tuple[float, int]:
        # rows meet the grid inside the map task; one number per point leaves it
        grid = rows.withColumn("t", F.explode(F.array(*[F.lit(t) for t in points])))
        found = grid.groupBy("t").agg(F.round(F.avg(loss), 12).alias("nll")).collect()
        return min((r["nll"], r["t"]) for r in found)

    first = best([*range(10, 50), *range(50, 500, 10), 499])
    if first[1] >= 50:
        near = range(max(10, first[1] - 9), min(499, first[1] + 9) + 1)
        first = min(first, best(list(near)))
    return train.sparkSession.createDataFrame([(first[1] / 100.0, first[0])], "temperature double, nll double")


def ensemble_weights(df: DataFrame, components: list[str], step: int) -> DataFrame:
    """Weights on the simplex grid (1/step) with the lowest Brier score.

    The Brier score of a weighted mean is a quadratic form, so one pass for the second
    moments replaces a scan of the rows per grid point.
    """
    y = F.col("outcome").cast("double")
    pairs = list(itertools.combinations_with_replacement(components, 2))
    moments = df.agg(
        *[F.avg(F.col(a) * F.col(b)).alias(f"m_{a}_{b}") for a, b in pairs],
        *[F.avg(F.col(a) * y).alias(f"y_{a}") for a in components], F.avg(y * y).alias("yy"),
    )
    points = [w for w in itertools.product(range(step + 1), repeat=len(components)) if sum(w) == step]
    names = [f"w_{a}" for a in components]
    grid = F.explode(F.array(*[
        F.struct(*[F.lit(v / step).alias(n) for v, n in zip(w, names)]) for w in points
    ])).alias("g")
    rows = moments.select("*", grid)
    weight = {a: F.col(f"g.w_{a}") for a in components}
    score = F.col("yy")
    for a, b in pairs:
        factor = 1.0 if a == b else 2.0
        score = score + F.lit(factor) * weight[a] * weight[b] * F.col(f"m_{a}_{b}")
    for a in components:
        score = score - F.lit(2.0) * weight[a] * F.col(f"y_{a}")
    best = F.min(F.struct(F.round(score, 12).alias("brier"), *[F.col(f"g.{n}").alias(n) for n in names]))
    return rows.agg(best.alias("b")).select("b.*")
