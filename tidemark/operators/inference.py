"""Inference on tables of tests and samples: corrections, folds, distribution distances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import running


def adjust(tests: DataFrame, keys: Sequence[str], p: str, name: str) -> DataFrame:
    """Bonferroni, Holm and Benjamini-Hochberg adjustments of a table of tests.

    ``bh_reference`` is the non-standard variant that ranks from the largest p and carries
    a running maximum. A family holds tens of tests, so one window per family is enough.
    """
    up = Window.partitionBy(*keys).orderBy(p, name)
    down = Window.partitionBy(*keys).orderBy(F.desc(p), F.desc(name))
    whole = Window.partitionBy(*keys)
    one = F.lit(1.0)
    m = F.count(F.lit(1)).over(whole)
    t = tests.withColumns({"_m": m, "_i": F.row_number().over(up), "_j": F.row_number().over(down)})
    pc = F.col(p)
    return t.withColumns({
        "bonferroni": F.least(one, pc * F.col("_m")),
        "holm": F.least(one, F.max(pc * (F.col("_m") - F.col("_i") + 1)).over(up.rowsBetween(Window.unboundedPreceding, 0))),
        "bh": F.least(one, F.min(pc * F.col("_m") / F.col("_i")).over(down.rowsBetween(Window.unboundedPreceding, 0))),
        "bh_reference": F.least(one, F.max(pc * F.col("_m") / F.col("_j")).over(down.rowsBetween(Window.unboundedPreceding, 0))),
    }).drop("_m", "_i", "_j")


def walk_forward(
    canonical: DataFrame, first: int, end: int, window: int, embargo: int = 0, minimum: int = 4,
) -> DataFrame:
    """Expanding training folds: label maturity, embargo and cluster purge as table operations.

    A forecast is validation in the one fold its time falls in and training from the first
    fold whose cut lies behind its time and its label; clusters that occur in a fold's
    validation are removed from its training rows. Rows are counted once, by that first
    fold; folds are running sums of the counts, less those of the purged clusters.
    """
    t = F.col("predicted_us")
    val = canonical.where((t >= first) & (t < end)).withColumn(
        "fold", F.floor((t - F.lit(first)) / F.lit(window)).cast("int")
    )
    purged = val.select("fold", "cluster").distinct()
    candidates = val.groupBy("fold").agg(
        F.count(F.lit(1)).alias("candidates"), F.countDistinct("cluster").alias("clusters"),
        F.count_if(F.col("label_known_us").isNotNull() & (F.col("label_known_us") <= end)).alias("scored"),
    )
    ready = F.greatest(t + F.lit(embargo), F.col("label_known_us"))
    counts = canonical.where(F.col("label_known_us").isNotNull()).groupBy(
        F.greatest(F.lit(0), F.floor((ready - F.lit(first)) / F.lit(window)) + 1).cast("int").alias("fold"), "cluster"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("pos"))

    def upto(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
        """Sums of ``n`` and ``pos`` over folds up to each asked one: a row per fold and key."""
        both = rows.withColumn("ask", F.lit(0)).unionByName(
            asked.withColumns({"n": F.lit(0), "pos": F.lit(0), "ask": F.lit(1)}))
        w = Window.partitionBy(*keys).orderBy("fold", "ask").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumns({"n": F.sum("n").over(w), "pos": F.sum("pos").over(w)}).where("ask = 1").drop("ask")

    totals = upto(counts.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), candidates.select("fold"), [])
    removed = upto(counts, purged, ["cluster"]).groupBy("fold").agg(F.sum("n").alias("gone"), F.sum("pos").alias("gone_pos"))
    training = totals.join(removed, "fold", "left").select(
        "fold", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("training"),
        (F.coalesce("pos", F.lit(0)) - F.coalesce("gone_pos", F.lit(0))).alias("positives"))
    out = candidates.join(training, "fold", "left").withColumn("training", F.coalesce("training", F.lit(0)))
    both = (F.col("positives") > 0) & (F.col("positives") < F.col("training"))
    status = (
        F.when((F.col("training") < minimum) | ~F.coalesce(both, F.lit(False)), "insufficient_data")
        .when(F.col("scored") == 0, "awaiting_labels").otherwise("evaluated")
    )
    return out.select("fold", "candidates", "clusters", "scored", "training", status.alias("status"))


def ks_statistic(df: DataFrame, value: str, is_second: Column, hot_rows: int | None = None) -> DataFrame:
    """Largest distance of two empirical CDFs, from counted values and running sums."""
    counted = df.groupBy(F.col(value).alias("v")).agg(
        F.count_if(~is_second).alias("c1"), F.count_if(is_second).alias("c2")
    ).withColumn("g", F.lit(1))
    cum = running(
        counted, ["g"], "v", [], {"s1": ("sum", F.col("c1")), "s2": ("sum", F.col("c2"))}, hot_rows=hot_rows
    )
    total = counted.agg(F.struct(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"))).scalar()
    gap = F.abs(F.col("s1") / F.col("t.n1") - F.col("s2") / F.col("t.n2"))
    return cum.withColumn("t", total).agg(F.max(gap).alias("ks"))


def binned_shares(df: DataFrame, value: str, is_second: Column, bins: int, lo: Column, hi: Column) -> DataFrame:
    """Share of both samples in equal-width bins; values outside go to the edge bins."""
    width = (hi - lo) / F.lit(float(bins))
    idx = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / F.col("width"))))
    rows = df.withColumns({"lo": lo, "width": width, "second": is_second})
    counts = rows.groupBy(idx.alias("bin")).agg(
        F.count_if(~F.col("second")).alias("c1"), F.count_if("second").alias("c2")
    )
    whole = Window.partitionBy(F.lit(1))  # one row per bin
    return counts.select(
        "bin", (F.col("c1") / F.sum("c1").over(whole)).alias("p"),
        (F.col("c2") / F.sum("c2").over(whole)).alias("q"),
    )


def js_divergence(shares: DataFrame) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    m = (p + q) / F.lit(2.0)

    def part(a):
        return F.when(a > 0, F.lit(0.5) * a * F.ln(a / m)).otherwise(0.0)

    return shares.agg(F.sum(part(p) + part(q)).alias("js"))


def stability_index(shares: DataFrame) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    term = F.when((p > 0) & (q > 0), (q - p) * F.ln(q / p)).otherwise(0.0)
    return shares.agg(F.sum(term).alias("psi"))
