"""Forecast scoring over snapshot tables: every report is one or two partial aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import col

from tidemark.functions import scoring as sc
from tidemark.operators.ordered import running
from tidemark.session import checkpointed



def resolved(df: DataFrame) -> DataFrame:
    return df.where(F.col("outcome").isNotNull() & F.col("mid").isNotNull())


def hit(p, y):
    return ((p >= 0.5) == (y == 1)).cast("int")


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 10, keys: Sequence[str] = ()):
    """Reliability bins that occur: count, mean forecast and mean outcome per bin."""
    return (
        df.withColumn("bin", sc.unit_bin(F.col(p), bins))
        .groupBy(*keys, "bin")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(p).alias("sum_p"),
            F.sum(F.col(y).cast("double")).alias("sum_y"),
        )
    )


def ece(df: DataFrame, p: str, y: str, bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Expected calibration error per group: bins first, then a weighted sum of bins."""
    gap = F.abs(F.col("sum_p") / F.col("n") - F.col("sum_y") / F.col("n"))
    return calibration_bins(df, p, y, bins, keys).groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(gap * F.col("n")) / F.sum("n")).alias("ece")
    )


def reliability_table(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Dense reliability table: empty bins keep a row with null means."""
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(calibration_bins(df, p, y, bins), "bin", "left").select(
        "bin",
        (F.col("bin") / F.lit(float(bins))).alias("lower"),
        ((F.col("bin") + 1) / F.lit(float(bins))).alias("upper"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        (F.col("sum_p") / F.col("n")).alias("predicted"),
        (F.col("sum_y") / F.col("n")).alias("observed"),
    )


def brier(df: DataFrame) -> DataFrame:
    micro = sc.microprice(F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size"))
    return resolved(df).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(sc.squared_error(col("model_p"), col("outcome"))).alias("model_brier"),
        F.avg(sc.squared_error(col("mid"), col("outcome"))).alias("market_brier"),
        F.avg(sc.squared_error(micro, col("outcome"))).alias("micro_brier"),
    )


def log_losses(df: DataFrame) -> DataFrame:
    return resolved(df).agg(
        F.avg(sc.log_loss_term(col("model_p"), col("outcome"))).alias("model_log_loss"),
        F.avg(sc.log_loss_term(col("mid"), col("outcome"))).alias("market_log_loss"),
        F.avg(sc.log_loss_term(col("model_p"), col("outcome"), 1e-12)).alias("model_log_loss_calibration"),
    )


def market_benchmark(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Model against midpoint and microprice: one pass over sufficient statistics.

    Rows are reduced to (model bin, market bin) sums first, so both ECEs and all the
    means come out of the same shuffle of at most 100 rows per group.
    """
    micro = sc.microprice(F.col("bid"), F.col("ask"), F.col("bid_size"), F.col("ask_size"))
    me, ke = F.abs(col("model_p") - col("outcome")), F.abs(col("mid") - col("outcome"))
    y = col("outcome").cast("double")
    cells = (
        resolved(df)
        .withColumns({"pb": sc.unit_bin(col("model_p")), "mb": sc.unit_bin(col("mid")), "micro": micro})
        .groupBy(*keys, "pb", "mb")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(col("model_p")).alias("sp"), F.sum(col("mid")).alias("sm"),
            F.sum(y).alias("sy"), F.sum("micro").alias("sx"),
            F.sum(sc.squared_error(col("model_p"), col("outcome"))).alias("bp"), F.sum(sc.squared_error(col("mid"), col("outcome"))).alias("bm"),
            F.sum(sc.squared_error(F.col("micro"), col("outcome"))).alias("bx"),
            F.sum(sc.log_loss_term(col("model_p"), col("outcome"))).alias("lp"), F.sum(sc.log_loss_term(col("mid"), col("outcome"))).alias("lm"),
            F.count_if(ke < me).alias("market_wins"), F.count_if(me < ke).alias("model_wins"),
            F.count_if(me == ke).alias("ties"),
        )
    )
    sums = ["n", "sp", "sm", "sy", "sx", "bp", "bm", "bx", "lp", "lm",
            "market_wins", "model_wins", "ties"]

    def marginal(b: str, s: str, name: str) -> DataFrame:
        bins = cells.groupBy(*keys, b).agg(F.sum(s).alias("s"), F.sum("sy").alias("y"))
        return bins.groupBy(*keys).agg(F.sum(F.abs(F.col("s") - F.col("y"))).alias(name))

    total = cells.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    pe, ke_ = marginal("pb", "sp", "ep"), marginal("mb", "sm", "em")
    if keys:
        joined = total.join(pe, list(keys)).join(ke_, list(keys))
    else:
        joined = total.withColumns({"ep": pe.scalar(), "em": ke_.scalar()})
    n = F.col("n")
    return joined.select(
        *keys,
        n.alias("resolved_count"),
        (F.col("bm") / n).alias("market_brier"), (F.col("bp") / n).alias("model_brier"),
        ((F.col("bm") - F.col("bp")) / n).alias("delta_brier"),
        (F.col("lm") / n).alias("market_log_loss"), (F.col("lp") / n).alias("model_log_loss"),
        ((F.col("lm") - F.col("lp")) / n).alias("delta_log_loss"),
        (F.col("em") / n).alias("market_ece"), (F.col("ep") / n).alias("model_ece"),
        ((F.col("em") - F.col("ep")) / n).alias("delta_ece"),
        (F.col("sx") / n).alias("market_microprice"),
        ((F.col("bx") - F.col("bp")) / n).alias("delta_brier_microprice"),
        "market_wins", "model_wins", "ties",
        (F.col("sm") / n).alias("market_predicted_mean"),
        (F.col("sp") / n).alias("model_predicted_mean"),
        (F.col("sy") / n).alias("outcome_mean"),
    )


def _duel():
    """Aggregates that compare the model with the market."""
    me, ke = F.abs(col("model_p") - col("outcome")), F.abs(col("mid") - col("outcome"))
    return [
        F.count(F.lit(1)).alias("n"),
        F.avg(sc.squared_error(col("model_p"), col("outcome"))).alias("model_brier"),
        F.avg(sc.squared_error(col("mid"), col("outcome"))).alias("market_brier"),
        F.count_if(me < ke).alias("model_wins"),
        F.count_if(ke < me).alias("market_wins"),
        F.count_if(me == ke).alias("ties"),
        F.avg(col("outcome")).alias("mean_outcome"),
    ]


def model_market_matrix(df: DataFrame, buckets: int = 5) -> DataFrame:
    """Comparison per model-probability bucket plus the overall row (bucket -1)."""
    return (
        resolved(df)
        .withColumn("bucket", sc.unit_bin(col("model_p"), buckets))
        .rollup("bucket")
        .agg(*_duel())
        .withColumn("bucket", F.coalesce("bucket", F.lit(-1)))
        .withColumn("delta_brier", F.col("market_brier") - F.col("model_brier"))
    )


def disagreement(df: DataFrame) -> DataFrame:
    gap = F.abs(col("model_p") - col("mid"))
    return (
        resolved(df)
        .withColumn("bucket", sc.bucket(gap, sc.DISAGREEMENT_EDGES))
        .groupBy("bucket")
        .agg(
            *_duel()[:3],
            F.avg(hit(col("model_p"), col("outcome"))).alias("win_rate"), F.avg(hit(col("mid"), col("outcome"))).alias("market_correct"),
            F.avg(col("model_p")).alias("mean_model"), F.avg(col("mid")).alias("mean_mid"), F.avg(col("outcome")).alias("mean_outcome"),
            F.avg(F.coalesce("hours", F.lit(0.0))).alias("holding_hours"),
        )
    )


def disagreement_summary(df: DataFrame) -> DataFrame:
    gap = F.abs(col("model_p") - col("mid"))
    return resolved(df).agg(
        F.avg(gap).alias("total_disagreement"),
        F.coalesce(F.corr(gap, hit(col("model_p"), col("outcome")).cast("double")), F.lit(0.0)).alias("correlation"),
    )


def horizon_buckets(df: DataFrame) -> DataFrame:
    """Scores per time-to-resolution bucket; a missing mid falls back to the model per row."""
    hours = (F.col("resolved_us") - F.col("ts_us")) / F.lit(3.6e9)
    mid = F.coalesce(col("mid"), col("model_p"))
    lo = sc.bucket(hours, [(a, b, str(float(a))) for a, b, _ in sc.HORIZON_EDGES]).cast("double")
    hi = sc.bucket(
        hours, [(a, b, str(float(b if b != float("inf") else a + 500))) for a, b, _ in sc.HORIZON_EDGES]
    ).cast("double")
    return (
        df.where(F.col("outcome").isNotNull() & F.col("resolved_us").isNotNull() & (hours >= 0))
        .withColumns({
            "bucket": sc.bucket(hours, sc.HORIZON_EDGES),
            "midpoint": (lo + hi) / F.lit(2.0),
        })
        .groupBy("bucket", "midpoint")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(sc.squared_error(col("model_p"), col("outcome"))).alias("model_brier"),
            F.avg(sc.squared_error(mid, col("outcome"))).alias("market_brier"),
            F.avg(hit(col("model_p"), col("outcome"))).alias("directional_accuracy"),
            F.avg(col("model_p")).alias("mean_model"), F.avg(mid).alias("mean_mid"),
            F.avg(col("outcome")).alias("mean_outcome"),
        )
    )


def horizon_summary(df: DataFrame) -> DataFrame:
    b = horizon_buckets(df)
    return b.agg(
        F.count(F.lit(1)).alias("buckets"),
        F.coalesce(F.regr_slope("model_brier", "midpoint"), F.lit(0.0)).alias("decay_rate"),
        F.min_by("bucket", "model_brier").alias("best_horizon"),
        F.max_by("bucket", "model_brier").alias("worst_horizon"),
    )


def categories(df: DataFrame) -> DataFrame:
    """Scores per category. Sums per (category, cluster, bin) feed every output."""
    mid = F.coalesce(F.nullif(col("mid"), F.lit(0.0)), col("model_p"))
    cells = (
        df.where(F.col("outcome").isNotNull())
        .withColumn("bin", sc.unit_bin(col("model_p")))
        .groupBy("category", "event_cluster", "bin")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(col("model_p")).alias("sp"),
            F.sum(col("outcome").cast("double")).alias("sy"),
            F.sum(sc.squared_error(col("model_p"), col("outcome"))).alias("bp"), F.sum(sc.squared_error(mid, col("outcome"))).alias("bm"),
            F.sum(sc.log_loss_term(col("model_p"), col("outcome"))).alias("lp"), F.sum(hit(col("model_p"), col("outcome"))).alias("hits"),
            F.count_if("filled").alias("filled"),
        )
    )
    bins = cells.groupBy("category", "bin").agg(
        *[F.sum(c).alias(c) for c in ("n", "sp", "sy", "bp", "bm", "lp", "hits", "filled")]
    )
    clusters = cells.groupBy("category").agg(F.countDistinct("event_cluster").alias("clusters"))
    n = F.sum("n")
    per = bins.groupBy("category").agg(
        n.alias("n"), (F.sum("bp") / n).alias("model_brier"), (F.sum("bm") / n).alias("market_brier"),
        (F.sum("lp") / n).alias("log_loss"),
        (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"),
        (F.sum("hits") / n).alias("directional_accuracy"), (F.sum("sp") / n).alias("mean_model"),
        (F.sum("sy") / n).alias("mean_outcome"), (F.sum("filled") / n).alias("fill_rate"),
    )
    return per.join(clusters, "category").withColumn(
        "delta_brier", F.col("market_brier") - F.col("model_brier")
    )


def category_summary(df: DataFrame) -> DataFrame:
    """Best and worst category by Brier improvement and the count-weighted delta."""
    return categories(df).agg(
        F.max_by("category", "delta_brier").alias("best_category"),
        F.min_by("category", "delta_brier").alias("worst_category"),
        (F.sum(F.col("delta_brier") * F.col("n")) / F.sum("n")).alias("overall_delta_brier"),
    )


def regime_buckets(df: DataFrame, value: str, edges) -> DataFrame:
    """Liquidity or spread regimes with the efficiency flag (|delta Brier| < 0.01)."""
    edge = col("model_p") - F.coalesce(col("mid"), F.lit(0.5))
    pnl = F.when(edge > 0, edge - F.col("spread") / F.lit(2.0)).otherwise(0.0)
    depth = F.col("bid_size") + F.col("ask_size")
    return (
        df.withColumn("bucket", sc.bucket(F.col(value), edges))
        .where("bucket is not null")
        .groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.avg(sc.squared_error(col("model_p"), col("outcome"))), F.lit(0.0)).alias("model_brier"),
            F.coalesce(F.avg(sc.squared_error(col("mid"), col("outcome"))), F.lit(0.0)).alias("market_brier"),
            F.avg("spread").alias("avg_spread"), F.avg(depth).alias("avg_depth"),
            F.avg("net_edge").alias("net_edge"),
            F.coalesce(F.avg(F.when(col("outcome").isNotNull(), pnl)), F.lit(0.0)).alias("realized_pnl"),
        )
        .withColumn("delta_brier", F.col("market_brier") - F.col("model_brier"))
        .withColumn("is_efficient", F.abs(F.col("delta_brier")) < 0.01)
    )


def sampling_hierarchy(df: DataFrame) -> DataFrame:
    """Rows, markets, clusters: distinct pairs first so no group state grows with rows."""
    pairs = df.groupBy("event_cluster", "market_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("outcome").alias("resolved")
    )
    return pairs.agg(
        F.sum("n").alias("raw_rows"), F.countDistinct("market_id").alias("markets"),
        F.countDistinct("event_cluster").alias("clusters"), F.sum("resolved").alias("resolved_rows"),
        F.countDistinct(F.when(F.col("resolved") > 0, F.col("market_id"))).alias("resolved_markets"),
    )


def consensus(df: DataFrame) -> DataFrame:
    """Ensemble agreement per market: mean, median, upper-middle MAD, sd, range.

    Order statistics come from counted values and running counts, never from a
    collected list. The median is the usual one, the deviation takes the upper middle.
    Values are counted once. Without hot markets the counts are dealt by market once and windows
    do the rest where the market is; hot markets are cut into blocks.
    """
    from tidemark.operators.ordered import nearest_rank, profile

    market, w, v = ["market_id"], F.col("w"), F.col("v")
    base = df.where(col("model_p").isNotNull())
    prof = profile(base, market, "model_p")
    counted = base.groupBy("market_id", col("model_p").alias("v")).agg(F.count(F.lit(1)).alias("w"))
    ranks = {"m1": lambda n: F.floor((n - 1) / 2) + 1, "m2": lambda n: F.floor(n / 2) + 1}
    if prof.hot is None:
        whole = Window.partitionBy(*market)
        so_far = F.sum("w").over(whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        summed = counted.withColumns({"cum": so_far, "members": F.sum("w").over(whole), "mean": F.sum(v * w).over(whole) / F.sum("w").over(whole)})
        around = summed.withColumns({
            name: F.max(F.when((F.col("cum") - w < rank(F.col("members"))) & (rank(F.col("members")) <= F.col("cum")), v)).over(whole) for name, rank in ranks.items()})
    else:
        counted = checkpointed(counted)
        sums = counted.groupBy("market_id").agg(F.sum("w").alias("members"), (F.sum(v * w) / F.sum("w")).alias("mean"))
        middle = nearest_rank(counted, market, "v", ranks, weight="w", prof=prof).select("market_id", "m1", "m2")
        around = counted.join(sums.join(middle, "market_id"), "market_id")
    around = around.withColumn("median", (F.col("m1") + F.col("m2")) / F.lit(2.0)).withColumn("dev", F.abs(v - F.col("median")))
    if prof.hot is None:
        around = around.withColumn("near", F.sum("w").over(whole.orderBy("dev").rowsBetween(Window.unboundedPreceding, 0)))
        mad = F.min(F.when(F.col("near") >= ranks["m2"](F.col("members")), F.col("dev")))
    else:
        found = nearest_rank(around, market, "dev", {"mad": ranks["m2"]}, weight="w").select("market_id", "mad")
        around, mad = around.join(found, "market_id"), F.max("mad")
    square = (v - F.col("mean")) * (v - F.col("mean"))
    return (
        around.groupBy("market_id", "members", "mean", "median").agg(
            F.sqrt(F.sum(square * w) / F.nullif(F.col("members") - 1, F.lit(0))).alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi"), mad.alias("mad"))
        .where("members > 1")
        .withColumn("disagreement", F.col("hi") - F.col("lo"))
    )


def null_strategies(df: DataFrame, seed: int = 42) -> DataFrame:
    """Five no-skill forecasts scored next to the model; flags those that beat it."""
    from tidemark.functions.hashing import uniform

    rows = df.where(F.col("outcome").isNotNull())
    prior = rows.agg(F.avg(col("outcome")).alias("prior")).scalar()
    mid = F.coalesce(col("mid"), col("model_p"))
    entries = {
        "0A_uniform": F.lit(0.5), "0B_market_midpoint": mid, "0C_class_prior": prior,
        "0D_random": uniform(seed, F.col("market_id"), F.col("ts_us"), F.col("rid")),
        "0E_inverse_midpoint": F.lit(1.0) - mid, "model": col("model_p"),
    }
    tall = rows.withColumn("prior_", prior).select(
        "outcome",
        F.explode(F.array(*[
            F.struct(F.lit(k).alias("strategy"),
                     (F.col("prior_") if k == "0C_class_prior" else v).alias("p"))
            for k, v in entries.items()
        ])).alias("s"),
    ).select("outcome", "s.strategy", "s.p")
    cells = tall.withColumn("bin", sc.unit_bin(F.col("p"))).groupBy("strategy", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"),
        F.sum(col("outcome").cast("double")).alias("sy"),
        F.sum(sc.squared_error(F.col("p"), col("outcome"))).alias("b"),
        F.sum(sc.log_loss_term(F.col("p"), col("outcome"))).alias("l"),
    )
    n = F.sum("n")
    out = cells.groupBy("strategy").agg(
        n.alias("n"), (F.sum("b") / n).alias("brier"), (F.sum("l") / n).alias("log_loss"),
        (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"),
    )
    model = F.max(F.when(F.col("strategy") == "model", F.col("brier"))).over(
        Window.partitionBy(F.lit(1))
    )
    return out.withColumn("beats_model", F.col("brier") < model)


def effective_sample_size(df: DataFrame) -> DataFrame:
    """Design effect from the between/within cluster mean squares (MSB / (MSB + MSW))."""
    rows = df.where(F.col("outcome").isNotNull())
    per = rows.groupBy("event_cluster").agg(
        F.count(F.lit(1)).alias("n"), F.avg(col("model_p")).alias("m"), F.var_pop(col("model_p")).alias("v")
    )
    grand = rows.agg(F.avg(col("model_p")).alias("g")).scalar()
    one = per.withColumn("g", grand).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("ssb"),
        F.sum(F.col("n") * F.col("v")).alias("ssw"),
    )
    msb = F.when(F.col("k") > 1, F.col("ssb") / (F.col("k") - 1)).otherwise(0.0)
    msw = F.when(F.col("n") > F.col("k"), F.col("ssw") / (F.col("n") - F.col("k"))).otherwise(0.0)
    icc = F.when(msb + msw > 0, msb / (msb + msw)).otherwise(0.0)
    size = F.col("n") / F.col("k")
    effect = F.lit(1.0) + (size - F.lit(1.0)) * icc
    return one.select(
        F.col("n").alias("nominal"), F.col("k").alias("clusters"), size.alias("avg_cluster_size"),
        icc.alias("icc"), effect.alias("design_effect"), (F.col("n") / effect).alias("effective"),
    )


def cluster_means(df: DataFrame, value, keys: Sequence[str] = ()) -> DataFrame:
    """Rows -> market means -> cluster means, so that each cluster weighs the same."""
    per_market = df.groupBy(*keys, "event_cluster", "market_id").agg(F.avg(value).alias("v"))
    return per_market.groupBy(*keys, "event_cluster").agg(F.avg("v").alias("v"))


def resolved_before(df: DataFrame, split_us: int) -> DataFrame:
    """Rows that may be evaluated: labelled, ending on or after the split, seen before resolution."""
    end = F.col("ts_us") + (F.col("hours") * F.lit(3.6e9)).cast("bigint")
    return df.where(
        F.col("outcome").isNotNull() & F.col("mid").isNotNull() & F.col("hours").isNotNull()
        & (end >= F.lit(split_us))
        & (F.col("resolved_us").isNull() | (F.col("ts_us") < F.col("resolved_us")))
    )


def binned_cluster_error(df: DataFrame) -> DataFrame:
    """Cluster-weighted calibration error over price bins."""
    means = cluster_means(
        df.withColumn("bin", sc.unit_bin(col("mid"))), col("outcome").cast("double") - col("mid"), ["bin"]
    )
    bins = means.groupBy("bin").agg(F.count(F.lit(1)).alias("ncl"), F.avg("v").alias("effect"))
    return bins.agg(
        F.sum("ncl").alias("clusters"),
        (F.sum(F.col("ncl") * F.abs(F.col("effect"))) / F.sum("ncl")).alias("ece"),
    )


def max_favourable_excursion(fc: DataFrame) -> DataFrame:
    """Per market: how far the forecast once stood beyond its last value toward the outcome."""
    at = F.struct("predicted_us", "rid")
    ends = fc.where("outcome is not null").groupBy("market_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("outcome").alias("outcome"),
        F.max_by("p", at).alias("last_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"),
    )
    mfe = F.when(F.col("outcome") == 1, F.col("max_p") - F.col("last_p")).otherwise(
        F.col("last_p") - F.col("min_p")
    )
    error = F.abs(F.col("last_p") - F.col("outcome"))
    return ends.where("n >= 2").select(
        "market_id", "n", mfe.alias("mfe"), error.alias("final_error"),
        (mfe / F.nullif(error, F.lit(0.0))).alias("mfe_ratio"),
    )


def mfe_summary(fc: DataFrame) -> DataFrame:
    """Means over markets and the upper-middle median of the ratio."""
    from tidemark.operators.ordered import nearest_rank

    per = max_favourable_excursion(fc)
    ranked = per.select(F.lit(1).alias("g"), F.round("mfe_ratio", 6).alias("r"))
    median = nearest_rank(ranked, ["g"], "r", {"m": lambda n: F.floor(n / 2) + 1})
    return per.agg(
        F.count(F.lit(1)).alias("markets"), F.avg("mfe").alias("mean_mfe"),
        F.max("mfe").alias("max_mfe"), F.avg("mfe_ratio").alias("mean_ratio"),
        F.count_if(F.col("mfe") > 0.1).alias("high_mfe"),
    ).withColumn("median_ratio", median.select("m").scalar())


def terciles(df: DataFrame, split_us: int) -> DataFrame:
    """Training-only liquidity cut points over market means, nearest rank n//3 and 2n//3."""
    from tidemark.operators.ordered import nearest_rank

    end = F.col("ts_us") + (F.col("hours") * F.lit(3.6e9)).cast("bigint")
    means = (
        df.where(F.col("hours").isNotNull() & (end < F.lit(split_us)) & F.col("liquidity").isNotNull())
        .groupBy("market_id").agg(F.round(F.avg("liquidity"), 6).alias("v"))
        .withColumn("g", F.lit(1))
    )
    cut = nearest_rank(
        means, ["g"], "v",
        {"q1": lambda n: F.floor(n / 3) + 1, "q2": lambda n: F.floor(n * 2 / 3) + 1},
    )
    return cut.where((F.col("n") >= 3) & (F.col("q1") != F.col("q2"))).select(
        F.col("n").alias("markets"), "q1", "q2"
    )


def ranked_share(df: DataFrame, group: str, value: str) -> DataFrame:
    """Concentration: totals per group, share of absolute PnL, running share and rank."""
    totals = df.groupBy(group).agg(
        F.round(F.sum(value), 6).alias("pnl"), F.count(F.lit(1)).alias("trades")
    ).withColumns({"g": F.lit(1), "weight": F.abs("pnl")})
    whole = totals.agg(F.sum("weight").alias("w")).scalar()
    ranked = running(
        totals.withColumn("share", F.col("weight") / whole * F.lit(100.0)),
        ["g"], "weight", [group],
        {"rank": ("count", None), "cumulative_pct": ("sum", F.col("share"))}, descending=True,
    )
    return ranked.drop("g")
