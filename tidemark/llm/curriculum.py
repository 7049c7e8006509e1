"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the
total of all sizes; a target stops at three times its source's size and the excess is shared
again by weight until none is above (water filling, solved in closed form over the sources
ordered by how early they fill up).

Curriculum: every source has a weight schedule over training time 0..1. Its integral, scaled
to the source's target, is the cumulative demand for its words. A source lines its documents
up in a hashed order, pass after pass, and the word at cumulative count c is trained at the
time where the cumulative demand reaches c. The corpus in training order is a range sort by
that position.

Whole passes take whole documents; the pass in which the target is reached ends inside one
document per source, of which the mix takes the words up to the target. So each source's
taken words equal its target, rounded down to a word, and no document exceeds three times
its size.

Defined results: null or empty texts have size 0 and nothing is taken; sources without words
have target 0; with no words at all every target is 0; documents with one id keep a fixed
order by their text digest; reruns agree whatever the partitioning. Running sums are
taken in blocks of the hashed order, so no source is ever one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_RE, blocks_for, checkpointed

CYCLE, REPEATS, BLOCK_ROWS = (1, 2, 3), 3, 50_000
# Default schedules by place in the cycle, as (time, relative weight) knots: early, even, late.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))


def source_targets(sizes: DataFrame, cycle=CYCLE, repeats: int = REPEATS) -> DataFrame:
    """``source``, ``weight``, ``place`` in the cycle and ``target`` from (source, source_size).

    One row per source; the windows over all of them see one row each.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("place", (F.row_number().over(order) - 1) % len(cycle))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), F.col("place") + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    fill = W.orderBy("ratio", F.col("source").isNull(), "source")
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = (ranked.withColumn("cap_to", F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)))
              .withColumn("weight_from", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
              .withColumn("total", F.sum("source_size").over(W.partitionBy()).cast("double")))
    level = (F.col("total") - F.coalesce("cap_to", F.lit(0.0))) / F.col("weight_from")
    # The water level is set by the first source that does not fill up.
    ranked = ranked.withColumn("level", F.min(F.when(level <= F.col("ratio"), F.struct("ratio", level.alias("level")))).over(W.partitionBy()))
    target = F.least(F.col("cap"), F.col("level.level") * F.col("weight"))
    return ranked.select("source", "weight", "place", "source_size", target.alias("target"))


def _segments(knots) -> Column:
    """Pieces of a schedule with their share of the integral before and after."""
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, done, rows = sum(areas), 0.0, []
    for a, b, area in zip(knots, knots[1:], areas):
        rows.append(F.struct(F.lit(a[0]).alias("t0"), F.lit(b[0]).alias("t1"), F.lit(a[1] / total).alias("w0"), F.lit(b[1] / total).alias("w1"),
                             F.lit(done / total).alias("c0"), F.lit((done + area) / total).alias("c1")))
        done += area
    return F.array(*rows)


def position(share: Column, place: Column, schedules=SCHEDULES) -> Column:
    """Training time at which a source has met ``share`` (0..1) of its demand."""
    pieces = F.element_at(F.array(*[_segments(k) for k in schedules]), place + 1)
    seg = F.element_at(F.filter(pieces, lambda s: (s["c1"] >= share) | (s["t1"] >= 1.0)), 1)
    slope = (seg["w1"] - seg["w0"]) / (seg["t1"] - seg["t0"])
    need = F.greatest(share - seg["c0"], F.lit(0.0))
    root = F.sqrt(F.greatest(seg["w0"] * seg["w0"] + 2.0 * slope * need, F.lit(0.0)))
    # The stable form of the quadratic's root; slope zero needs no case of its own.
    return seg["t0"] + F.coalesce(F.try_divide(2.0 * need, seg["w0"] + root), F.lit(0.0))


def mixed(docs: DataFrame, cycle=CYCLE, repeats: int = REPEATS, schedules=SCHEDULES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``taken``, ``text_md5`` and ``position`` of its first word (null where nothing is taken)."""
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    hashed = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text_md5")))
    sized = checkpointed(sized.withColumn("draw", hashed))
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    per_source = checkpointed(per_source)
    largest = per_source.agg(F.max("source_rows")).first()[0] or 1
    blocks = blocks_for(largest, block_rows)
    block = F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("double") / 4294967296.0 * blocks).cast("int")
    sized = sized.withColumn("block", block)
    # Words before each block of a source: at most `blocks` rows per source.
    before = sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    upto = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = before.select("source", "block", F.coalesce(F.sum("block_size").over(upto), F.lit(0)).alias("before_block"))
    inside = W.partitionBy("source", "block").orderBy("draw", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    lined = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    goal = source_targets(per_source.select("source", "source_size"), cycle, repeats)
    side = before.join(goal.withColumnRenamed("source", "of"), F.expr("source <=> of")).drop("of")
    side = side.withColumnRenamed("source", "of").withColumnRenamed("block", "in_block")
    out = lined.join(side, F.expr("source <=> of and block = in_block"))
    start = F.col("before_block") + F.col("within")
    passes = F.floor(F.try_divide(F.col("target"), F.col("source_size"))).cast("long")
    rest = F.floor(F.col("target")) - passes * F.col("source_size")
    taken = F.col("size") * passes + F.greatest(F.lit(0), F.least(F.col("size"), rest - start))
    out = out.withColumn("taken", F.coalesce(taken, F.lit(0)).cast("long"))
    at = position(F.least(start / F.col("target"), F.lit(1.0)), F.col("place"), schedules)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "text_md5", F.when(F.col("taken") > 0, at).alias("position"),
                      F.when(F.col("taken") > 0, start).alias("start"), "place")


def in_training_order(docs: DataFrame, **options) -> DataFrame:
    """The corpus as it is trained on, with the columns of ``docs``: a document once per pass,
    range-sorted by training position.

    The one document per source in which the target is reached keeps, in its last pass, the
    words taken, joined by single spaces. Repeated rows (same id, source and text) all follow
    the plan of the one that is taken most.
    """
    plan = mixed(docs, **options).where("taken > 0").groupBy("doc_id", "source", "text_md5").agg(
        F.max(F.struct("taken", (-F.col("start")).alias("minus_start"), "size", "source_size", "target", "place")).alias("p"))
    p = F.col("p")
    passes = F.ceil(p["taken"] / p["size"]).cast("int")
    at = F.transform(F.sequence(F.lit(0), passes - 1), lambda k: F.struct(
        position(F.least((k * p["source_size"] - p["minus_start"]) / p["target"], F.lit(1.0)), p["place"]).alias("at"),
        F.least(p["size"], p["taken"] - k * p["size"]).alias("words")))
    plan = plan.select(F.col("doc_id").alias("plan id"), F.col("source").alias("plan source"), F.col("text_md5").alias("plan md5"),
                       p["size"].alias("plan size"), F.explode(at).alias("plan pass"))
    rows = docs.select(*docs.columns, F.md5(F.coalesce("text", F.lit(""))).alias("row md5"))
    joined = rows.join(plan, F.expr("doc_id <=> `plan id` and source <=> `plan source` and `row md5` = `plan md5`"))
    words = F.col("plan pass.words")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD_RE), F.lit(0)), F.lit(1), words.cast("int")), " ")
    joined = joined.withColumn("text", F.when(words >= F.col("plan size"), F.col("text")).otherwise(part))
    return joined.withColumn("plan at", F.col("plan pass.at")).repartitionByRange("plan at").sortWithinPartitions(
        "plan at", "doc_id").select(*[F.col(f"`{c}`") for c in docs.columns])
