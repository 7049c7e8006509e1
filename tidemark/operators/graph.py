"""Graph operators: connected components without collecting a neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpointed


def _relink(edges: DataFrame, larger: bool) -> DataFrame:
    """One star round: hang the neighbours of every node on its smallest neighbour. Edges have u > v, before and after."""
    if larger:
        ends = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
        both = edges.select(F.explode(ends).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        # The edge to the smallest neighbour stays, as the node's own; of the others the neighbours move.
        joined = edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
        out = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether edges with u > v are stars: every u hangs on one v, and no v hangs on another node."""
    ends = F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = edges.select(F.explode(ends).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.min("e.up").alias("least"))
    return nodes.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """Component (smallest member) of every node, by alternating large- and small-star.

    The number of rounds grows with the logarithm of the largest component, not with its
    diameter; edges that are stars already need none. Each round is two joins and two
    distincts; lineage is cut by a checkpoint.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = checkpointed(links)
    for _ in range(max_rounds):
        if _settled(links):
            break
        links = checkpointed(_relink(_relink(links, True), False))
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    members = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
