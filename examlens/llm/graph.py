"""Connected components of large edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame) -> tuple:
    """Equal for equal edge sets: one row leaves the executors."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node `a` that has a smaller one: columns `a`, `b`.

    `edges` has columns `a` and `b`. Large-star and small-star steps alternate until the
    edges are stars: each links the neighbours of a node to the smallest of them. A step
    is an aggregate (combined before the shuffle) and a join whose hot keys AQE splits;
    every round is written to the shared folder, so neither lineage nor memory grows.
    Self links and null nodes are ignored, repeated ones merged.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = written(edges.distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        larger = both.join(smallest, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = larger.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = moved.unionAll(low.select("a", F.col("low").alias("b"))).where("a <> b").distinct()
        edges = written(stars, "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges
