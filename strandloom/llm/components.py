"""Connected components by alternating large-star and small-star over an edge table.

A step is two joins on pre-aggregated minima, so a hub's edges never meet in one group: the
aggregate combines on the map side and adaptive execution can split the joins. Each step is
written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import store


def _lowered(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b, once each."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour or itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) for every id of the edges (a, b); component is the least id reachable."""

    def state(table: DataFrame):
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = store.stored(_lowered(edges), "edges")
    seen = state(now)
    for _ in range(most):
        after = store.stored(_small_star(_large_star(now)), "stars")
        store.forget(now)
        now, before, seen = after, seen, state(after)
        if seen == before:
            break
    else:
        raise RuntimeError("the components didn't settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
