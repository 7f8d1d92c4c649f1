"""Steps from the roots of a graph, in rounds that don't grow with the length of its chains and tails.

A gene-order graph is mostly chains. Nodes of degree 2 are taken out by pointer doubling: both
walks from a node double their reach each round until they stand at a node that stays, and the
chain becomes one edge with a length. Then nodes of degree 1 are taken off. Both are repeated
while they take out a fair share of the nodes; the core that is left is searched round by round
with lengths, and the nodes taken out get their distances from the ends they were taken out
between, last ones first. Every round is written, so a lost executor repeats one round at most. Shallow graphs are searched level by
level without any of this.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.session import forget, stored

#: A contraction that takes out less than this share of the nodes is the last one.
FAIR_SHARE = 0.05
#: Graphs of fewer levels are searched as they are.
SHALLOW = 6


def _least(half: DataFrame) -> DataFrame:
    """The shortest of parallel edges."""
    return half.groupBy("id", "nbr").agg(F.min("w").alias("w"))


def _turned(edges: DataFrame) -> DataFrame:
    """Edges (id, nbr, w) in the other direction too."""
    return edges.unionByName(edges.select(F.col("nbr").alias("id"), F.col("id").alias("nbr"), "w"))


def chain_ends(half: DataFrame, inner: DataFrame) -> DataFrame:
    """(id, e1, d1, e2, d2): the nodes at which the walks from each inner node end, and how far they are.

    half: (id, nbr, w) in both directions; inner: ids of nodes with two neighbours. Rings of inner
    nodes alone have no ends and are left out.
    """
    inner = stored(inner.select("id"), "inner")
    two = half.join(inner, "id", "left_semi").groupBy("id").agg(F.min(F.struct("nbr", "w")).alias("x"), F.max(F.struct("nbr", "w")).alias("y"))
    ways = F.explode(F.array(F.struct(F.col("x.nbr").alias("away"), F.col("y.nbr").alias("to"), F.col("y.w").alias("w")), F.struct(F.col("y.nbr").alias("away"), F.col("x.nbr").alias("to"), F.col("x.w").alias("w"))))
    # a walk from id, away from one neighbour, stands at end, reached from came, after w
    arcs = two.select("id", ways.alias("a")).select("id", "a.away", F.col("a.to").alias("end"), F.col("id").alias("came"), "a.w")
    arcs = stored(arcs.join(inner.select(F.col("id").alias("end"), F.lit(True).alias("goes")), "end", "left").select("id", "away", "end", "came", "w", F.coalesce("goes", F.lit(False)).alias("goes")), "arcs")
    for _ in range(math.ceil(math.log2(inner.count() + 2)) + 1):
        if arcs.where("goes").isEmpty():
            break
        ahead = arcs.select(F.col("id").alias("end"), F.col("away").alias("came"), F.col("end").alias("end2"), F.col("came").alias("came2"), F.col("w").alias("w2"), F.col("goes").alias("goes2"))
        moved = arcs.where("goes").join(ahead, ["end", "came"]).select("id", "away", F.col("end2").alias("end"), F.col("came2").alias("came"), (F.col("w") + F.col("w2")).alias("w"), F.col("goes2").alias("goes"))
        last, arcs = arcs, stored(arcs.where("not goes").unionByName(moved), "arcs")
        forget(last)
    ended = arcs.where("not goes").groupBy("id").agg(F.min(F.struct("away", "end", "w")).alias("x"), F.max(F.struct("away", "end", "w")).alias("y"))
    return ended.where("x.away <> y.away").select("id", F.col("x.end").alias("e1"), F.col("x.w").alias("d1"), F.col("y.end").alias("e2"), F.col("y.w").alias("d2"))


def _contracted(half: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[DataFrame], float]:
    """(edges left, what was taken out in order, its share of the nodes)."""
    degree = stored(half.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).join(roots.select("id", F.lit(True).alias("is_root")), "id", "left"), "degrees")
    inner = degree.where("degree = 2 and is_root is null").select("id")
    out, taken, nodes = [], 0, degree.count()
    if not inner.isEmpty():
        chains = stored(chain_ends(half, inner), "chains")
        taken += chains.count()
        out.append(chains)
        whole = chains.where("e1 <> e2").select(F.least("e1", "e2").alias("id"), F.greatest("e1", "e2").alias("nbr"), (F.col("d1") + F.col("d2")).alias("w")).distinct()
        rest = half.join(inner, "id", "left_anti").join(inner.select(F.col("id").alias("nbr")), "nbr", "left_anti").select("id", "nbr", "w")
        half = stored(_least(rest.unionByName(_turned(whole))), "half")
    leaves = half.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.min("nbr").alias("e1"), F.min("w").alias("d1")).where("degree = 1").join(roots.select("id"), "id", "left_anti")
    leaves = stored(leaves.select("id", "e1", "d1", F.lit(None).cast("string").alias("e2"), F.lit(None).cast("long").alias("d2")), "leaves")
    if (n := leaves.count()) > 0:
        taken += n
        out.append(leaves)
        half = stored(half.join(leaves, "id", "left_anti").join(leaves.select(F.col("id").alias("nbr")), "nbr", "left_anti").select("id", "nbr", "w"), "half")
    return half, out, taken / max(nodes, 1)


def _searched(half: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame | None:
    """(node, depth) of all that the roots reach, the shortest way; a round is a step over the edges left. None if there are more than most rounds."""
    known = stored(roots.select(F.col("id").alias("node"), F.lit(0).cast("long").alias("depth")), "depths")
    front, rounds = known, 0
    while not front.isEmpty():
        if rounds == most:
            return None
        rounds += 1
        near = front.join(half, front["node"] == half["id"]).groupBy(F.col("nbr").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("new"))
        front = stored(near.join(known, "node", "left").where("depth is null or new < depth").select("node", F.col("new").alias("depth")), "front")
        known = stored(known.join(front, "node", "left_anti").unionByName(front), "depths")
    return known


def distances(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): steps from the nearest of roots (id) over edges (src, dst), for every node that they reach."""
    plain = edges.where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("nbr"), F.lit(1).cast("long").alias("w"))
    roots = stored(roots.select("id").distinct(), "roots")
    half, taken = stored(_turned(plain).distinct(), "half"), []
    shallow = _searched(half, roots, SHALLOW)
    if shallow is not None:
        return shallow
    while True:
        half, out, share = _contracted(half, roots)
        taken += out
        if share < FAIR_SHARE:
            break
    known = _searched(half, roots)
    for one in reversed(taken):
        a, b = (known.select(F.col("node").alias(f"e{k}"), F.col("depth").alias(f"t{k}")) for k in (1, 2))
        depth = F.least(F.col("t1") + F.col("d1"), F.col("t2") + F.col("d2"))  # of one alone where the other isn't known
        back = one.join(a, "e1", "left").join(b, "e2", "left").select(F.col("id").alias("node"), depth.alias("depth")).where("depth is not null")
        known = stored(known.unionByName(back), "depths")
    return known


def centres(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(cluster_id): the node in the middle of each tree that has one, not two.

    groups: (cluster_id, component) of the trees' nodes. The longest way of a tree runs between the
    node farthest from any one and the node farthest from that.
    """
    def farthest(depths: DataFrame) -> DataFrame:
        best = F.max_by(F.struct("cluster_id", "depth"), F.struct("depth", "cluster_id")).alias("best")
        return stored(depths.join(groups, depths["node"] == groups["cluster_id"]).groupBy("component").agg(best).select("component", F.col("best.cluster_id").alias("id"), F.col("best.depth").alias("length")), "farthest")

    first = farthest(distances(edges, groups.groupBy("component").agg(F.min("cluster_id").alias("id"))))
    from_first = distances(edges, first)
    second = farthest(from_first)
    from_second = distances(edges, second)
    half = second.where("length % 2 = 0").select("component", (F.col("length") / 2).cast("long").alias("half"))
    both = from_first.join(from_second.withColumnRenamed("depth", "other"), "node").where("depth = other")
    return both.join(groups, both["node"] == groups["cluster_id"]).join(half, "component").where("depth = half").select("cluster_id")
