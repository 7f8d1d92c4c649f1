"""Gains and losses of clusters along a tree of the genomes.

The fewest changes that explain a pattern are found in two sweeps over the levels of the tree:
from the leaves up, the states that most children can have; from the root down, the parent's
state where it is among them. Clusters with the same genomes share a pattern, patterns are spread
over the tasks, and a task sweeps a block of patterns at once and adds up the changes of each
branch, so a task hands on one row for each branch. The tree, fewer than two nodes a genome where
all inner nodes branch, is held by every task.

Defined results. Genomes that aren't in the tree don't count; leaves without a cluster are
absent; a root that may be either is absent, so the cluster was gained later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.shared import folded
from strandloom.session import ship

#: States of nodes and patterns held at once.
CELLS = 1 << 22


class Tree:
    """Nodes by level; the children of a node stand together in their level."""

    def __init__(self, node: np.ndarray, parent: np.ndarray, depth: np.ndarray, names: list[str | None]) -> None:
        if len(node) == 0 or (parent < 0).sum() != 1:
            raise ValueError("a tree has one root")
        place = {n: k for k, n in enumerate(node.tolist())}
        self.parent = np.array([place.get(p, -1) for p in parent.tolist()])
        self.levels = []
        for level in range(1, int(depth.max()) + 1):
            own = np.flatnonzero(depth == level)
            own = own[np.argsort(self.parent[own], kind="stable")]
            above = self.parent[own]
            first = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
            self.levels.append((own, above, first))
        inner = np.zeros(len(node), dtype=bool)
        inner[self.parent[self.parent >= 0]] = True
        self.root, self.leaves = int(np.flatnonzero(self.parent < 0)[0]), np.flatnonzero(~inner)
        self.names = [names[k] for k in self.leaves]
        named = [n for n in self.names if n is not None]
        if len(set(named)) != len(named):
            raise ValueError("two leaves of the tree have one name")

    def changes(self, present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gained, lost), each (nodes, patterns), on the branch above a node; present is (leaves, patterns)."""
        shape = (len(self.parent), present.shape[1])
        one, zero = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
        one[self.leaves], zero[self.leaves] = present, ~present
        for own, above, first in reversed(self.levels):
            ones, zeros = (np.add.reduceat(can[own].astype("i4"), first, axis=0) for can in (one, zero))
            one[above[first]], zero[above[first]] = ones >= zeros, zeros >= ones
        state = np.zeros(shape, dtype=bool)
        state[self.root] = one[self.root] & ~zero[self.root]
        gained, lost = np.zeros(shape, dtype=bool), np.zeros(shape, dtype=bool)
        for own, above, _ in self.levels:
            before = state[above]
            state[own] = (before & one[own]) | (~before & ~zero[own])
            gained[own], lost[own] = ~before & state[own], before & ~state[own]
        return gained, lost


def branch_changes(presence: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, parent, name, length, gains, losses) for each branch of one tree (node, parent, name, length, depth)."""
    rows = nodes.select("node", "parent", "name", "depth").orderBy("node").collect()
    tree = Tree(np.array([r["node"] for r in rows]), np.array([-1 if r["parent"] is None else r["parent"] for r in rows]), np.array([r["depth"] for r in rows]), [r["name"] for r in rows])
    ids = np.array([r["node"] for r in rows])
    ship(presence.sparkSession)
    patterns = folded(presence).groupBy("pattern").agg(F.first("genomes").alias("genomes"), F.count(F.lit(1)).alias("clusters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, losses = np.zeros(len(ids), dtype="i8"), np.zeros(len(ids), dtype="i8")
        names = pa.array(tree.names, pa.string())
        step = max(1, CELLS // len(ids))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists = part.column("genomes")
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                place = pc.index_in(lists.flatten(), value_set=names)
                known = place.is_valid().to_numpy(zero_copy_only=False)
                present = np.zeros((len(tree.leaves), part.num_rows), dtype=bool)
                present[place.drop_null().to_numpy(), row[known]] = True
                clusters = part.column("clusters").to_numpy()
                gained, lost = tree.changes(present)
                gains += gained @ clusters
                losses += lost @ clusters
        changed = np.flatnonzero(gains + losses)
        yield pa.RecordBatch.from_arrays([pa.array(ids[changed], pa.int64()), pa.array(gains[changed]), pa.array(losses[changed])], names=["node", "gains", "losses"])

    counted = patterns.mapInArrow(run, "node long, gains long, losses long").groupBy("node").agg(F.sum("gains").alias("gains"), F.sum("losses").alias("losses"))
    out = nodes.where("parent is not null").select("node", "parent", "name", "length").join(counted, "node", "left")
    return out.fillna(0, ["gains", "losses"])


def change_rates(branches: DataFrame) -> DataFrame:
    """(parameter, value): how gains, losses and all changes grow with the length of a branch.

    gain_rate and loss_rate are least-squares slopes, alpha the changes of a branch without length,
    r_squared that of all changes; convergence is 1 where there is a slope. Branches without a
    length don't count.
    """
    length, changes = F.col("length"), F.col("gains") + F.col("losses")
    one = branches.where("length is not null").agg(
        F.regr_slope("gains", length).alias("gain_rate"), F.regr_slope("losses", length).alias("loss_rate"),
        F.regr_intercept(changes, length).alias("alpha"), F.regr_r2(changes, length).alias("r_squared"),
    )
    one = one.withColumn("convergence", F.when(F.col("gain_rate").isNotNull(), 1.0).otherwise(0.0))
    return one.unpivot([], ["gain_rate", "loss_rate", "alpha", "convergence", "r_squared"], "parameter", "value")
