"""Structural variants and highly variable regions of an adjacency graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import graph
from strandloom.operators.distances import distances
from strandloom.session import forget, stored


def directed_edges(pairs: DataFrame) -> DataFrame:
    """(a, b, genomes): distinct genomes of each ordered pair (a, b, genome_id)."""
    return pairs.groupBy("a", "b").agg(F.sort_array(F.collect_set("genome_id")).alias("genomes"))


def inversions(directed: DataFrame) -> DataFrame:
    """(kind, clusters, genomes, support): a pair read both ways by disjoint sets of genomes; the smaller set's size is the support."""
    f, r = directed.alias("f"), directed.alias("r")
    both = f.join(r, (F.col("f.a") == F.col("r.b")) & (F.col("f.b") == F.col("r.a"))).where((F.col("f.a") < F.col("f.b")) & ~F.arrays_overlap("f.genomes", "r.genomes"))
    genomes = F.sort_array(F.array_union("f.genomes", "r.genomes"))
    return both.select(F.lit("inversion").alias("kind"), F.array("f.a", "f.b").alias("clusters"), genomes.alias("genomes"), F.least(F.size("f.genomes"), F.size("r.genomes")).cast("long").alias("support"))


def duplications(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of degree 3 or more, with the nodes' support, and self-loops, with the edges'."""
    many = nodes.join(graph.degrees(edges).where("degree >= 3"), "cluster_id").select(F.lit("duplication").alias("kind"), F.array("cluster_id").alias("clusters"), "genomes", "support")
    loops = edges.where("src = dst").select(F.lit("tandem_duplication").alias("kind"), F.array("src").alias("clusters"), "genomes", "support")
    return many.unionByName(loops)


def structural_variants(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    return inversions(directed_edges(pairs)).unionByName(duplications(nodes, edges))


def spanning_tree(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, parent, depth, root): breadth-first trees from each component's least id; least parent wins.

    Depths come first, in rounds that don't grow with chains; a parent is then the least
    neighbour one step nearer. With rounds given, deeper trees are an error.
    """
    step = stored(graph.both_ways(edges.where("src <> dst")).distinct(), "steps")
    comp = stored(graph.components(edges), "trees")
    depths = distances(edges, comp.where("cluster_id = component").select(F.col("cluster_id").alias("id")))
    if rounds is not None and (depths.agg(F.max("depth")).first()[0] or 0) >= rounds:
        raise RuntimeError(f"a tree is deeper than {rounds - 1} levels")
    near = step.join(depths.select(F.col("node").alias("id"), F.col("depth").alias("own")), "id").join(depths.select(F.col("node").alias("nbr"), F.col("depth").alias("there")), "nbr")
    parents = near.where("there = own - 1").groupBy(F.col("id").alias("node")).agg(F.min("nbr").alias("parent"))
    named = depths.join(comp, depths["node"] == comp["cluster_id"]).join(parents, "node", "left")
    return stored(named.select("node", "parent", F.col("depth").cast("int").alias("depth"), F.col("component").alias("root")), "trees")


def ancestors(tree: DataFrame, most: int) -> DataFrame:
    """(node, up): the node and its ancestors, nearest first, most + 1 at most; a round doubles how far a path goes."""
    ways = stored(tree.select("node", F.array("node").alias("path"), F.col("parent").alias("next")), "paths")
    for _ in range(most.bit_length()):
        further = ways.select(F.col("node").alias("next"), F.col("path").alias("more"), F.col("next").alias("then"))
        last, ways = ways, stored(ways.join(further, "next", "left").select("node", F.slice(F.concat("path", F.coalesce("more", F.array().cast("array<string>"))), 1, most + 1).alias("path"), F.col("then").alias("next")), "paths")
        forget(last)
    return ways.select("node", F.col("path").alias("up"))


def cycles(edges: DataFrame, least: int = 3, most: int = 20) -> DataFrame:
    """(cycle, node): one fundamental cycle for each edge outside the trees, of bounded length.

    The ends of such an edge are at most a level apart, so in a cycle of most nodes each is at
    most half of them below the node where the ends' ways up meet.
    """
    tree = stored(spanning_tree(edges), "tree")
    t = tree.select("node", "parent")
    chord = edges.where("src <> dst").join(t.select(F.col("node").alias("src"), F.col("parent").alias("ps")), "src").join(t.select(F.col("node").alias("dst"), F.col("parent").alias("pd")), "dst")
    chord = chord.where(~(F.coalesce(F.col("ps") == F.col("dst"), F.lit(False)) | F.coalesce(F.col("pd") == F.col("src"), F.lit(False)))).select("src", "dst").distinct()
    up = stored(ancestors(tree, most // 2 + 1), "ancestors")
    both = chord.join(up.select(F.col("node").alias("src"), F.col("up").alias("a")), "src").join(up.select(F.col("node").alias("dst"), F.col("up").alias("b")), "dst")
    meet = both.withColumn("top", F.get(F.array_intersect("a", "b"), F.lit(0))).where("top is not null")
    below = [F.slice(side, F.lit(1), F.array_position(side, F.col("top")).cast("int") - 1) for side in ("a", "b")]
    met = meet.select(F.concat_ws("~", "src", "dst").alias("cycle"), F.concat(*below, F.array("top")).alias("path"))
    return met.where((F.size("path") <= most) & (F.size("path") >= least)).select("cycle", F.explode("path").alias("node"))


def cycle_sets(cycle_nodes: DataFrame) -> DataFrame:
    """(cycle, component): cycles that share more than one node, united."""
    c = cycle_nodes
    pairs = c.join(c.withColumnRenamed("node", "other"), "cycle").where("node < other")
    least = pairs.groupBy("node", "other").agg(F.min("cycle").alias("src"))
    shared = pairs.join(least, ["node", "other"]).where("src < cycle").select("src", F.col("cycle").alias("dst")).distinct()
    comp = graph.components(shared).withColumnRenamed("cluster_id", "cycle")
    return c.select("cycle").distinct().join(comp, "cycle", "left").select("cycle", F.coalesce("component", "cycle").alias("component"))


def highly_variable(nodes: DataFrame, edges: DataFrame, min_cycles: int = 5, share: float = 0.5) -> DataFrame:
    """nodes with is_highly_variable: in a set of min_cycles cycles or more, support below the floor of share times the set's largest."""
    c = stored(cycles(edges), "cycles")
    sets = stored(cycle_sets(c), "sets")
    big = sets.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_cycles).select("component")
    rows = c.join(sets, "cycle").join(big, "component").select("component", F.col("node").alias("cluster_id")).distinct().join(nodes.select("cluster_id", "support"), "cluster_id")
    most = rows.groupBy("component").agg(F.floor(F.max("support") * share).alias("limit"))
    flagged = rows.join(most, "component").where(F.col("support") < F.col("limit")).select("cluster_id").distinct().withColumn("flag", F.lit(True))
    return nodes.join(flagged, "cluster_id", "left").withColumn("is_highly_variable", F.coalesce("flag", F.lit(False))).drop("flag")
