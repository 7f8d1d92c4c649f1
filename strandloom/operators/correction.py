"""Graph corrections: fixed-point pruning, merging of families, recovery of missing genes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import clustering, graph
from strandloom.operators.distances import centres
from strandloom.operators.recovery import refound
from strandloom.session import forget, stored

#: Rounds of pruning after which a graph that still has leaves to cut is an error; each halves the ends.
ROUNDS = 64
#: Rounds that take off one node of each tail, before tails are taken off whole.
SINGLE = 6
COLLAPSE_THRESHOLDS = (0.99, 0.95, 0.9, 0.8, 0.7)


def contamination_threshold(mode: str, genomes: int) -> int:
    return {"strict": math.ceil(0.05 * genomes), "sensitive": 1}.get(mode, 2)


def contig_end_threshold(mode: str, genomes: int) -> int:
    return {"strict": max(2, math.ceil(0.05 * genomes)), "sensitive": 2}.get(mode, max(2, math.ceil(0.01 * genomes)))


def misassembly_threshold(mode: str, genomes: int) -> int:
    """0 turns the step off."""
    return 0 if mode == "sensitive" else max(2, math.ceil(0.01 * genomes))


def pruned(edges: DataFrame, weak: DataFrame, rounds: int = ROUNDS) -> DataFrame | None:
    """(cluster_id) of the nodes that go when weak ones (id) of degree 1 are removed until there is none.

    The first rounds are single ones, which is all that most graphs need; what is deeper goes by
    whole tails.
    """
    sides, early = stored(graph.both_ways(edges).distinct(), "sides"), None
    for _ in range(SINGLE):
        new = stored(sides.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).where("degree = 1").join(weak, "id", "left_semi").select("id"), "gone")
        if new.isEmpty():
            return early
        early = new.withColumnRenamed("id", "cluster_id") if early is None else early.unionByName(new.withColumnRenamed("id", "cluster_id"))
        last, sides = sides, stored(_cut(sides, new), "sides")
        forget(last)
    late = _pruned_tails(sides, weak, rounds)
    return early if late is None else early.unionByName(late)


def _cut(sides: DataFrame, gone: DataFrame) -> DataFrame:
    return sides.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "nbr"), "nbr", "left_anti").select("id", "nbr")


def _pruned_tails(sides: DataFrame, weak: DataFrame, rounds: int) -> DataFrame | None:
    """As pruned(), of neighbours (id, nbr), by whole tails.

    A weak node is certain to go once it has one neighbour, whenever that is. So a round removes
    whole tails: of the weak nodes with two neighbours or fewer, every connected run that holds a
    node of degree 1. Nodes that fork lose two tails or more before they are an end, so each
    round halves the ends. Only where a tree is used up does the order matter: ends that vanish
    at the same time leave the node between them alone, without a neighbour, and it stays. These
    are the trees of weak nodes with one node in the middle.
    """
    whole, gone = sides, None
    for _ in range(rounds):
        degree = sides.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).where("degree <= 2")
        slim = stored(degree.join(weak, "id", "left_semi"), "slim")
        ends = slim.where("degree = 1").select("id")
        if ends.isEmpty():
            break
        runs = sides.where("id < nbr").join(slim.select("id"), "id", "left_semi").join(slim.select(F.col("id").alias("nbr")), "nbr", "left_semi")
        comp = stored(graph.components(runs.select(F.col("id").alias("src"), F.col("nbr").alias("dst"))), "runs")
        cut = comp.join(ends.withColumnRenamed("id", "cluster_id"), "cluster_id", "left_semi").select("component").distinct()
        new = stored(comp.join(cut, "component", "left_semi").select(F.col("cluster_id").alias("id")).unionByName(ends).distinct(), "gone")
        gone = new if gone is None else gone.unionByName(new)
        last, sides = sides, stored(_cut(sides, new), "sides")
        if last is not whole:
            forget(last)
    else:
        raise RuntimeError(f"leaves were left after {rounds} rounds")
    if gone is None:
        return None
    alone = whole.select("id").distinct().join(weak, "id", "left_semi").join(sides, "id", "left_anti")  # gone, or left without a neighbour
    used = stored(gone.unionByName(alone).distinct().withColumnRenamed("id", "cluster_id"), "used")
    inside = whole.where("id <> nbr").join(used.withColumnRenamed("cluster_id", "id"), "id", "left_semi")
    out = inside.join(used.withColumnRenamed("cluster_id", "nbr"), "nbr", "left_anti").select("id").unionByName(whole.where("id = nbr").select("id")).distinct()
    within = stored(inside.join(used.withColumnRenamed("cluster_id", "nbr"), "nbr", "left_semi").where("id < nbr").select(F.col("id").alias("src"), F.col("nbr").alias("dst")), "within")
    group = stored(graph.components(within), "groups")
    held = group.join(out.withColumnRenamed("id", "cluster_id"), "cluster_id", "left_semi").select("component").distinct()
    trees = stored(group.join(held, "component", "left_anti"), "trees")
    if trees.isEmpty():
        return used
    tree_edges = stored(within.join(trees.select(F.col("cluster_id").alias("src")), "src", "left_semi"), "tree_edges")
    return stored(used.join(centres(tree_edges, trees), "cluster_id", "left_anti"), "used")


def _prune(nodes: DataFrame, edges: DataFrame, least: int, extra, rounds: int) -> tuple[DataFrame, DataFrame]:
    weak = stored(nodes.where((F.col("support") < least) & extra).select(F.col("cluster_id").alias("id")), "weak")
    gone = pruned(edges, weak, rounds)
    if gone is None:
        return nodes, edges
    return tuple(stored(x, n) for x, n in zip(graph.without_nodes(nodes, edges, gone), ("nodes", "edges")))


def remove_contamination(nodes: DataFrame, edges: DataFrame, least: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Drop nodes of degree 1 and support below least until none is left."""
    return _prune(nodes, edges, least, F.lit(True), rounds)


def prune_contig_ends(nodes: DataFrame, edges: DataFrame, least: int, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """As remove_contamination(), only nodes seen at a contig end."""
    return _prune(nodes, edges, least, F.size("contig_end_genomes") > 0, rounds)


def misassembled_edges(nodes: DataFrame, edges: DataFrame, least: int, share: float = 0.05) -> DataFrame:
    """(src, dst) to clean: weak edges at a contig end, or weak against both their nodes."""
    if least <= 0:
        return edges.select("src", "dst").limit(0)
    n = nodes.select("cluster_id", F.col("support").alias("s"), (F.size("contig_end_genomes") > 0).alias("at_end"))
    e = edges.join(n.withColumnsRenamed({"cluster_id": "src", "s": "s1", "at_end": "e1"}), "src").join(n.withColumnsRenamed({"cluster_id": "dst", "s": "s2", "at_end": "e2"}), "dst")
    weak = F.col("support") < least
    ratio = F.try_divide(F.col("support"), F.least("s1", "s2"))  # null, so not weak, where a node has no support
    return e.where(weak & (F.col("e1") | F.col("e2") | F.coalesce(ratio < share, F.lit(False)))).select("src", "dst")


def clean_misassembly(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    return graph.without_edges(edges, misassembled_edges(nodes, edges, least))


def context_similarity(contexts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of contexts (start, node, depth): shared nodes weighed by 1/(1+|difference|)."""
    c = contexts.where("node <> start").select("start", "node", "depth")
    size = c.groupBy("start").agg(F.count(F.lit(1)).alias("n"))
    both = pairs.join(c.withColumnsRenamed({"start": "a", "depth": "da"}), "a").join(c.withColumnsRenamed({"start": "b", "depth": "db"}), ["b", "node"])
    shared = both.groupBy("a", "b").agg(F.sum(1 / (1 + F.abs(F.col("da") - F.col("db")))).alias("w"), F.count(F.lit(1)).alias("k"))
    out = pairs.join(shared, ["a", "b"], "left").join(size.withColumnsRenamed({"start": "a", "n": "na"}), "a", "left").join(size.withColumnsRenamed({"start": "b", "n": "nb"}), "b", "left").na.fill(0, ["w", "k", "na", "nb"])
    union = F.col("na") + F.col("nb") - F.col("k")
    return out.select("a", "b", F.when(union > 0, F.col("w") / union).otherwise(F.lit(0.0)).alias("similarity"))


def resolve_paralogs(nodes: DataFrame, edges: DataFrame, seqs: DataFrame, depth: int = 5, least: float = 0.5, ratio: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Merge paralog nodes of like length whose similarity is at least `least`.

    The similarity is 1/(1+distance) within depth steps, else that of their contexts.
    """
    para = stored(nodes.where("is_paralog").select("cluster_id").join(seqs.select("cluster_id", F.length("sequence").alias("n")), "cluster_id"), "paralogs")
    near = stored(graph.bfs(edges, para.select(F.col("cluster_id").alias("start")), depth), "contexts")
    n = para.select("cluster_id", "n")
    # pairs that can be similar meet at a node that both contexts hold
    met = near.select(F.col("start").alias("a"), "node").join(near.select(F.col("start").alias("b"), "node"), "node").where("a < b").select("a", "b").distinct()
    sized = met.join(n.withColumnsRenamed({"cluster_id": "a", "n": "na"}), "a").join(n.withColumnsRenamed({"cluster_id": "b", "n": "nb"}), "b").where(F.least("na", "nb") >= ratio * F.greatest("na", "nb")).select("a", "b")
    steps = near.select(F.col("start").alias("a"), F.col("node").alias("b"), "depth")
    scored = context_similarity(near, sized).join(steps, ["a", "b"], "left")
    alike = scored.where(F.when(F.col("depth").isNotNull(), 1 / (1 + F.col("depth"))).otherwise(F.col("similarity")) >= least)
    return graph.merge(nodes, edges, alike.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def correct_mistranslations(nodes: DataFrame, edges: DataFrame, seqs: DataFrame, depth: int = 3, coverage: float = 0.95, identity: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """Merge nodes within a few steps whose sequences nearly agree; the better supported one stays."""
    near = graph.bfs(edges, nodes.select(F.col("cluster_id").alias("start")), depth).where("start < node").select(F.col("start").alias("a"), F.col("node").alias("b"))
    like = clustering.pair_identities(near, seqs).where((F.col("coverage") >= coverage) & (F.col("identity") >= identity))
    return graph.merge(nodes, edges, like.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def collapse_families(nodes: DataFrame, edges: DataFrame, seqs: DataFrame, thresholds: tuple[float, ...] = COLLAPSE_THRESHOLDS) -> tuple[DataFrame, DataFrame]:
    """Merge families of like beginning and length that share a neighbour, from strict to lax.

    Identities are computed once, for all bucket pairs, and reused at every threshold.
    """
    known = stored(clustering.pair_identities(clustering.bucket_pairs(seqs), seqs).where(F.col("identity") >= min(thresholds)), "identities")
    for t in thresholds:
        ids = nodes.select("cluster_id")
        alive = known.where(F.col("identity") >= t).join(ids.withColumnRenamed("cluster_id", "a"), "a", "left_semi").join(ids.withColumnRenamed("cluster_id", "b"), "b", "left_semi")
        near = stored(clustering.sharing_a_neighbour(alive.select("a", "b"), edges), "family")
        if near.isEmpty():
            continue
        nodes, edges = (stored(x, n) for x, n in zip(graph.merge(nodes, edges, near.select(F.col("a").alias("src"), F.col("b").alias("dst"))), ("nodes", "edges")))
    return nodes, edges


def missing_genomes(edges: DataFrame, presence: DataFrame) -> DataFrame:
    """(src, dst, genome_id): genomes that have src but not dst, for each edge."""
    have = edges.select("src", "dst").join(presence.withColumnRenamed("cluster_id", "src"), "src")
    return have.join(presence.withColumnRenamed("cluster_id", "dst"), ["dst", "genome_id"], "left_anti").select("src", "dst", "genome_id")


def windows(contigs: DataFrame, query_length, pad: int = 5000, step: int = 100) -> DataFrame:
    """contigs exploded into windows of the query's length + pad at steps of half the query."""
    width = query_length + pad
    by = F.greatest(F.floor(query_length / 2), F.lit(step)).cast("int")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("sequence") - 1, F.lit(0)), by))
    return contigs.withColumn("at", at).withColumn("window", F.substring("sequence", F.col("at") + 1, width.cast("int")))


def recover_missing(nodes: DataFrame, edges: DataFrame, presence: DataFrame, seqs: DataFrame, contigs: DataFrame, consensus: bool = False, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, presence) with refound genes added; a changed node's genomes grow, and its support becomes their number.

    compat: a gene found in any genome's contigs counts for every missing genome. consensus:
    nodes refound on more edges than their support go.
    """
    missing = stored(missing_genomes(edges, presence), "missing")
    if compat:
        every = contigs.select(F.lit("*").alias("genome_id"), "sequence")
        hit = refound(missing.select("src", "dst", F.lit("*").alias("genome_id")), seqs, every).select("dst")
        found = missing.join(hit.distinct(), "dst").select("dst", "genome_id").distinct()
    else:
        found = refound(missing, seqs, contigs)
    found = stored(found, "refound")
    grown = presence.select("cluster_id", "genome_id").unionByName(found.select(F.col("dst").alias("cluster_id"), "genome_id")).distinct()
    changed = grown.join(found.select(F.col("dst").alias("cluster_id")).distinct(), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.sort_array(F.collect_list("genome_id")).alias("now"))
    out = nodes.join(changed, "cluster_id", "left").withColumn("support", F.when(F.col("now").isNotNull(), F.size("now").cast("long")).otherwise(F.col("support")))
    if "genomes" in nodes.columns:
        out = out.withColumn("genomes", F.coalesce("now", "genomes"))
    if "n_genomes" in nodes.columns:
        out = out.withColumn("n_genomes", F.when(F.col("now").isNotNull(), F.size("now").cast("long")).otherwise(F.col("n_genomes")))
    out = out.drop("now")
    if consensus:
        hits = missing.join(found, ["dst", "genome_id"]).select("src", "dst").distinct().groupBy(F.col("dst").alias("cluster_id")).agg(F.count(F.lit(1)).alias("hits"))
        gone = nodes.join(hits, "cluster_id").where("hits > support").select("cluster_id")
        out, grown = out.join(gone, "cluster_id", "left_anti"), grown.join(gone, "cluster_id", "left_anti")
    return out.select(*nodes.columns), grown
