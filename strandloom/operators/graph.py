"""Gene-adjacency graph: placement, adjacency, nodes, edges, neighbourhoods, removal, merging.

nodes(cluster_id, support, n_genomes, is_paralog, ...), edges(src, dst, genomes, support) with
src < dst (a self-loop has src = dst).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import forget, stored


def place(genes: DataFrame, members: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """genes with their cluster_id; genes without a cluster go."""
    return genes.join(members, keys or ["genome_id", "gene_id"])


def placements(placed: DataFrame) -> DataFrame:
    """(cluster_id, genome_id, contig), once each."""
    return placed.select("cluster_id", "genome_id", "contig").distinct()


def contig_sequences(placed: DataFrame, contigs: DataFrame, order: list[str]) -> DataFrame:
    """(cluster_id, genome_id, contig, sequence): the contig's own sequence, else its genes' ones in order.

    placed has the genes' sequences; contigs(genome_id, contig, sequence) may lack some. A
    contig's genes are gathered in one row, as its sequence is.
    """
    key = ["genome_id", "contig"]
    genes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "sequence"))), lambda x: x["sequence"]), "")
    joined = placed.groupBy(*key).agg(genes.alias("genes"))
    full = joined.join(contigs.select(*key, "sequence"), key, "left").select(*key, F.coalesce("sequence", "genes").alias("sequence"))
    return placements(placed).join(full, key)


def adjacent_pairs(placed: DataFrame, order: list[str], contig: list[str] | None = None) -> DataFrame:
    """(a, b, genome_id): clusters of consecutive genes of a contig, in reading order."""
    w = Window.partitionBy(*(contig or ["genome_id", "contig"])).orderBy(*order)
    return placed.select("genome_id", F.col("cluster_id").alias("a"), F.lead("cluster_id").over(w).alias("b")).where("b is not null").select("a", "b", "genome_id")


def edges_of(pairs: DataFrame) -> DataFrame:
    """Distinct genomes of each unordered pair."""
    rows = pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "genome_id").distinct()
    return rows.groupBy("src", "dst").agg(F.sort_array(F.collect_list("genome_id")).alias("genomes"), F.count(F.lit(1)).alias("support"))


def contig_ends(placed: DataFrame, order: list[str], contig: list[str] | None = None) -> DataFrame:
    """(cluster_id, genome_id) of the first and last gene of each contig; a single gene is both."""
    by = contig or ["genome_id", "contig"]
    up = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    last = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return placed.withColumn("__n", up).withColumn("__last", last).where("__n = 1 or __n = __last").select("cluster_id", "genome_id").distinct()


def paralog_clusters(placed: DataFrame) -> DataFrame:
    """(cluster_id, is_paralog): whether a genome has two genes in it."""
    return placed.groupBy("cluster_id", "genome_id").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster_id").agg((F.max("n") > 1).alias("is_paralog"))


def nodes_of(placed: DataFrame, ends: DataFrame) -> DataFrame:
    """support is the number of genes; n_genomes, annotations, contig_end_genomes alongside."""
    base = placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("support"), F.sort_array(F.collect_set("genome_id")).alias("genomes"), F.sort_array(F.collect_set("annotation")).alias("annotations"))
    at_end = ends.groupBy("cluster_id").agg(F.sort_array(F.collect_set("genome_id")).alias("contig_end_genomes"))
    empty = F.array().cast("array<string>")
    out = base.join(paralog_clusters(placed), "cluster_id").join(at_end, "cluster_id", "left")
    return out.withColumn("n_genomes", F.size("genomes").cast("long")).withColumn("contig_end_genomes", F.coalesce("contig_end_genomes", empty))


def build(placed: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges)."""
    return nodes_of(placed, contig_ends(placed, order)), edges_of(adjacent_pairs(placed, order))


def both_ways(edges: DataFrame) -> DataFrame:
    """(id, nbr): every edge from both ends; a self-loop once."""
    a = edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"))
    return a.unionByName(edges.where("src <> dst").select(F.col("dst").alias("id"), F.col("src").alias("nbr")))


def degrees(edges: DataFrame) -> DataFrame:
    """(cluster_id, degree): distinct neighbours."""
    return both_ways(edges).groupBy(F.col("id").alias("cluster_id")).agg(F.count_distinct("nbr").alias("degree"))


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the clusters in gone (cluster_id)."""
    g = gone.select("cluster_id")
    cut = edges.join(g.withColumnRenamed("cluster_id", "src"), "src", "left_anti").join(g.withColumnRenamed("cluster_id", "dst"), "dst", "left_anti")
    return nodes.join(g, "cluster_id", "left_anti"), cut.select(*edges.columns)


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns)


def low_support_leaves(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """Nodes of degree 1 whose support is below least."""
    return nodes.join(degrees(edges), "cluster_id").where((F.col("support") < least) & (F.col("degree") == 1)).select(*nodes.columns)


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) up to the depth, by frontier joins; seeds(start)."""
    step = both_ways(edges).distinct()
    seen = stored(seeds.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "bfs")
    front = seen
    for d in range(1, depth + 1):
        reached = front.join(step, front["node"] == step["id"]).select("start", F.col("nbr").alias("node")).distinct()
        front = stored(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)), "bfs")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes (cluster_id)."""
    n = nodes.select("cluster_id").distinct()
    return edges.join(n.withColumnRenamed("cluster_id", "src"), "src", "left_semi").join(n.withColumnRenamed("cluster_id", "dst"), "dst", "left_semi").select(*edges.columns)


def neighbourhood(nodes: DataFrame, edges: DataFrame, seed: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes with depth, induced edges) around a cluster; an unknown seed is an error."""
    seeds = nodes.where(F.col("cluster_id") == seed).select(F.col("cluster_id").alias("start"))
    if seeds.isEmpty():
        raise KeyError(f"no cluster {seed!r}")
    near = bfs(edges, seeds, depth).select(F.col("node").alias("cluster_id"), "depth")
    return nodes.join(near, "cluster_id"), induced_edges(edges, near)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(cluster_id, component): the least id reachable, by alternating stars over (src, dst)."""

    def lowered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(lowered(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "components")
    seen = state(now)
    for _ in range(rounds):
        sides = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = lowered(now.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, F.col("u") == least["a"]).select(F.col("v").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        last, now = now, stored(lowered(moved), "components")
        forget(last)
        before, seen = seen, state(now)
        if seen == before:
            break
    else:
        raise RuntimeError("the components didn't settle")
    roots = now.select(F.col("b").alias("cluster_id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("cluster_id"), F.col("b").alias("component")).unionByName(roots)


def merge(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contract the pairs (src, dst): each component of pairs becomes its best-supported node.

    Supports are summed, sets united, flags or-ed; edges are rewired, and those inside a merged
    group go.
    """
    comp = stored(components(pairs), "merge")
    ranked = comp.join(nodes.select("cluster_id", "support"), "cluster_id")
    best = ranked.groupBy("component").agg(F.min_by("cluster_id", F.struct(-F.col("support"), "cluster_id")).alias("target"))
    to = stored(comp.join(best, "component").select("cluster_id", "target"), "merge")
    moved = nodes.join(to, "cluster_id", "left").withColumn("target", F.coalesce("target", "cluster_id"))
    aggs = []
    for name, kind in nodes.dtypes:
        if name in ("cluster_id", "n_genomes"):
            continue
        if name == "support":
            aggs.append(F.sum(name).alias(name))
        elif kind.startswith("array"):
            aggs.append(F.sort_array(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name))
        elif kind == "boolean":
            aggs.append(F.bool_or(name).alias(name))
        else:
            aggs.append(F.min_by(name, F.struct(F.col("cluster_id") != F.col("target"), "cluster_id")).alias(name))
    merged = moved.groupBy("target").agg(*aggs).withColumnRenamed("target", "cluster_id")
    if "n_genomes" in nodes.columns and "genomes" in nodes.columns:
        merged = merged.withColumn("n_genomes", F.size("genomes").cast("long"))
    t = to.select("cluster_id", "target")
    wired = edges.join(t.withColumnsRenamed({"cluster_id": "src", "target": "s"}), "src", "left").join(t.withColumnsRenamed({"cluster_id": "dst", "target": "d"}), "dst", "left")
    wired = wired.withColumn("a", F.coalesce("s", "src")).withColumn("b", F.coalesce("d", "dst")).withColumn("moved", F.col("s").isNotNull() | F.col("d").isNotNull())
    kept = wired.where((F.col("a") != F.col("b")) | ~F.col("moved")).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "genomes")
    out = kept.groupBy("src", "dst").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("genomes")))).alias("genomes")).withColumn("support", F.size("genomes").cast("long"))
    return merged.select(*nodes.columns), out


def relabelled(nodes: DataFrame, edges: DataFrame, i: int) -> tuple[DataFrame, DataFrame]:
    """Ids of the i-th graph with the prefix g{i}_."""
    def name(c: str):
        return F.concat(F.lit(f"g{i}_"), c)

    return nodes.withColumn("cluster_id", name("cluster_id")), edges.withColumn("src", name("src")).withColumn("dst", name("dst"))


def upsert_edges(edges: DataFrame, new_pairs: DataFrame) -> DataFrame:
    """edges with the pairs (a, b, genome_id) added: existing ones gain genomes, others appear."""
    old = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.explode("genomes").alias("genome_id"))
    return edges_of(old.unionByName(new_pairs.select("a", "b", "genome_id")))
