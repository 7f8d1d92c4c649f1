"""Combining graphs, and adding a genome to one."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions import sequence as seq
from strandloom.operators import clustering, graph
from strandloom.session import stored


def merge_graphs(graphs: list[tuple[DataFrame, DataFrame, DataFrame]], identity: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of several (nodes, edges, seqs), like centroids of different graphs merged."""
    parts = [(*graph.relabelled(n, e, i), s.withColumn("cluster_id", F.concat(F.lit(f"g{i}_"), "cluster_id"))) for i, (n, e, s) in enumerate(graphs)]
    nodes, edges, seqs = (functools.reduce(DataFrame.unionByName, frames) for frames in zip(*parts))
    seqs = stored(seqs, "centroids")
    named = seqs.select("cluster_id", "sequence")
    alike = clustering.best_match(named.withColumnRenamed("cluster_id", "query_id"), named, identity).where("query_id <> cluster_id")
    first = clustering.similar_pairs(named.withColumnRenamed("cluster_id", "ord"), identity, seq.identity_by_max)
    pairs = first.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(alike.select(F.least("query_id", "cluster_id").alias("src"), F.greatest("query_id", "cluster_id").alias("dst"))).distinct()
    across = pairs.where(F.substring_index("src", "_", 1) != F.substring_index("dst", "_", 1))
    return graph.merge(nodes, edges, across)


def integrate(nodes: DataFrame, edges: DataFrame, centroids: DataFrame, genes: DataFrame, identity: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, placement) with a new genome's genes added by their best protein match.

    genes as of gff_genes(); centroids(cluster_id, sequence) in nucleotides. An unmatched gene
    makes a node {genome_id}_{gene_id} of its own.
    """
    g = stored(genes.withColumn("row", F.monotonically_increasing_id()), "genes")
    proteins = g.where(F.length("sequence") > 0).select(F.col("row").alias("query_id"), seq.translate(F.col("sequence")).alias("sequence"))
    known = centroids.select("cluster_id", seq.translate(F.col("sequence")).alias("sequence"))
    match = stored(clustering.best_match(proteins, known, identity), "matches")
    placed = g.join(match.select(F.col("query_id").alias("row"), "cluster_id"), "row", "left").withColumn("new", F.col("cluster_id").isNull())
    placed = stored(placed.withColumn("cluster_id", F.coalesce("cluster_id", F.concat_ws("_", "genome_id", "gene_id"))), "placed")
    gained = placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("more"), F.collect_set("genome_id").alias("own"), F.collect_set("annotation").alias("notes"))
    old = nodes.join(gained, "cluster_id", "left")
    empty = F.array().cast("array<string>")
    cols = {"support": F.col("support") + F.coalesce("more", F.lit(0)), "genomes": F.sort_array(F.array_union("genomes", F.coalesce("own", empty)))}
    updated = old.withColumns(cols).select(*nodes.columns)
    fresh = gained.join(nodes.select("cluster_id"), "cluster_id", "left_anti")
    defaults = {"support": F.col("more"), "genomes": F.col("own"), "annotations": F.col("notes"), "n_genomes": F.size("own").cast("long")}
    made = fresh.select(*[F.col("cluster_id") if c == "cluster_id" else defaults[c].alias(c) if c in defaults else F.lit(False).alias(c) if k == "boolean" else F.array().cast(k).alias(c) if k.startswith("array") else F.lit(None).cast(k).alias(c) for c, k in nodes.dtypes])
    out = updated.unionByName(made)
    if "n_genomes" in nodes.columns:
        out = out.withColumn("n_genomes", F.size("genomes").cast("long"))
    pairs = graph.adjacent_pairs(placed, ["start", "line_idx"])
    return out, graph.upsert_edges(edges, pairs), placed
