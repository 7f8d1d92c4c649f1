"""From annotation files to clusters, a corrected graph, and outputs."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import Config, InputError
from strandloom.operators import clustering, correction, features, graph, matrix
from strandloom.session import stored
from strandloom.sinks import files as sink
from strandloom.sources import annotation, tables

log = logging.getLogger(__name__)
ORDER = ["start", "line_idx"]


@dataclass
class Result:
    genes: DataFrame
    placed: DataFrame
    nodes: DataFrame
    edges: DataFrame
    presence: DataFrame
    centroids: DataFrame
    variants: DataFrame
    paths: dict[str, str]


def read(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(genes, contigs) of annotation files."""
    found = annotation.whole_files(spark, paths)
    genes = stored(annotation.gff_genes(found), "genes")
    if genes.isEmpty():
        raise InputError("no gene in the inputs")
    return genes, stored(annotation.gff_contigs(found), "contigs")


def passed(genes: DataFrame, contigs: DataFrame, reports: tuple[str, ...], mode: str) -> tuple[DataFrame, DataFrame]:
    """genes and contigs of the genomes whose quality report passes, or that have none."""
    qc = matrix.qc_passed(tables.quality_report(annotation.whole_files(genes.sparkSession, list(reports))), mode)
    gone = stored(qc.where(~F.col("passed")).select("genome_id"), "failed")
    kept = stored(genes.join(gone, "genome_id", "left_anti").select(*genes.columns), "genes")
    if kept.isEmpty():
        raise InputError("no genome passes the quality reports")
    return kept, stored(contigs.join(gone, "genome_id", "left_anti").select(*contigs.columns), "contigs")


def clustered(genes: DataFrame, identity: float, lengths: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed, centroids): greedy clusters in file and line order. Genes are keyed by row, not by id."""
    keyed = stored(genes.withColumn("ord", F.col("file_idx").cast("long") * F.lit(1 << 40) + F.col("line_idx")), "ordered")
    found = stored(clustering.greedy_clusters(keyed.select("ord", "sequence"), identity, lengths), "clusters")
    centroids = found.where("ord = centroid").join(keyed.select("ord", "sequence"), "ord").select("cluster_id", "sequence")
    return stored(keyed.join(found.select("ord", "cluster_id"), "ord"), "placed"), stored(centroids, "centroids")


def corrected(nodes: DataFrame, edges: DataFrame, presence: DataFrame, centroids: DataFrame, contigs: DataFrame, genomes: int, config: Config) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, presence) after the correction steps in their order."""
    if config.merge_paralogs:
        nodes, edges = correction.resolve_paralogs(nodes, edges, centroids)
    nodes, edges = correction.remove_contamination(nodes, edges, correction.contamination_threshold(config.mode, genomes))
    nodes, edges = correction.correct_mistranslations(nodes, edges, centroids)
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    levels = tuple(t for t in correction.COLLAPSE_THRESHOLDS if t >= config.family_identity)
    nodes, edges = correction.collapse_families(nodes, edges, centroids, levels)
    nodes, edges = correction.prune_contig_ends(nodes, edges, correction.contig_end_threshold(config.mode, genomes))
    presence = nodes.select("cluster_id", F.explode("genomes").alias("genome_id")).distinct()
    if config.refind:
        nodes, presence = correction.recover_missing(nodes, edges, presence, centroids, contigs, config.consensus and config.mode == "strict", config.compat_refind)
        nodes, presence = stored(nodes, "nodes"), stored(presence, "presence")
        edges = stored(graph.induced_edges(edges, nodes), "edges")
    edges = correction.clean_misassembly(nodes, edges, correction.misassembly_threshold(config.mode, genomes))
    return nodes, stored(edges, "edges"), presence


def run(spark: SparkSession, paths: list[str], config: Config) -> Result:
    config.validate()
    genes, contigs = read(spark, paths)
    if config.qc:
        genes, contigs = passed(genes, contigs, config.qc, config.mode)
    placed, centroids = clustered(genes, config.identity, config.lengths)
    nodes, edges = graph.build(placed, ORDER)
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    presence = placed.select("cluster_id", "genome_id").distinct()
    genomes = genes.select("genome_id").distinct().count()
    sink.write_graph(nodes, edges, f"{config.output}/pre_correction_graph.gml")
    if config.correct:
        nodes, edges, presence = corrected(nodes, edges, presence, centroids, contigs, genomes, config)
    nodes = stored(features.highly_variable(nodes, edges, config.min_cycles), "nodes")
    live = placed.join(nodes.select("cluster_id"), "cluster_id", "left_semi")
    variants = stored(features.structural_variants(nodes, edges, graph.adjacent_pairs(live, ORDER)), "variants")
    result = Result(genes, placed, nodes, edges, presence, centroids, variants, {})
    result.paths = write(result, config)
    return result


def write(r: Result, config: Config) -> dict[str, str]:
    """Write the asked formats; the summary always. One that fails is logged and left out."""
    ids = [x["genome_id"] for x in r.genes.select("genome_id").distinct().orderBy("genome_id").collect()]
    members = r.placed.select("cluster_id", "genome_id", "gene_id", F.length("sequence").alias("length"))
    first = r.placed.groupBy("cluster_id").agg(F.min_by(F.struct("contig", "start", "end", "strand", "sequence"), "ord").alias("x")).select("cluster_id", "x.*")
    spark, out = r.genes.sparkSession, config.output
    table = sink.gene_table(r.nodes, first)
    jobs = {
        "summary": ("summary_statistics.txt", lambda p: sink.write_one(spark, p, sink.summary_text(r.presence, r.nodes.where("is_highly_variable").count()))),
        "matrix": ("gene_presence_absence.csv", lambda p: sink.matrix_csv(r.presence, ids, p)),
        "rtab": ("gene_presence_absence.Rtab", lambda p: sink.matrix_rtab(r.presence, ids, p)),
        "csv": ("gene_presence_absence_roary.csv", lambda p: sink.write_csv(sink.metadata_table(members, r.nodes, ids, True), p)),
        "genes": ("gene_data.csv", lambda p: sink.write_csv(table, p)),
        "graph": ("final_graph.gml", lambda p: sink.write_graph(r.nodes.join(r.centroids, "cluster_id", "left"), r.edges, p)),
        "json": ("summary.json", lambda p: sink.write_lines(sink.summary_json(r.presence, config.core), p)),
        "jsonl": ("clusters.jsonl", lambda p: sink.write_lines(sink.cluster_json(r.nodes), p)),
        "fasta": ("pan_genome_reference.fa", lambda p: sink.write_lines(sink.fasta_lines(table), p)),
        "gff": ("gff", lambda p: sink.write_annotations(r.placed, p)),
        "parquet": ("matrix.parquet", lambda p: matrix.binary_matrix(r.presence, ids).write.mode("overwrite").parquet(p)),
        "variants": ("structural_variants.csv", lambda p: sink.write_csv(sink.variant_rows(r.variants), p)),
        "variant_matrix": ("structural_variants_matrix.tsv", lambda p: sink.write_csv(sink.variant_matrix(r.variants, ids), p, "\t")),
        "dna": ("clusters_dna.fa", lambda p: sink.write_lines(sink.fasta_lines(table), p)),
        "protein": ("clusters_protein.fa", lambda p: sink.write_lines(sink.fasta_lines(table, True), p)),
        "graph_parquet": ("graph.parquet", lambda p: sink.write_parquet_graph(r.nodes, r.edges, p)),
        "resistance_gff": ("genes_for_resistance.gff", lambda p: sink.write_lines(sink.resistance_annotation(table), p)),
        "graph_html": ("graph_report.html", lambda p: sink.write_one(spark, p, sink.graph_report(r.nodes, r.edges, len(ids)))),
        "html": ("abundance_report.html", lambda p: sink.write_one(spark, p, sink.abundance_report(r.presence))),
    }
    done = {}
    for name in dict.fromkeys(("summary", *config.formats)):
        file, job = jobs[name]
        try:
            job(f"{out}/{file}")
            done[name] = f"{out}/{file}"
        except (OSError, PySparkException, Py4JJavaError) as broken:
            log.warning("%s was not written: %s", name, str(broken).partition("\n")[0])
    return done
