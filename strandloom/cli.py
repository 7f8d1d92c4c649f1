"""Command line: the pipeline and its subcommands."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from strandloom import pipeline
from strandloom.config import MODES, SINKS, Config, StrandloomError
from strandloom.operators import association, clustering, combine, curves, graph, matrix, statistics, trees
from strandloom.session import builder
from strandloom.sinks import files as sink
from strandloom.sources import annotation, tables
from strandloom.sources import trees as tree_source


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("strandloom", description="Gene content and gene order of many genomes on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="annotation files to clusters, graph and outputs")
    run.add_argument("inputs", nargs="+")
    run.add_argument("-o", "--output", required=True)
    run.add_argument("--identity", type=float, default=0.98)
    run.add_argument("--family-identity", type=float, default=0.7)
    run.add_argument("--lengths", type=float, help="least share that the shorter sequence has of the longer; the identity, if not given")
    run.add_argument("--core", type=float, default=0.99)
    run.add_argument("--qc", nargs="*", default=[], help="quality reports, named as the genomes")
    run.add_argument("--mode", choices=MODES, default="default")
    run.add_argument("--formats", default="matrix,graph,json,summary", help=",".join(SINKS))
    run.add_argument("--merge-paralogs", action="store_true")
    run.add_argument("--no-refind", action="store_true")
    run.add_argument("--consensus", action="store_true")
    run.add_argument("--no-correction", action="store_true")
    run.add_argument("--min-cycles", type=int, default=5)
    fil = sub.add_parser("filter-pa", help="drop fragments, pseudogenes and length outliers from a gene table")
    fil.add_argument("gene_data")
    fil.add_argument("-o", "--output", required=True)
    fil.add_argument("--filters", default="fragment,pseudo,length")
    qc = sub.add_parser("qc", help="pass or fail by completeness and contamination reports")
    qc.add_argument("reports", nargs="+")
    qc.add_argument("-o", "--output", required=True)
    qc.add_argument("--mode", choices=MODES, default="default")
    qc.add_argument("--ani", help="pair table of identities for the plane of genomes")
    mer = sub.add_parser("merge", help="merge graph files")
    mer.add_argument("graphs", nargs="+")
    mer.add_argument("-o", "--output", required=True)
    mer.add_argument("--identity", type=float, default=0.9)
    ext = sub.add_parser("extract-gene", help="the sequence of one cluster")
    ext.add_argument("gene_data")
    ext.add_argument("cluster")
    ext.add_argument("--protein", action="store_true")
    ing = sub.add_parser("integrate", help="add a genome to a graph file")
    ing.add_argument("graph")
    ing.add_argument("inputs", nargs="+")
    ing.add_argument("-o", "--output", required=True)
    ing.add_argument("--identity", type=float, default=0.9)
    ana = sub.add_parser("analyze", help="statistics of saved outputs")
    ana.add_argument("--rtab", required=True)
    ana.add_argument("-o", "--output", required=True)
    ana.add_argument("--accumulation", action="store_true")
    ana.add_argument("--abundance", action="store_true")
    ana.add_argument("--itol", action="store_true")
    ana.add_argument("--profiles", action="store_true")
    ana.add_argument("--phenotypes")
    ana.add_argument("--structured", action="store_true", help="fit traits beside the genomes' places in the plane")
    ana.add_argument("--continuous", action="store_true", help="traits are numbers, not 0 or 1")
    ana.add_argument("--tree", help="Newick file of the genomes: gains and losses by branch")
    ana.add_argument("--epistasis", action="store_true")
    ana.add_argument("--graph")
    ana.add_argument("--neighbourhood")
    ana.add_argument("--depth", type=int, default=2)
    msa = sub.add_parser("msa", help="per-cluster sequences for an aligner")
    msa.add_argument("annotations", nargs="*")
    msa.add_argument("--gene-data", help="a saved gene table, in place of annotations")
    msa.add_argument("--matrix", help="the saved wide presence table")
    msa.add_argument("--core", action="store_true", help="core clusters only")
    msa.add_argument("-o", "--output", required=True)
    msa.add_argument("--identity", type=float, default=0.98)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    own = spark is None
    spark = spark or builder().getOrCreate()
    try:
        globals()["do_" + a.command.replace("-", "_")](spark, a)
        return 0
    except (StrandloomError, KeyError, ValueError) as wrong:
        print(f"strandloom: {wrong}", file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()


def do_run(spark, a) -> None:
    config = Config(a.output, a.identity, a.family_identity, a.mode, formats=tuple(a.formats.split(",")), merge_paralogs=a.merge_paralogs, refind=not a.no_refind, consensus=a.consensus, lengths=a.lengths, core=a.core, qc=tuple(a.qc), correct=not a.no_correction, min_cycles=a.min_cycles)
    for name, path in pipeline.run(spark, a.inputs, config).paths.items():
        print(f"{name}\t{path}")


def do_filter_pa(spark, a) -> None:
    rows = tables.gene_data(spark, a.gene_data).select("*", F.col("gene_id").alias("cluster_id"), F.col("protein_sequence").alias("protein"), F.length("dna_sequence").cast("long").alias("length"))
    sink.write_csv(matrix.filter_presence(rows, a.filters.split(",")).select(*tables.GENE_DATA), a.output)


def do_qc(spark, a) -> None:
    report = matrix.qc_passed(tables.quality_report(annotation.whole_files(spark, a.reports)), a.mode)
    sink.write_csv(report, f"{a.output}/qc.csv")
    sink.write_csv(matrix.qc_summary(report), f"{a.output}/qc_summary.csv")
    if a.ani:
        pairs = tables.ani_pairs(spark, a.ani).select(F.least("g1", "g2").alias("g1"), F.greatest("g1", "g2").alias("g2"), (1 - F.col("ani")).alias("distance")).where("g1 <> g2").dropDuplicates(["g1", "g2"])
        ids = sorted({x for r in pairs.select("g1", "g2").distinct().collect() for x in r})
        sink.write_csv(sink.distance_table(pairs, ids), f"{a.output}/distances.csv")
        plane = statistics.scaled_plane(pairs, ids)
        sink.write_csv(spark.createDataFrame(plane, "genome string, x double, y double"), f"{a.output}/mds.csv")
        sink.write_one(spark, f"{a.output}/mds.html", sink.plane_report(plane))
        sink.write_one(spark, f"{a.output}/qc.html", sink.quality_report_page(report, plane))


def _graph(spark, path: str):
    nodes, edges = tables.graph_markup(spark, path)
    return nodes, edges, nodes.select("cluster_id", "sequence")


def do_merge(spark, a) -> None:
    sink.write_graph(*combine.merge_graphs([_graph(spark, g) for g in a.graphs], a.identity), a.output)


def do_extract_gene(spark, a) -> None:
    row = tables.gene_data(spark, a.gene_data).where(F.col("gene_id") == a.cluster).first()
    if row is None:
        raise KeyError(f"no cluster {a.cluster!r}")
    print(f">{row['gene_id']} {row['annotation']}\n{row['protein_sequence' if a.protein else 'dna_sequence']}")


def do_integrate(spark, a) -> None:
    nodes, edges, seqs = _graph(spark, a.graph)
    genes = annotation.gff_genes(annotation.whole_files(spark, a.inputs))
    nodes, edges, placed = combine.integrate(nodes, edges, seqs, genes, a.identity)
    fresh = placed.where("new").groupBy("cluster_id").agg(F.min_by("sequence", "line_idx").alias("fresh"))
    sink.write_graph(nodes.join(fresh, "cluster_id", "left").withColumn("sequence", F.coalesce("sequence", "fresh")).drop("fresh"), edges, a.output)


def do_analyze(spark, a) -> None:
    presence = tables.rtab(spark, a.rtab).select("cluster_id", "genome_id")
    n = presence.select("genome_id").distinct().count()
    if a.accumulation:
        curve = curves.expected_curve(matrix.frequency_histogram(presence), n)
        sink.write_csv(curve.orderBy("k"), f"{a.output}/accumulation_curve.csv")
        sink.write_csv(curves.power_law(curve), f"{a.output}/power_law.csv")
    if a.abundance:
        sink.write_one(spark, f"{a.output}/abundance_report.html", sink.abundance_report(presence))
    if a.itol:
        sink.write_one(spark, f"{a.output}/itol_multibar.txt", "\n".join(sink.itol_strip(presence)))
        sink.write_one(spark, f"{a.output}/itol_binary.txt", "\n".join(sink.itol_binary(presence)))
        sink.write_one(spark, f"{a.output}/itol_colours.txt", "\n".join(sink.itol_colours(presence)))
    if a.profiles:
        ids = [r["cluster_id"] for r in matrix.most_variable(presence).collect()]
        sink.write_csv(matrix.genome_matrix(presence, ids), f"{a.output}/profiles.tsv", "\t")
    if a.phenotypes:
        traits = tables.phenotypes(spark, a.phenotypes, presence.select("genome_id").distinct()).where("value is not null")
        if not a.continuous and not traits.where("value not in (0, 1)").isEmpty():
            raise ValueError(f"a trait in {a.phenotypes} isn't 0 or 1: use --continuous")
        if a.structured or a.continuous:
            axes = None
            if a.structured:
                plane = statistics.scaled_plane(matrix.genome_pairs(presence), sorted(r["genome_id"] for r in presence.select("genome_id").distinct().collect()))
                axes = {g: (x, y) for g, x, y in plane}
            tested = association.structured_association(presence, traits, axes, a.continuous)
        else:
            tested = statistics.fisher(statistics.contingency(presence, traits), n)
        sink.write_csv(statistics.significant(statistics.false_discovery(tested, ["trait"])).orderBy("p_value", "cluster_id"), f"{a.output}/associations.csv")
    if a.tree:
        branches = trees.branch_changes(presence, tree_source.tree_file(spark, a.tree))
        sink.write_csv(branches.orderBy("node"), f"{a.output}/branch_changes.csv")
        sink.write_csv(trees.change_rates(branches).coalesce(1), f"{a.output}/panstripe_rates.csv")
    if a.epistasis:
        sink.write_csv(statistics.mutual_information(presence, n), f"{a.output}/mutual_information.csv")
    if a.neighbourhood:
        nodes, edges, _ = _graph(spark, a.graph)
        near, wires = graph.neighbourhood(nodes, edges, a.neighbourhood, a.depth)
        sink.write_csv(near.select("cluster_id", "support", "depth"), f"{a.output}/neighbourhood.csv")
        sink.write_graph(near.drop("depth"), wires, f"{a.output}/neighbourhood.gml")


def do_msa(spark, a) -> None:
    if a.gene_data:
        presence = tables.presence_csv(spark, a.matrix) if a.matrix else None
        rows = tables.alignment_groups(tables.gene_data(spark, a.gene_data), presence, tables.genome_count(spark, a.matrix) if a.matrix else 0, a.core)
        rows.select("cluster_id", F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")).repartition("cluster_id").write.mode("overwrite").partitionBy("cluster_id").text(a.output)
        return
    genes, _ = pipeline.read(spark, a.annotations)
    placed, centroids = pipeline.clustered(genes, a.identity)
    rows = clustering.alignment_rows(placed.select("cluster_id", "genome_id", F.col("ord").alias("line_idx"), "sequence"), centroids)
    rows.select("cluster_id", F.concat(F.lit(">"), "name", F.lit("\n"), "sequence").alias("value")).repartition("cluster_id").write.mode("overwrite").partitionBy("cluster_id").text(a.output)


if __name__ == "__main__":
    sys.exit(main())
