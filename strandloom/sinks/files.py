"""Output files: matrices, graphs, sequences, annotations, summaries and reports.

Rows are rendered in Spark and written by it, so large outputs stay distributed. Only reports
of bounded size (a summary row, a histogram, a plane of genomes) pass through the driver.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as seq
from strandloom.functions import text as txt
from strandloom.operators import matrix
from strandloom.operators.numbering import numbered
from strandloom.sources.tables import METADATA


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, header=True, sep=sep)


def write_lines(df: DataFrame, path: str, compression: str = "none") -> None:
    """df has one string column; order within a file is the order of df's partitions."""
    df.write.mode("overwrite").text(path, compression=compression)


def write_one(spark: SparkSession, path: str, text: str) -> None:
    """A bounded report as one file."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def matrix_csv(presence: DataFrame, genomes: list[str], path: str) -> None:
    write_csv(matrix.binary_matrix(presence, genomes).withColumnRenamed("cluster_id", "Gene").orderBy("Gene"), path)


def matrix_rtab(presence: DataFrame, genomes: list[str], path: str) -> None:
    write_csv(matrix.binary_matrix(presence, genomes).withColumnRenamed("cluster_id", "Gene").orderBy("Gene"), path, "\t")


def metadata_table(members: DataFrame, nodes: DataFrame, genomes: list[str], gene_cells: bool) -> DataFrame:
    """The wide presence table: metadata columns, then a cell for each genome.

    A cell holds the gene ids of the genome joined by ';', or the cluster id.
    """
    cells = matrix.member_cells(members)
    if not gene_cells:
        cells = cells.withColumn("cell", F.col("cluster_id"))
    wide = cells.groupBy("cluster_id").pivot("genome_id", genomes).agg(F.first("cell")).na.fill("", genomes)
    sizes = members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("genes"), F.count_distinct("genome_id").alias("isolates"), *([F.min("length").alias("lo"), F.max("length").alias("hi"), F.avg("length").alias("mid")] if "length" in members.columns else [F.lit("").alias(c) for c in ("lo", "hi", "mid")]))
    note = F.coalesce(F.array_join("annotations", ";"), F.lit(""))
    rows = wide.join(sizes, "cluster_id").join(nodes.select("cluster_id", note.alias("note")), "cluster_id", "left")
    empty = F.lit("")
    values: list[Column] = [F.col("cluster_id"), empty, F.coalesce("note", empty), F.col("isolates"), F.col("genes"), F.round(F.col("genes") / F.col("isolates"), 2), *[empty] * 5, F.col("lo"), F.col("hi"), F.col("mid")]
    return rows.select(*[v.alias(n) for v, n in zip(values, METADATA)], *[F.col(f"`{g}`") for g in genomes])


def graph_markup(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks of a graph file in order: a header, the nodes by id, the edges, a footer; one row is a whole block.

    Rows are ordered by ranges, so the text is written by many tasks. Line breaks in a value become
    spaces, as a value is a line; of several annotations the first is written.
    """
    have = set(nodes.columns)
    empty = F.array().cast("array<string>")

    def given(value: Column, line: Column) -> Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(line, F.lit("\n"))).otherwise("")

    def quoted(name: str, value: Column) -> Column:
        flat = txt.gml_escape(F.regexp_replace(F.coalesce(value, F.lit("")), r"[\r\n]+", " "))
        return F.concat(F.lit(f'    {name} "'), flat, F.lit('"'))

    def number(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"    {name} "), F.coalesce(value.cast("string"), F.lit("0")), F.lit("\n"))

    def block(name: str) -> Column:
        entries = F.array_join(F.transform(F.coalesce(name, empty), lambda g: F.concat(F.lit('      "'), g, F.lit('"\n'))), "")
        return F.when(F.size(F.coalesce(name, empty)) > 0, F.concat(F.lit(f"    {name} [\n"), entries, F.lit("    ]\n"))).otherwise("")

    def joined(name: str, by: str) -> Column:
        return F.array_join(F.coalesce(name, empty), by)

    parts = [quoted("id", F.col("cluster_id")), F.lit("\n"), quoted("label", F.col("cluster_id")), F.lit("\n"), number("support", F.col("support"))]
    parts += [number(c, F.coalesce(F.col(c), F.lit(False)).cast("int")) for c in ("is_paralog", "is_highly_variable") if c in have]
    if "sequence" in have:
        dna = F.coalesce("sequence", F.lit(""))
        protein = seq.translate(dna)
        parts += [number("length", F.length(dna)), given(dna, quoted("seq", dna)), given(protein, quoted("protein", protein))]
    parts += [block("genomes")] if "genomes" in have else []
    lists = [(name, joined(c, by)) for name, c, by in (("member", "members", ";"), ("contig_end_genomes", "contig_end_genomes", ",")) if c in have]
    parts += [given(value, quoted(name, value)) for name, value in lists]
    note = F.get(F.sort_array("annotations"), F.lit(0)) if "annotations" in have else F.col("annotation") if "annotation" in have else None
    parts += [] if note is None else [given(note, quoted("annotation", note))]
    node = nodes.select(F.lit(1).alias("part"), F.col("cluster_id").alias("k"), F.concat(F.lit("  node [\n"), *parts, F.lit("  ]")).alias("value"))
    ends = [quoted("source", F.col("src")), F.lit("\n"), quoted("target", F.col("dst")), F.lit("\n"), number("support", F.col("support")), block("genomes")]
    edge = edges.select(F.lit(2).alias("part"), F.concat_ws("~", "src", "dst").alias("k"), F.concat(F.lit("  edge [\n"), *ends, F.lit("  ]")).alias("value"))
    frame = nodes.sparkSession.createDataFrame([(0, "", "graph [\n  directed 0"), (3, "", "]")], "part int, k string, value string")
    return frame.unionByName(node).unionByName(edge).orderBy("part", "k").select("value")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A folder whose parts, in the order of their names, are the graph file; a block lies in one part."""
    write_lines(graph_markup(nodes, edges), path)


def summary_json(presence: DataFrame, core: float = matrix.CORE) -> DataFrame:
    """One row of JSON: genomes, clusters, core, accessory."""
    c = matrix.core_accessory(presence, core)
    n = presence.agg(F.count_distinct("genome_id").alias("num_genomes"), F.count_distinct("cluster_id").alias("num_clusters"))
    return n.crossJoin(F.broadcast(c)).select(F.to_json(F.struct("num_genomes", "num_clusters", F.col("n_core").alias("core"), F.col("n_accessory").alias("accessory"))).alias("value"))


def cluster_json(nodes: DataFrame) -> DataFrame:
    """A JSON line for each cluster by support."""
    return nodes.orderBy(F.desc("support"), "cluster_id").select(F.to_json(F.struct("cluster_id", "support", "n_genomes")).alias("value"))


def gene_table(nodes: DataFrame, representatives: DataFrame) -> DataFrame:
    """The ten columns of the gene table; representatives(cluster_id, contig, start, end, strand, sequence)."""
    note = F.coalesce(F.nullif(F.array_join("annotations", ";"), F.lit("")), F.lit("hypothetical protein"))
    rows = nodes.join(representatives, "cluster_id", "left")
    dna = F.coalesce("sequence", F.lit(""))
    return rows.select(
        F.col("cluster_id").alias("gene_id"), F.col("cluster_id").alias("gene_name"), note.alias("annotation"), F.coalesce("contig", F.lit("NA")).alias("contig"),
        "start", "end", "strand", "support", dna.alias("dna_sequence"), seq.translate(dna).alias("protein_sequence"),
    )


def fasta_lines(rows: DataFrame, protein: bool = False) -> DataFrame:
    """>id note and the sequence, of (gene_id, annotation, dna_sequence or protein_sequence)."""
    body = F.col("protein_sequence" if protein else "dna_sequence")
    return rows.where(F.length(body) > 0).orderBy("gene_id").select(F.concat(F.lit(">"), F.col("gene_id"), F.lit(" "), F.col("annotation"), F.lit("\n"), body).alias("value"))


def annotation_lines(genes: DataFrame) -> DataFrame:
    """(genome_id, value): annotation lines of each genome, to be written by genome in order.

    genes have cluster_id; a gene without a cluster is of cluster 'unknown'.
    """
    attrs = F.concat_ws(";", F.concat(F.lit("ID="), txt.gff_escape(F.col("gene_id"))), F.concat(F.lit("cluster="), txt.gff_escape(F.coalesce("cluster_id", F.lit("unknown")))), F.concat(F.lit("product="), txt.gff_escape(F.col("annotation"))))
    line = F.concat_ws("\t", F.col("contig").cast("string"), F.lit("strandloom"), F.lit("CDS"), F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."), F.col("strand"), F.lit("0"), attrs)
    return genes.select(txt.file_safe(F.col("genome_id")).alias("genome_id"), "contig", "start", line.alias("value"))


def write_annotations(genes: DataFrame, path: str) -> None:
    rows = annotation_lines(genes).repartition("genome_id").sortWithinPartitions("genome_id", "contig", "start")
    rows.select("genome_id", "value").write.mode("overwrite").partitionBy("genome_id").text(path)


def write_parquet_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Two tables, nodes and edges, under the path."""
    nodes.select("cluster_id", F.col("support").cast("int").alias("support"), "is_paralog", F.size("genomes").alias("genome_count")).write.mode("overwrite").parquet(f"{path}/nodes")
    edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), F.col("support").cast("int").alias("support"), F.size("genomes").alias("genome_count")).write.mode("overwrite").parquet(f"{path}/edges")


def resistance_annotation(table: DataFrame) -> DataFrame:
    """Annotation lines of a gene table, as a resistance search wants them; ';' and '=' become entities."""
    def entity(c: str) -> Column:
        return F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(";"), F.lit("&semicolon;")), F.lit("="), F.lit("&equals;"))

    attrs = F.concat(F.lit("ID="), "gene_id", F.lit(";product="), entity("annotation"), F.lit(";gene="), entity("gene_name"))
    return table.select(F.concat_ws("\t", F.coalesce("contig", F.lit("unknown")).cast("string"), F.lit("strandloom"), F.lit("gene"), F.coalesce(F.col("start").cast("string"), F.lit("0")), F.coalesce(F.col("end").cast("string"), F.lit("0")), F.lit("."), F.coalesce("strand", F.lit("+")), F.lit("."), attrs).alias("value"))


def alignment_lines(rows: DataFrame, width: int = 80) -> DataFrame:
    """>name and the sequence in lines of the width, of (cluster_id, name, sequence) in that order."""
    body = F.rtrim(F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), F.lit("\n"))
    return rows.orderBy("cluster_id", "name").select(F.concat(F.lit(">"), "name", F.lit("\n"), body).alias("value"))


def core_alignment(rows: DataFrame, presence: DataFrame, core: bool = True) -> DataFrame:
    """The rows (cluster_id, name, sequence) of clusters at the core threshold, or of the others."""
    counts = matrix.with_share(presence)
    least = F.greatest(F.lit(1), F.ceil(F.lit(matrix.CORE) * F.col("n_total")))
    wanted = counts.where(F.col("n_genomes") >= least if core else F.col("n_genomes") < least).select("cluster_id")
    return rows.join(wanted, "cluster_id", "left_semi")


def variant_rows(variants: DataFrame) -> DataFrame:
    """A numbered row for each variant, by type and clusters; the fourth column has the clusters in brackets, the last the genomes."""
    kind = F.when(F.col("kind") == "tandem_duplication", "DUPLICATION").otherwise(F.upper("kind"))
    rows = variants.select(kind.alias("VariantType"), F.col("support").alias("Support"), F.concat(F.lit("["), F.array_join("clusters", ";"), F.lit("]")).alias("Genomes"), F.array_join("genomes", ";").alias("Carriers"))
    found = numbered(rows, [F.col("VariantType"), F.col("Genomes"), F.col("Carriers"), F.col("Support")], "n")
    return found.select(F.concat(F.lit("SV_"), (F.col("n") + 1).cast("string")).alias("ID"), *rows.columns)


#: The prefixes of variant ids.
VARIANT_PREFIX = {"inversion": "INV", "duplication": "DUP", "tandem_duplication": "DUP", "translocation": "TRA", "deletion": "DEL"}


def variant_matrix(variants: DataFrame, genomes: list[str]) -> DataFrame:
    """A row for each variant, 0/1 for each genome."""
    from pyspark.sql import Window

    prefix = F.create_map(*[F.lit(x) for p in VARIANT_PREFIX.items() for x in p])[F.col("kind")]
    n = F.row_number().over(Window.partitionBy("prefix").orderBy(F.array_join("clusters", ";"), "kind"))
    rows = variants.withColumn("prefix", prefix).withColumn("variant", F.concat_ws("_", "prefix", n.cast("string")))
    wide = rows.select("variant", F.explode("genomes").alias("genome_id")).groupBy("variant").pivot("genome_id", genomes).agg(F.lit(1))
    return wide.na.fill(0)


def summary_text(presence: DataFrame, variable: int = 0) -> str:
    """Bands and totals; at most a handful of lines."""
    found = {r["band"]: r["n_clusters"] for r in matrix.partition_summary(presence).collect()}
    rows = [("Core genes (>= 99%)", "core"), ("Soft core genes (95-99%)", "soft_core"), ("Shell genes (15-95%)", "shell"), ("Cloud genes (0-15%)", "cloud")]
    lines = [f"{title}: {found.get(key, 0)}" for title, key in rows]
    return "\n".join([*lines, f"Total genes: {sum(found.values())}", f"Highly variable genes: {variable}"])


def distance_table(pairs: DataFrame, genomes: list[str]) -> DataFrame:
    """The square table of distances, one row per genome."""
    both = pairs.select("g1", "g2", "distance").unionByName(pairs.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), "distance"))
    return both.groupBy(F.col("g1").alias("genome")).pivot("g2", genomes).agg(F.first("distance")).na.fill(0.0)


def itol_strip(presence: DataFrame) -> list[str]:
    """A bar of core and accessory counts for each genome, in the annotation text format."""
    head = ["DATASET_MULTIBAR", "SEPARATOR COMMA", "DATASET_LABEL,Core and accessory genes", "COLOR,#1f77b4", "FIELD_LABELS,core,accessory", "FIELD_COLORS,#1f77b4,#ff7f0e", "DATA"]
    return head + [f"{r['genome_id']},{r['n_core']},{r['n_accessory']}" for r in matrix.genome_profile(presence).orderBy("genome_id").collect()]


def itol_colours(presence: DataFrame) -> list[str]:
    """A colour for each genome by its share of accessory clusters: low, middle, high."""
    head = ["DATASET_COLORSTRIP", "SEPARATOR COMMA", "DATASET_LABEL,Share of accessory genes", "COLOR,#d62728", "DATA"]
    share = F.col("n_accessory") / (F.col("n_core") + F.col("n_accessory"))
    colour = F.when(share < 1 / 3, "#1f77b4").when(share < 2 / 3, "#ff7f0e").otherwise("#d62728")
    return head + [f"{r['genome_id']},{r['c']}" for r in matrix.genome_profile(presence).select("genome_id", colour.alias("c")).orderBy("genome_id").collect()]


def itol_binary(presence: DataFrame, n: int = 50) -> list[str]:
    """Presence of the n most variable clusters in each genome."""
    top = [r["cluster_id"] for r in matrix.most_variable(presence, n).collect()]
    wide = matrix.genome_matrix(presence.where(F.col("cluster_id").isin(top)), top)
    head = ["DATASET_BINARY", "SEPARATOR COMMA", "DATASET_LABEL,Most variable genes", "COLOR,#2ca02c", "FIELD_SHAPES," + ",".join("1" for _ in top), "FIELD_LABELS," + ",".join(top), "DATA"]
    return head + [",".join([r["genome_id"], *(str(r[c]) for c in top)]) for r in wide.orderBy("genome_id").collect()]


def report_html(title: str, tables: dict[str, list[dict]]) -> str:
    """A page with a table for each bounded list of rows, and the rows as JSON."""
    body = []
    for name, rows in tables.items():
        cols = list(rows[0]) if rows else []
        head = "".join(f"<th>{html.escape(str(c))}</th>" for c in cols)
        lines = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in cols) + "</tr>" for r in rows)
        body.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{lines}</table>")
    data = json.dumps(tables, default=str).replace("</", "<\\/")
    return f"<!doctype html><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{''.join(body)}<script type='application/json' id='data'>{data}</script>"


def graph_report(nodes: DataFrame, edges: DataFrame, genomes: int, most: int = 2000) -> str:
    """A page of the best supported nodes and the edges among them: a report, so at most `most` nodes."""
    from strandloom.operators.graph import induced_edges

    top = nodes.orderBy(F.desc("support"), "cluster_id").limit(most)
    cols = [c for c in ("cluster_id", "support", "is_paralog", "is_highly_variable") if c in nodes.columns]
    shown = top.select(*cols, F.size("genomes").alias("genome_count"), (F.size("genomes") == genomes).alias("is_core"))
    wired = induced_edges(edges, top).orderBy(F.desc("support"), "src", "dst").limit(10 * most).select(F.col("src").alias("source"), F.col("dst").alias("target"), "support")
    return report_html("Gene graph", {"Nodes": [r.asDict() for r in shown.collect()], "Edges": [r.asDict() for r in wired.collect()]})


def quality_report_page(report: DataFrame, plane: list[tuple[str, float, float]] | None = None) -> str:
    """A page of the quality summary and each genome (one row per genome), and their plane if given."""
    tables = {"Summary": [r.asDict() for r in matrix.qc_summary(report).collect()], "Genomes": [r.asDict() for r in report.orderBy("genome_id").collect()]}
    if plane:
        tables["Plane"] = [{"genome": g, "x": x, "y": y} for g, x, y in plane]
    return report_html("Assembly quality", tables)


def plane_report(plane: list[tuple[str, float, float]]) -> str:
    return report_html("Genomes by distance", {"Plane": [{"genome": g, "x": x, "y": y} for g, x, y in plane]})


def abundance_report(presence: DataFrame) -> str:
    return report_html("Gene abundance", {"Bands": [r.asDict() for r in matrix.partition_summary(presence).orderBy("band").collect()], "Families by number of genomes": [r.asDict() for r in matrix.frequency_histogram(presence).orderBy("n_genomes").collect()]})
