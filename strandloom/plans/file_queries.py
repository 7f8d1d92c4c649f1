"""Queries of the readers and writers: tables go out through a sink and come back through a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import text as txt
from strandloom.operators import graph, matrix, statistics
from strandloom.plans import graph_queries, matrix_queries, tpch
from strandloom.plans.functions_queries import DNA_SQL, dna
from strandloom.plans.matrix_queries import GENOMES, SHARE, TRAITS
from strandloom.plans.tpch import EDGES_SQL, NODES_SQL, ORDER, PLACED_SQL, PRESENCE_SQL
from strandloom.session import fresh_path, stored
from strandloom.sinks import files as sink
from strandloom.sources import annotation, tables
from strandloom.streaming import arrivals

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def written(spark: SparkSession, rows: DataFrame, name: str, compression: str = "none") -> str:
    """The path of the rows' one string column as lines."""
    path = fresh_path(spark, name)
    sink.write_lines(rows, path, compression)
    return path


def wide_csv(spark: SparkSession, d: str, gene_cells: bool) -> str:
    placed = stored(tpch.placed(spark, d).select("cluster_id", "genome_id", F.concat(F.lit("g"), "gene_id").alias("gene_id"), "annotation"), "placed")
    notes = placed.groupBy("cluster_id").agg(F.sort_array(F.collect_set("annotation")).alias("annotations"))
    path = fresh_path(spark, "wide")
    sink.write_csv(sink.metadata_table(placed.drop("annotation"), notes, GENOMES, gene_cells), path)
    return path


@query(f"WITH {PLACED_SQL} SELECT cluster_id, genome_id, string_agg('g' || gene_id, ';' ORDER BY 'g' || gene_id) AS cell FROM placed GROUP BY 1, 2")
def wide_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tables.presence_csv(spark, wide_csv(spark, d, True))


@query(f"WITH {PRESENCE_SQL} SELECT cluster_id, genome_id, cluster_id AS cell, 25 AS genomes FROM presence")
def cluster_cells_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = wide_csv(spark, d, False)
    return tables.presence_csv(spark, path).withColumn("genomes", F.lit(tables.genome_count(spark, path)))


@query(f"WITH {PLACED_SQL} SELECT genome_id, count(*) AS n_genes, count(DISTINCT cluster_id) AS n_clusters FROM placed GROUP BY 1")
def genes_per_genome(spark: SparkSession, d: str) -> DataFrame:
    cells = tables.presence_csv(spark, wide_csv(spark, d, True))
    return cells.groupBy("genome_id").agg(F.sum(F.size(F.split("cell", ";"))).alias("n_genes"), F.count(F.lit(1)).alias("n_clusters"))


@query(f"WITH {PRESENCE_SQL} SELECT cluster_id, genome_id FROM presence")
def rtab_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "rtab")
    sink.matrix_rtab(tpch.presence(spark, d), GENOMES, path)
    return tables.rtab(spark, path).select("cluster_id", "genome_id")


def graph_file(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = fresh_path(spark, "graph")
    sink.write_graph(*graph_queries.built(spark, d), path)
    return tables.graph_markup(spark, path)


@query(f"WITH {NODES_SQL} SELECT cluster_id, support, n_genomes, is_paralog, CAST(n_ends AS BIGINT) AS n_ends FROM nodes")
def graph_file_nodes(spark: SparkSession, d: str) -> DataFrame:
    size = lambda c: F.size(c).cast("long")
    return graph_file(spark, d)[0].select("cluster_id", "support", size("genomes").alias("n_genomes"), "is_paralog", size("contig_end_genomes").alias("n_ends"))


@query(f"WITH {EDGES_SQL} SELECT src, dst, array_to_string(genomes, ',') AS genomes, support FROM edges")
def graph_file_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_file(spark, d)[1].withColumn("genomes", F.array_join("genomes", ","))


def graph_text(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A graph file of parts and of suppliers' parts, its lines put together here: brackets, quotes and backslashes in names."""
    part, supplied = tpch.table(spark, d, "part"), tpch.table(spark, d, "lineitem")
    node = F.concat(
        F.lit('  node [\n    id "p'), "p_partkey", F.lit('"\n    label "p'), "p_partkey", F.lit('"\n    support '), "p_size", F.lit("\n    is_paralog "), F.col("p_size") % 2,
        F.lit('\n    is_highly_variable 0\n    length 4\n    seq "ACGT,AC"\n    genomes [\n      "a'), F.col("p_partkey") % 7, F.lit('"\n      "b'), F.col("p_size") % 3,
        F.lit('"\n    ]\n    member "m1;m'), "p_partkey", F.lit('"\n    annotation "[Fe] \\\\ \\"'), "p_type", F.lit('\\" ['), "p_name", F.lit(']"\n  ]'),
    )
    wires = supplied.select((F.col("l_partkey")).alias("a"), F.col("l_suppkey").alias("b")).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    edge = F.concat(F.lit('  edge [\n    source "p'), "a", F.lit('"\n    target "p'), "b", F.lit('"\n    support '), "n", F.lit('\n    genomes [\n      "g'), F.col("a") % 5, F.lit('"\n    ]\n  ]'))
    return tables.graph_markup(spark, written(spark, part.select(node.alias("value")).unionByName(wires.select(edge.alias("value"))), "markup", "gzip"))


@query("""SELECT 'p' || p_partkey AS cluster_id, CAST(p_size AS BIGINT) AS support, p_size % 2 = 1 AS is_paralog, 'a' || p_partkey % 7 || ',b' || p_size % 3 AS genomes, 'm1;m' || p_partkey AS members, '[Fe] \\ "' || p_type || '" [' || p_name || ']' AS annotation, 'ACGT' AS sequence FROM part""")
def graph_text_nodes(spark: SparkSession, d: str) -> DataFrame:
    n = graph_text(spark, d)[0]
    return n.select("cluster_id", "support", "is_paralog", F.array_join("genomes", ",").alias("genomes"), F.array_join("members", ";").alias("members"), "annotation", "sequence")


@query("SELECT least('p' || l_partkey, 'p' || l_suppkey) AS src, greatest('p' || l_partkey, 'p' || l_suppkey) AS dst, count(*) AS support, 'g' || l_partkey % 5 AS genomes FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY l_partkey, l_suppkey")
def graph_text_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph_text(spark, d)[1].withColumn("genomes", F.array_join("genomes", ","))


@query(f"WITH {NODES_SQL} SELECT cluster_id, CAST(support AS INTEGER) AS support, is_paralog, CAST(n_genomes AS INTEGER) AS genome_count FROM nodes")
def parquet_nodes(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "graph")
    sink.write_parquet_graph(*graph_queries.built(spark, d), path)
    return spark.read.parquet(f"{path}/nodes")


@query(f'WITH {EDGES_SQL} SELECT src AS "from", dst AS "to", CAST(support AS INTEGER) AS support, CAST(support AS INTEGER) AS genome_count FROM edges')
def parquet_edges(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "graph")
    sink.write_parquet_graph(*graph_queries.built(spark, d), path)
    return spark.read.parquet(f"{path}/edges")


#: Nucleotides out of a cluster's name.
NAME_DNA = "translate(regexp_replace(lower({c}), '[^aeioulnr]', '', 'g'), 'aeioulnr', 'ACGTACGT')"
FIRSTS_SQL = PLACED_SQL + f""", firsts AS (SELECT cluster_id, contig, start, annotation, {NAME_DNA.format(c='cluster_id')} AS dna FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY contig, start, tie1, tie2, tie3, tie4) AS k FROM placed) WHERE k = 1),
notes AS (SELECT cluster_id, count(*) AS support, array_to_string(list_sort(list(DISTINCT annotation)), ';') AS annotation FROM placed GROUP BY 1)"""


def name_dna(c: str):
    return F.translate(F.regexp_replace(F.lower(c), "[^aeioulnr]", ""), "aeioulnr", "ACGTACGT")


def gene_rows(spark: SparkSession, d: str) -> DataFrame:
    placed = stored(tpch.placed(spark, d), "placed")
    first = placed.groupBy("cluster_id").agg(F.min_by(F.struct("contig", "start"), F.struct("contig", *ORDER)).alias("x"))
    reps = first.select("cluster_id", F.col("x.contig").cast("string").alias("contig"), F.col("x.start").alias("start"), (F.col("x.start") + 9).alias("end"), F.lit("+").alias("strand"), name_dna("cluster_id").alias("sequence"))
    nodes = placed.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("support"), F.sort_array(F.collect_set("annotation")).alias("annotations"))
    return sink.gene_table(nodes, reps)


@query(f"WITH {FIRSTS_SQL} SELECT cluster_id AS gene_id, notes.annotation, CAST(contig AS VARCHAR) AS contig, CAST(start AS VARCHAR) AS start, CAST(support AS VARCHAR) AS support, dna AS dna_sequence FROM firsts JOIN notes USING (cluster_id)")
def gene_table_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "genes")
    sink.write_csv(gene_rows(spark, d), path)
    return tables.gene_data(spark, path).select("gene_id", "annotation", "contig", "start", "support", "dna_sequence")


@query(f"WITH {FIRSTS_SQL} SELECT cluster_id || ' ' || notes.annotation AS header, dna AS sequence FROM firsts JOIN notes USING (cluster_id) WHERE dna <> ''")
def fasta_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = written(spark, sink.fasta_lines(gene_rows(spark, d)), "fasta")
    return annotation.fasta_records(spark.read.text(path, wholetext=True)).select("header", "sequence")


@query(f"""WITH {FIRSTS_SQL} SELECT CAST(contig AS VARCHAR) || chr(9) || 'strandloom' || chr(9) || 'gene' || chr(9) || start || chr(9) || (start + 9) || chr(9) || '.' || chr(9) || '+' || chr(9) || '.' || chr(9) || 'ID=' || cluster_id || ';product=' || replace(replace(notes.annotation, ';', '&semicolon;'), '=', '&equals;') || ';gene=' || cluster_id AS value FROM firsts JOIN notes USING (cluster_id)""")
def resistance_annotation(spark: SparkSession, d: str) -> DataFrame:
    return sink.resistance_annotation(gene_rows(spark, d))


@query(f"""WITH {FIRSTS_SQL}, presence AS (SELECT DISTINCT cluster_id, genome_id FROM placed), n AS (SELECT cluster_id, count(*) AS n FROM presence GROUP BY 1)
SELECT cluster_id, cluster_id || '__' || genome_id AS name, dna AS sequence FROM presence JOIN firsts USING (cluster_id) JOIN notes USING (cluster_id) JOIN n USING (cluster_id) WHERE dna <> '' AND n >= 2 AND support >= 25""")
def alignment_groups(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "genes")
    sink.write_csv(gene_rows(spark, d), path)
    return tables.alignment_groups(tables.gene_data(spark, path), tables.presence_csv(spark, wide_csv(spark, d, True)), 25, core=True)


@query(f"""WITH {SHARE} SELECT cluster_id, genome_id AS name, {NAME_DNA.format(c="cluster_id || cluster_id || cluster_id || cluster_id || genome_id")} AS sequence FROM presence JOIN shares USING (cluster_id) WHERE n_genomes >= greatest(1, ceil(0.99 * n_total))""")
def core_alignment(spark: SparkSession, d: str) -> DataFrame:
    p = tpch.presence(spark, d)
    rows = p.select("cluster_id", F.col("genome_id").alias("name"), F.concat(*["cluster_id"] * 4, "genome_id").alias("text")).withColumn("sequence", name_dna("text")).drop("text")
    kept = sink.core_alignment(rows, p).withColumn("name", F.concat_ws("__", "cluster_id", "name"))
    back = annotation.fasta_records(spark.read.text(written(spark, sink.alignment_lines(kept, 20), "alignment"), wholetext=True))
    return back.select(F.substring_index("header", "__", 1).alias("cluster_id"), F.substring_index("header", "__", -1).alias("name"), "sequence")


@query(f"WITH {PLACED_SQL} SELECT genome_id, CAST(contig AS VARCHAR) AS contig, start, start + 9 AS stop, replace(gene_id, '=', '%3D') AS id, cluster_id AS cluster, annotation AS product, count(*) AS n FROM placed GROUP BY ALL")
def annotation_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "gff")
    sink.write_annotations(tpch.placed(spark, d).withColumn("end", F.col("start") + 9).withColumn("strand", F.lit("+")), path)
    files = spark.read.text(path, wholetext=True).withColumn("genome_id", F.col("genome_id").cast("string")).withColumn("file_idx", F.lit(0))
    at = F.col("attributes")
    rows = annotation.gff_records(files).select("genome_id", "contig", "start", F.col("end").alias("stop"), at["ID"].alias("id"), at["cluster"].alias("cluster"), at["product"].alias("product"))
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'n' || s_nationkey AS genome_id, string_agg('acgt' || translate(lower(s_name), '#0123456789', 'xacgtacgta'), '' ORDER BY s_suppkey) AS letters FROM supplier GROUP BY 1""".replace("AS letters", "AS raw") .join(("SELECT genome_id, regexp_replace(raw, '[^A-Za-z]', '', 'g') AS sequence FROM (", ")")))
def genbank_scan(spark: SparkSession, d: str) -> DataFrame:
    s = tpch.table(spark, d, "supplier")
    line = F.concat(F.lit("        1 acgt "), F.translate(F.lower("s_name"), "#0123456789", "xacgtacgta"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda x: x["line"]), "\n")
    files = s.groupBy(F.concat(F.lit("n"), "s_nationkey").alias("genome_id")).agg(body.alias("body"))
    return annotation.genbank_sequences(files.select("genome_id", F.concat(F.lit("LOCUS x\nFEATURES\nORIGIN      \n"), "body", F.lit("\n//\nLOCUS y\nORIGIN\n 1 tttt\n//\n")).alias("value")))


@query("SELECT page_id, CAST(n AS INTEGER) AS record_idx, trim(split_part(replace(part, chr(13), chr(10)), chr(10), 1)) AS header, regexp_replace(substr(part, length(split_part(replace(part, chr(13), chr(10)), chr(10), 1)) + 1), '\\s', '', 'g') AS sequence FROM (SELECT page_id, unnest(string_split(html, '>')[2:]) AS part, generate_subscripts(string_split(html, '>')[2:], 1) - 1 AS n FROM pages)")
def fasta_stream(spark: SparkSession, d: str) -> DataFrame:
    return annotation.fasta_stream(tpch.table(spark, d, "pages").select("page_id", F.col("html").alias("value")))


@query("SELECT page_id, lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('gff', 'gff3') AS gff, lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('gb', 'gbk', 'gbff', 'genbank') AS genbank, lower(regexp_extract(name, '\\.([^./]+)$', 1)) IN ('gff', 'gff3') AS named FROM (SELECT page_id, url, url || CASE page_id % 3 WHEN 0 THEN '.GFF3' WHEN 1 THEN '.gbk' ELSE '.txt' END AS name FROM pages)")
def file_types(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("page_id") % 3 == 0, ".GFF3").when(F.col("page_id") % 3 == 1, ".gbk").otherwise(".txt")
    return tpch.table(spark, d, "pages").select("page_id", annotation.is_gff(F.col("url")).alias("gff"), annotation.is_genbank(F.col("url")).alias("genbank"), annotation.is_gff(F.concat("url", end)).alias("named"))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS gene_id, p_type AS kind, CASE WHEN length(dna) > 0 AND p_partkey % 4 > 0 THEN dna ELSE '' END AS sequence, CASE WHEN p_partkey % 3 = 0 THEN upper(replace(p_name, ' ', '')) ELSE '' END AS protein FROM {DNA_SQL}")
def gene_calls(spark: SparkSession, d: str) -> DataFrame:
    rows = dna(spark, d)
    record = lambda body: F.concat(F.lit(">"), "p_partkey", F.lit(" call\n"), body).alias("value")
    n = annotation.fasta_records(spark.read.text(written(spark, rows.where("p_partkey % 4 > 0").select(record(F.col("dna"))), "n"), wholetext=True))
    p = annotation.fasta_records(spark.read.text(written(spark, rows.where("p_partkey % 3 = 0").select(record(F.upper("p_name"))), "p"), wholetext=True))
    return annotation.gene_calls(rows.select(F.col("p_partkey").cast("string").alias("gene_id"), F.col("p_type").alias("kind")), n, p)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS genome_id, 'region' AS trait, CAST(CASE WHEN n_regionkey IN (0, 1) THEN 1 ELSE 0 END AS DOUBLE) AS value FROM nation")
def phenotypes_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "traits")
    t = matrix_queries.traits(spark, d)
    sink.write_csv(t.select(F.col("genome_id").alias("genome"), F.col("value").alias("region")).coalesce(1), path, "\t")
    return tables.phenotypes(spark, path, t.select("genome_id"))


TABLES = "WITH " + PRESENCE_SQL + TRAITS + ", t AS (SELECT cluster_id, trait, CAST(sum(value) AS BIGINT) AS n11, CAST(count(*) - sum(value) AS BIGINT) AS n10 FROM presence JOIN traits USING (genome_id) GROUP BY 1, 2)"


@query(TABLES + " SELECT cluster_id AS gene, trait, n11 / 100 AS p_value, n10 / 20 AS fdr, CAST(n11 AS DOUBLE) AS odds_ratio, n11 AS n_present, n10 AS n_absent FROM t")
def association_table(spark: SparkSession, d: str) -> DataFrame:
    return _associations(spark, d)


def _associations(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "associations")
    t = statistics.contingency(tpch.presence(spark, d), matrix_queries.traits(spark, d))
    sink.write_csv(t.select("cluster_id", F.col("trait").alias("phenotype"), (F.col("n11") / 100).alias("pvalue"), (F.col("n10") / 20).alias("padj"), F.col("n11").alias("effect"), F.col("n11").alias("cases"), F.col("n10").alias("controls")), path)
    return tables.associations(spark, path)


@query(TABLES + " SELECT count(*) AS n, count(*) FILTER (n10 / 20 < 0.05) AS n_significant FROM t")
def significant_count(spark: SparkSession, d: str) -> DataFrame:
    return tables.significant_count(_associations(spark, d))


@query("SELECT 'v' || p_partkey AS variant, CAST(p_size AS DOUBLE) AS effect, p_size / 64 AS p_value, p_size / 32 AS fdr FROM part WHERE p_partkey % 5 > 0")
def effect_lines(spark: SparkSession, d: str) -> DataFrame:
    p = tpch.table(spark, d, "part")
    ok = F.concat_ws(" ", F.concat(F.lit("v"), "p_partkey"), F.col("p_size").cast("string"), (F.col("p_size") / 64).cast("string"), (F.col("p_size") / 32).cast("string"))
    other = F.when(F.col("p_partkey") % 10 == 0, "# a comment with words").otherwise("SNP effect p fdr")
    return tables.effect_lines(spark, written(spark, p.select(F.when(F.col("p_partkey") % 5 > 0, ok).otherwise(other).alias("value")), "effects"))


@query("SELECT 'a' || p_partkey AS gene1, 'b' || p_size AS gene2, p_size / 64 AS mi, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE p_size / 128 END AS p_value FROM part")
def correlation_lines(spark: SparkSession, d: str) -> DataFrame:
    p = tpch.table(spark, d, "part")
    row = F.concat_ws("\t", F.concat(F.lit("b"), "p_size"), F.concat(F.lit("a"), "p_partkey"), F.when(F.col("p_size") % 2 == 0, "nan").otherwise((F.col("p_size") / 128).cast("string")), (F.col("p_size") / 64).cast("string"))
    lines = p.select(F.lit(1).alias("k"), row.alias("value")).unionByName(spark.createDataFrame([(0, "id2 locus1 pval mutual_information")], "k int, value string"))
    return tables.correlations(spark, written(spark, lines.orderBy("k").coalesce(1).select("value"), "mi"))


@query("SELECT count(*) / 4 AS gain_rate, sum(s_nationkey) / 8 AS loss_rate, CAST(min(s_suppkey) AS DOUBLE) AS alpha, CAST(0 AS DOUBLE) AS convergence, CAST(max(s_suppkey) AS DOUBLE) AS r_squared FROM supplier")
def rate_table(spark: SparkSession, d: str) -> DataFrame:
    s = tpch.table(spark, d, "supplier").agg((F.count(F.lit(1)) / 4).alias("gain"), (F.sum("s_nationkey") / 8).alias("loss_rate"), F.min("s_suppkey").alias("alpha"), F.max("s_suppkey").alias("R2"))
    lines = F.array(F.lit(",Estimate"), F.lit('"quoted",3'), F.lit("other,9"), *[F.concat(F.lit(f"{c}, "), F.col(c).cast("string")) for c in s.columns])
    return tables.rates(spark, written(spark, s.select(F.explode(lines).alias("value")), "rates"))


@query("SELECT n_nationkey, CAST(n_regionkey / 4 AS DOUBLE) AS alpha, CAST(n_nationkey / 2 AS DOUBLE) AS kappa FROM nation")
def growth_parameters(spark: SparkSession, d: str) -> DataFrame:
    n = tpch.table(spark, d, "nation")
    text = F.concat(F.lit("# curve\nAlpha = "), (F.col("n_regionkey") / 4).cast("string"), F.lit("\nK: "), (F.col("n_nationkey") / 2).cast("string"), F.lit("\nother 9\n"))
    return tables.alpha_kappa(n.select("n_nationkey", text.alias("value"))).select("n_nationkey", "alpha", "kappa")


@query("SELECT block, n, size FROM (SELECT 0 AS block, o_orderkey AS n, o_totalprice AS size FROM orders UNION ALL SELECT 1, c_custkey, c_acctbal FROM customer)")
def growth_points(spark: SparkSession, d: str) -> DataFrame:
    def block(k: int, df: DataFrame, n: str, size: str) -> DataFrame:
        return df.select(F.lit(k).alias("k"), F.concat_ws(" ", F.col(n).cast("string"), F.col(size).cast("string")).alias("value"))

    gap = spark.createDataFrame([(0, "# n size"), (2, ""), (3, "# core")], "k int, value string")
    lines = gap.unionByName(block(1, tpch.table(spark, d, "orders"), "o_orderkey", "o_totalprice")).unionByName(block(4, tpch.table(spark, d, "customer"), "c_custkey", "c_acctbal"))
    return tables.growth_points(spark, written(spark, lines.orderBy("k", "value").select("value"), "growth"))


ANI = "ani AS (SELECT 'g' || s_nationkey AS g1, 'g' || (s_suppkey % 25) AS g2, max(80 + s_suppkey % 20) / 100 AS ani FROM supplier WHERE s_nationkey <> s_suppkey % 25 GROUP BY 1, 2)"


def ani_lines(spark: SparkSession, d: str) -> str:
    s = tpch.table(spark, d, "supplier").where("s_nationkey <> s_suppkey % 25").groupBy("s_nationkey", (F.col("s_suppkey") % 25).alias("other")).agg(F.max(80 + F.col("s_suppkey") % 20).alias("percent"))
    row = F.concat(F.lit("in/g"), "s_nationkey", F.lit(".fasta\tdir/g"), "other", F.lit(".fa\t"), "percent", F.lit("\t90\t90"))
    head = spark.createDataFrame([("Ref_file\tQuery_file\tANI\tAlign_ref\tAlign_query",), ("# comment",)], "value string")
    return written(spark, head.unionByName(s.select(row.alias("value"))), "ani")


@query(f"WITH {ANI} SELECT g1, g2, ani FROM ani")
def identity_lines(spark: SparkSession, d: str) -> DataFrame:
    return tables.ani_pairs(spark, ani_lines(spark, d))


@query(f"WITH {ANI}, both_ways AS (SELECT g1, g2, max(ani) AS ani FROM (SELECT * FROM ani UNION ALL SELECT g2, g1, ani FROM ani) GROUP BY 1, 2), g AS (SELECT 'g' || n_nationkey AS g FROM nation) SELECT a.g AS g1, b.g AS g2, CASE WHEN a.g = b.g THEN 1.0 ELSE coalesce(ani, 0.0) END AS ani FROM g a, g b LEFT JOIN both_ways m ON m.g1 = a.g AND m.g2 = b.g")
def identity_matrix(spark: SparkSession, d: str) -> DataFrame:
    genomes = tpch.table(spark, d, "nation").select(F.concat(F.lit("g"), "n_nationkey").alias("genome_id"))
    return tables.identity_matrix(tables.ani_pairs(spark, ani_lines(spark, d)), genomes)


@query("SELECT CAST(c_custkey AS VARCHAR) AS genome_id, CASE WHEN c_custkey % 4 = 0 THEN 100.0 ELSE (c_custkey % 100) / 2 END AS completeness, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE CAST(c_custkey % 30 AS DOUBLE) END AS contamination FROM customer")
def quality_reports(spark: SparkSession, d: str) -> DataFrame:
    c = tpch.table(spark, d, "customer")
    full = F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("Completeness (%): "), ((F.col("c_custkey") % 100) / 2).cast("string"), F.lit("\n"))).otherwise("")
    extra = F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("contamination\t"), F.col("c_custkey") % 30, F.lit("\n"))).otherwise("")
    return tables.quality_report(c.select(F.col("c_custkey").cast("string").alias("genome_id"), F.concat(F.lit("report\n"), full, extra).alias("value")))


@query("SELECT p_name AS gene_name, p_type AS drug_class, p_brand AS method, CAST(p_size AS DOUBLE) AS identity, CAST(0 AS DOUBLE) AS coverage, 'c' || p_partkey AS contig, p_partkey AS start, p_partkey + p_size AS stop FROM part")
def resistance_hits(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "amr")
    p = tpch.table(spark, d, "part")
    sink.write_csv(p.select(F.col("p_name").alias("Gene symbol"), F.col("p_type").alias("Class"), F.col("p_brand").alias("Method"), F.col("p_size").alias("% Identity to reference sequence"), F.concat(F.lit("c"), "p_partkey").alias("Contig id"), F.col("p_partkey").alias("Start"), (F.col("p_partkey") + F.col("p_size")).alias("Stop")), path, "\t")
    return tables.amr_hits(spark, path).withColumnRenamed("end", "stop")


@query("SELECT 'c' || l_suppkey AS cluster_id, 'g' || l_partkey AS gene_id, count(*) AS n FROM lineitem GROUP BY 1, 2")
def cluster_lines(spark: SparkSession, d: str) -> DataFrame:
    t = tpch.table(spark, d, "lineitem").select(F.concat(F.lit("c"), "l_suppkey", F.lit("\tg"), "l_partkey").alias("value"))
    return tables.cluster_members(spark, written(spark, t, "clusters")).groupBy("cluster_id", "gene_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SHARE} SELECT '{{\"num_genomes\":' || (SELECT max(n_total) FROM shares) || ',\"num_clusters\":' || count(*) || ',\"core\":' || count(*) FILTER (n_genomes >= ceil(0.99 * n_total)) || ',\"accessory\":' || count(*) FILTER (n_genomes < ceil(0.99 * n_total)) || '}}' AS value FROM shares")
def summary_json(spark: SparkSession, d: str) -> DataFrame:
    return sink.summary_json(tpch.presence(spark, d))


@query(f"WITH {NODES_SQL} SELECT '{{\"cluster_id\":\"' || cluster_id || '\",\"support\":' || support || ',\"n_genomes\":' || n_genomes || '}}' AS value, row_number() OVER (ORDER BY support DESC, cluster_id) AS place FROM nodes")
def cluster_json(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    lines = sink.cluster_json(graph_queries.built(spark, d)[0])
    return spark.read.text(written(spark, lines.coalesce(1), "json")).withColumn("k", F.monotonically_increasing_id()).select("value", F.row_number().over(Window.orderBy("k")).cast("long").alias("place"))


@query(f"WITH {SHARE}, b AS (SELECT CASE WHEN share >= 0.99 THEN 'Core genes (>= 99%)' WHEN share >= 0.95 THEN 'Soft core genes (95-99%)' WHEN share >= 0.15 THEN 'Shell genes (15-95%)' ELSE 'Cloud genes (0-15%)' END AS title FROM shares), titles AS (SELECT unnest(['Core genes (>= 99%)', 'Soft core genes (95-99%)', 'Shell genes (15-95%)', 'Cloud genes (0-15%)']) AS title) SELECT title, count(b.title) AS n FROM titles LEFT JOIN b USING (title) GROUP BY 1 UNION ALL SELECT 'Total genes', count(*) FROM shares UNION ALL SELECT 'Highly variable genes', 3")
def summary_text(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "summary")
    sink.write_one(spark, path, sink.summary_text(tpch.presence(spark, d), 3))
    f = F.split("value", ": ")
    return spark.read.text(path).select(f[0].alias("title"), f[1].cast("long").alias("n"))


VARIANTS = NODES_SQL + """, directed AS (SELECT a, b, list_sort(list(DISTINCT genome_id)) AS genomes FROM pairs GROUP BY 1, 2),
variants AS (SELECT 'inversion' AS kind, f.a || ';' || f.b AS clusters, list_sort(list_distinct(list_concat(f.genomes, r.genomes))) AS genomes, CAST(least(len(f.genomes), len(r.genomes)) AS BIGINT) AS support FROM directed f JOIN directed r ON f.a = r.b AND f.b = r.a WHERE f.a < f.b AND NOT list_has_any(f.genomes, r.genomes)
 UNION ALL SELECT 'duplication', cluster_id, (SELECT list_sort(list(DISTINCT genome_id)) FROM placed p WHERE p.cluster_id = nodes.cluster_id), support FROM nodes JOIN degrees USING (cluster_id) WHERE degree >= 3
 UNION ALL SELECT 'tandem_duplication', src, genomes, support FROM edges WHERE src = dst)"""


def variants(spark: SparkSession, d: str) -> DataFrame:
    from strandloom.operators import features

    nodes, edges = graph_queries.built(spark, d)
    return features.structural_variants(nodes, edges, graph.adjacent_pairs(tpch.placed(spark, d), ORDER))


@query(f"""WITH {VARIANTS}, rows AS (SELECT CASE kind WHEN 'inversion' THEN 'INVERSION' ELSE 'DUPLICATION' END AS type, '[' || clusters || ']' AS clusters, array_to_string(genomes, ';') AS carriers, support FROM variants)
SELECT 'SV_' || row_number() OVER (ORDER BY type, clusters, carriers, support) AS id, type, support, clusters, carriers FROM rows""")
def structural_variants(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "variants")
    sink.write_csv(sink.variant_rows(variants(spark, d)), path)
    return spark.read.csv(path, header=True).toDF("id", "type", "support", "clusters", "carriers").withColumn("support", F.col("support").cast("long"))


@query(f"WITH {VARIANTS}, named AS (SELECT *, CASE kind WHEN 'inversion' THEN 'INV' ELSE 'DUP' END AS prefix FROM variants), ids AS (SELECT prefix || '_' || row_number() OVER (PARTITION BY prefix ORDER BY clusters, kind) AS variant, genomes FROM named) SELECT variant, " + ", ".join(f"CAST(list_contains(genomes, '{g}') AS INTEGER) AS g{g}" for g in GENOMES) + " FROM ids")
def variant_matrix(spark: SparkSession, d: str) -> DataFrame:
    return sink.variant_matrix(stored(variants(spark, d), "variants"), GENOMES).withColumnsRenamed({g: f"g{g}" for g in GENOMES})


@query(matrix_queries.PAIRS.format(p=PRESENCE_SQL).replace("SELECT a.genome_id", ", dist AS (SELECT a.genome_id", 1) + ") SELECT g1 AS genome, g2 AS other, distance FROM dist UNION ALL SELECT g2, g1, distance FROM dist UNION ALL SELECT genome_id, genome_id, 0.0 FROM size")
def distance_table(spark: SparkSession, d: str) -> DataFrame:
    wide = sink.distance_table(matrix_queries.rounded(matrix.genome_pairs(tpch.presence(spark, d)), "distance"), GENOMES)
    return wide.select("genome", F.explode(F.array(*[F.struct(F.lit(g).alias("other"), F.col(g).alias("distance")) for g in GENOMES])).alias("x")).select("genome", "x.other", "x.distance")


@query(f"WITH {SHARE}, top AS (SELECT cluster_id, row_number() OVER (ORDER BY share * (1 - share) DESC, cluster_id) AS k FROM shares) SELECT g.genome_id, " + ", ".join(f"count(*) FILTER (k = {k}) AS c{k}" for k in range(1, 21)) + " FROM (SELECT DISTINCT genome_id FROM presence) g LEFT JOIN (SELECT genome_id, k FROM presence JOIN top USING (cluster_id) WHERE k <= 20) p USING (genome_id) GROUP BY 1")
def genome_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = stored(tpch.presence(spark, d), "presence")
    top = [r["cluster_id"] for r in matrix.most_variable(p, 20).collect()]
    path = fresh_path(spark, "profiles")
    sink.write_csv(matrix.genome_matrix(p, top), path, "\t")
    back = spark.read.csv(path, header=True, sep="\t")
    return back.toDF("genome_id", *[f"c{k + 1}" for k in range(len(top))]).withColumns({f"c{k + 1}": F.col(f"c{k + 1}").cast("long") for k in range(len(top))})


PROFILE = SHARE + ", profile AS (SELECT genome_id, count(*) FILTER (n_genomes = n_total) AS c, count(*) FILTER (n_genomes <> n_total) AS a FROM presence JOIN shares USING (cluster_id) GROUP BY 1)"


@query(f"WITH {PROFILE} SELECT genome_id || ',' || c || ',' || a AS bars, genome_id || ',' || CASE WHEN a / (a + c) < 1 / 3 THEN '#1f77b4' WHEN a / (a + c) < 2 / 3 THEN '#ff7f0e' ELSE '#d62728' END AS colours FROM profile")
def tree_annotations(spark: SparkSession, d: str) -> DataFrame:
    p = stored(tpch.presence(spark, d), "presence")
    bars, colours = (lines[lines.index("DATA") + 1 :] for lines in (sink.itol_strip(p), sink.itol_colours(p)))
    return spark.createDataFrame(list(zip(bars, colours)), "bars string, colours string")


@query(f"""WITH {PLACED_SQL}, genes AS (SELECT genome_id, contig, CASE WHEN contig % 3 = 0 THEN 'contig ' || contig ELSE string_agg(gene_id, '' ORDER BY start, tie1, tie2, tie3, tie4, gene_id) END AS sequence FROM placed GROUP BY genome_id, contig)
SELECT DISTINCT cluster_id, genome_id, contig, sequence FROM placed JOIN genes USING (genome_id, contig)""")
def contig_sequences(spark: SparkSession, d: str) -> DataFrame:
    p = stored(tpch.placed(spark, d).withColumn("sequence", F.col("gene_id")), "placed")
    contigs = p.where("contig % 3 = 0").select("genome_id", "contig", F.concat(F.lit("contig "), "contig").alias("sequence")).distinct()
    return graph.contig_sequences(p, contigs, ORDER)


@query("""SELECT doc_id, CAST(place AS INTEGER) AS place, md5(substr(text, CAST(place + 1 AS BIGINT), 5300)) AS piece FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 150)) AS place FROM documents)""")
def sequence_windows(spark: SparkSession, d: str) -> DataFrame:
    from strandloom.operators import correction

    docs = tpch.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("sequence"))
    return correction.windows(docs, F.lit(300)).select("doc_id", F.col("at").alias("place"), F.md5("window").alias("piece"))


@query("WITH kept AS (SELECT p_brand AS cluster_id, CAST(p_partkey AS VARCHAR) AS name, rpad(p_type, 28, '-') AS s FROM part), cols AS (SELECT cluster_id, i FROM kept, range(1, 29) t(i) GROUP BY 1, 2 HAVING count(*) FILTER (substr(s, i, 1) = '-') / count(*) <= 0.4) SELECT k.cluster_id, name, string_agg(substr(s, i, 1), '' ORDER BY i) AS sequence FROM kept k JOIN cols c ON c.cluster_id = k.cluster_id GROUP BY 1, 2".replace("range(1, 29) t(i)", "(SELECT unnest(range(1, 29)) AS i)"))
def trimmed_alignment(spark: SparkSession, d: str) -> DataFrame:
    from strandloom.operators.clustering import kept_columns

    p = tpch.table(spark, d, "part")
    return kept_columns(p.select(F.col("p_brand").alias("cluster_id"), F.col("p_partkey").cast("string").alias("name"), F.rpad("p_type", 28, "-").alias("sequence")), 0.4)


@query(f"WITH {EDGES_SQL} SELECT src, dst, support FROM edges")
def chunked_edges(spark: SparkSession, d: str) -> DataFrame:
    """Four chunks of genomes, written one by one and read together."""
    placed, folder = stored(tpch.placed(spark, d), "placed"), fresh_path(spark, "chunks")
    for k in range(4):
        arrivals.write_chunk(placed.where(F.pmod(F.col("genome_id").cast("int"), F.lit(4)) == k), ORDER, folder, k)
    return arrivals.read_chunks(spark, folder).select("src", "dst", "support")


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, least(event_type, 'u' || user_id % 7) AS src, greatest(event_type, 'u' || user_id % 7) AS dst, count(DISTINCT user_id % 25) AS support FROM events GROUP BY 1, 2, 3")
def late_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of gene pairs, counted by the hour."""
    schema = tpch.table(spark, d, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    pairs = rows.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("a"), F.concat(F.lit("u"), F.col("user_id") % 7).alias("b"), (F.col("user_id") % 25).cast("string").alias("genome_id"))
    folder = fresh_path(spark, "windows")
    arrivals.write_edge_counts(pairs, folder, fresh_path(spark, "checkpoint"), width="1 hour").awaitTermination()
    return arrivals.read_edge_counts(spark, folder).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "src", "dst", "support")


@query("SELECT event_id, replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html, value / 100 AS fraction, 1 / (1 + user_id % 9) AS path, abs(length(props) - length(event_type)) / greatest(length(props), length(event_type)) <= 0.4 + 1e-12 AS alike FROM events")
def scalar_texts(spark: SparkSession, d: str) -> DataFrame:
    from strandloom.functions.sequence import length_ratio_ok

    e = tpch.table(spark, d, "events")
    return e.select("event_id", txt.html_escape(F.col("props")).alias("html"), txt.ani_fraction(F.col("value")).alias("fraction"), txt.path_similarity(F.col("user_id") % 9).alias("path"), length_ratio_ok(F.col("props"), F.col("event_type"), 0.6).alias("alike"))


@query(f"WITH {SHARE} SELECT cluster_id FROM shares WHERE share >= 0.9")
def core_clusters(spark: SparkSession, d: str) -> DataFrame:
    return matrix.core_clusters(stored(tpch.presence(spark, d), "presence"), 0.9)


@query(f"WITH {PRESENCE_SQL}, qc AS (SELECT CAST(n_nationkey AS VARCHAR) AS genome_id, n_nationkey * 4 >= 70 AND n_nationkey % 12 <= 10 AS ok FROM nation) SELECT genome_id, ok AS passed, count(*) AS n_clusters FROM presence JOIN qc USING (genome_id) GROUP BY 1, 2")
def quality_of_genomes(spark: SparkSession, d: str) -> DataFrame:
    n = tpch.table(spark, d, "nation")
    qc = matrix.qc_passed(n.select(F.col("n_nationkey").cast("string").alias("genome_id"), (F.col("n_nationkey") * 4).cast("double").alias("completeness"), (F.col("n_nationkey") % 12).cast("double").alias("contamination")))
    return tpch.presence(spark, d).join(F.broadcast(qc), "genome_id").groupBy("genome_id", "passed").agg(F.count(F.lit(1)).alias("n_clusters"))
