"""Queries of the coloured k-mer graph: letters as bases; a nation's orders, or a source's documents, as a genome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import kmer_graph
from strandloom.plans import tpch
from strandloom.plans.functions_queries import BASES
from strandloom.plans.matrix_queries import rounded
from strandloom.plans.tpch import PLACED_SQL
from strandloom.session import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K, LONG = 11, 21


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def bases(text: Column) -> Column:
    return F.translate(F.regexp_replace(F.lower(text), "[^aeioulnr]+", ""), "aeioulnr", "ACGTACGT")


def contigs(spark: SparkSession, d: str) -> DataFrame:
    """(genome_id, sequence): the clusters of an order's lines as one sequence."""
    lines = F.sort_array(F.collect_list(F.struct(*tpch.ORDER, "cluster_id")))
    whole = tpch.placed(spark, d).groupBy("genome_id", "contig").agg(F.array_join(F.transform(lines, lambda x: x["cluster_id"]), "").alias("text"))
    return whole.select("genome_id", bases(F.col("text")).alias("sequence"))


GRAPH = """places AS (SELECT g, t, unnest(range(1, length(t) - {k} + 2)) AS i FROM s WHERE length(t) >= {k}),
colours AS (SELECT DISTINCT g, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM (SELECT g, substr(t, i, {k}) AS w FROM places)),
strands AS (SELECT kmer, unnest([kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))]) AS id FROM (SELECT DISTINCT kmer FROM colours)),
outs AS (SELECT substr(id, 2) AS shared, count(*) AS n_out, min(id) AS a, min(kmer) AS ka FROM strands GROUP BY 1), ins AS (SELECT substr(id, 1, {k} - 1) AS shared, count(*) AS n_in, min(id) AS b, min(kmer) AS kb FROM strands GROUP BY 1)"""
#: Walks from heads: a ring has none, and isn't in these rows.
UNITIGS = f"WITH RECURSIVE {PLACED_SQL}, joined AS (SELECT genome_id AS g, string_agg(cluster_id, '' ORDER BY start, tie1, tie2, tie3, tie4) AS x FROM placed GROUP BY genome_id, contig), s AS (SELECT g, {BASES.format(c='x')} AS t FROM joined), {GRAPH.format(k=LONG)}, " + """links AS (SELECT a, b FROM outs JOIN ins USING (shared) WHERE n_out = 1 AND n_in = 1 AND ka <> kb),
walk AS (SELECT id AS unitig, id, id AS sequence, 1 AS n FROM strands WHERE id NOT IN (SELECT b FROM links) UNION ALL SELECT unitig, b, sequence || right(b, 1), n + 1 FROM walk JOIN links ON a = id),
whole AS (SELECT unitig, max_by(sequence, n) AS sequence, max(n) AS n_kmers FROM walk GROUP BY 1),
ours AS (SELECT unitig, sequence, CAST(n_kmers AS BIGINT) AS n_kmers FROM whole WHERE unitig < reverse(translate(right(sequence, 21), 'ACGT', 'TGCA'))),
have AS (SELECT unitig, count(DISTINCT g) AS n_genomes FROM walk JOIN strands USING (id) JOIN colours USING (kmer) GROUP BY 1), found AS (SELECT * FROM ours JOIN have USING (unitig))"""


@query(UNITIGS + " SELECT unitig, sequence, n_kmers, n_genomes FROM found")
def kmer_unitigs(spark: SparkSession, d: str) -> DataFrame:
    return kmer_graph.unitigs(contigs(spark, d), LONG)


@query(UNITIGS + """, l AS (SELECT length(sequence) AS length, n_genomes FROM found), r AS (SELECT length, sum(length) OVER (ORDER BY length DESC ROWS UNBOUNDED PRECEDING) AS run, sum(length) OVER () AS total FROM l)
SELECT count(*) AS num_unitigs, CAST(sum(length) AS BIGINT) AS total_bases, round(avg(length), 6) AS avg_unitig_length, CAST(sum(greatest(length - 30, 1)) AS BIGINT) AS num_kmers,
 round(sum(n_genomes) / count(*), 6) AS color_complexity, (SELECT max(length) FILTER (run >= floor(total / 2)) FROM r) AS n50, (SELECT count(DISTINCT genome_id) FROM placed) AS num_colors FROM l""")
def kmer_graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(contigs(spark, d), "contigs")
    genomes = rows.agg(F.count_distinct("genome_id").alias("n")).first()["n"]
    return rounded(kmer_graph.graph_statistics(kmer_graph.unitigs(rows, LONG), genomes), "avg_unitig_length", "color_complexity")


@query(f"WITH s AS (SELECT source AS g, {BASES.format(c='text')} AS t FROM documents), {GRAPH.format(k=K)} SELECT n_out, n_in, count(*) AS overlaps FROM (SELECT shared, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM outs FULL JOIN ins USING (shared)) GROUP BY 1, 2")
def kmer_overlaps(spark: SparkSession, d: str) -> DataFrame:
    rows = tpch.table(spark, d, "documents").select(F.col("source").alias("genome_id"), bases(F.coalesce("text", F.lit(""))).alias("sequence"))
    found = kmer_graph.overlaps(kmer_graph.uncoloured(rows, K))
    return found.groupBy("n_out", "n_in").agg(F.count(F.lit(1)).alias("overlaps"))
