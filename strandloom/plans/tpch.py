"""The star-schema tables as a set of genomes.

A genome is a customer's nation, a contig an order, a gene an order line, a cluster a part's
name and brand. Line numbers repeat within an order, so the reading order has tie-breaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import stored

ORDER = ["start", "tie1", "tie2", "tie3", "tie4"]

#: The same views in SQL, for the oracles.
PLACED_SQL = """placed AS (
  SELECT CAST(c_nationkey AS VARCHAR) AS genome_id, l_orderkey AS contig, CAST(l_linenumber AS BIGINT) AS start,
         l_partkey AS tie1, l_suppkey AS tie2, l_quantity AS tie3, l_extendedprice AS tie4,
         p_name || '|' || p_brand AS cluster_id, CAST(l_partkey AS VARCHAR) AS gene_id, p_type AS annotation
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""
PRESENCE_SQL = PLACED_SQL + ", presence AS (SELECT DISTINCT cluster_id, genome_id FROM placed)"
PAIRS_SQL = PRESENCE_SQL + """, pairs AS (
  SELECT * FROM (SELECT genome_id, cluster_id AS a, lead(cluster_id) OVER (PARTITION BY genome_id, contig ORDER BY start, tie1, tie2, tie3, tie4) AS b FROM placed) WHERE b IS NOT NULL)"""
EDGES_SQL = PAIRS_SQL + """, edges AS (
  SELECT least(a, b) AS src, greatest(a, b) AS dst, list_sort(list(DISTINCT genome_id)) AS genomes, count(DISTINCT genome_id) AS support FROM pairs GROUP BY 1, 2)"""
ENDS_SQL = """, ends AS (
  SELECT DISTINCT cluster_id, genome_id FROM (
    SELECT cluster_id, genome_id, row_number() OVER (PARTITION BY genome_id, contig ORDER BY start, tie1, tie2, tie3, tie4) AS n,
           count(*) OVER (PARTITION BY genome_id, contig) AS last FROM placed) WHERE n = 1 OR n = last)"""
NODES_SQL = EDGES_SQL + ENDS_SQL + """, paralogs AS (
  SELECT cluster_id, max(n) > 1 AS is_paralog FROM (SELECT cluster_id, genome_id, count(*) AS n FROM placed GROUP BY 1, 2) GROUP BY 1),
nodes AS (
  SELECT cluster_id, count(*) AS support, count(DISTINCT genome_id) AS n_genomes, any_value(is_paralog) AS is_paralog,
         coalesce(any_value(n_ends), 0) AS n_ends
  FROM placed JOIN paralogs USING (cluster_id) LEFT JOIN (SELECT cluster_id, count(*) AS n_ends FROM ends GROUP BY 1) USING (cluster_id) GROUP BY 1),
sides AS (SELECT src AS id, dst AS nbr FROM edges UNION SELECT dst, src FROM edges),
degrees AS (SELECT id AS cluster_id, count(DISTINCT nbr) AS degree FROM sides GROUP BY 1)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with their clusters: genome_id, contig, start and its ties, cluster_id, gene_id, annotation."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    part = t("part").select("p_partkey", F.concat_ws("|", "p_name", "p_brand").alias("cluster_id"), F.col("p_type").alias("annotation"))
    rows = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("c_nationkey").cast("string").alias("genome_id"), F.col("l_orderkey").alias("contig"), F.col("l_linenumber").cast("long").alias("start"),
        F.col("l_partkey").alias("tie1"), F.col("l_suppkey").alias("tie2"), F.col("l_quantity").alias("tie3"), F.col("l_extendedprice").alias("tie4"),
        "cluster_id", F.col("l_partkey").cast("string").alias("gene_id"), "annotation",
    )


def presence_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As presence(), stored: for operators that read it several times."""
    return stored(presence(spark, sf_dir), "presence")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(spark, sf_dir).select("cluster_id", "genome_id").distinct()
