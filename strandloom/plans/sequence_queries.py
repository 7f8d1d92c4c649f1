"""Queries of the similarity operators, with oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import clustering
from strandloom.plans import tpch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def names(spark: SparkSession, d: str) -> DataFrame:
    return tpch.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), "p_name", "p_type").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("sequence")).agg(F.min("ord").alias("ord")).select("ord", "sequence")


NAMES_SQL = "names AS (SELECT p_name || ' ' || p_type AS sequence, min(p_partkey) AS ord, length(p_name || ' ' || p_type) AS n FROM part GROUP BY 1)"
SAME = "len(list_filter(range(1, least(a.n, b.n) + 1), lambda i: substr(a.sequence, i, 1) = substr(b.sequence, i, 1)))"


@query(f"WITH {NAMES_SQL} SELECT a.ord AS a, b.ord AS b, round({SAME} / least(a.n, b.n), 6) AS identity FROM names a JOIN names b ON a.ord < b.ord AND abs(a.n - b.n) / greatest(a.n, b.n) <= 1 - 0.8 + 1e-12 WHERE {SAME} / least(a.n, b.n) >= 0.8")
def similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return clustering.similar_pairs(names(spark, d), 0.8).withColumn("identity", F.round("identity", 6))


@query()
def greedy_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.greedy_clusters(names(spark, d), 0.8)


@query("""WITH k AS (SELECT DISTINCT p_name AS cluster_id, floor(length(p_name) / 100) AS size, rpad(substr(p_name, 1, 4), 4, '0') AS head FROM part)
SELECT a.cluster_id AS a, b.cluster_id AS b FROM k a JOIN k b USING (size, head) WHERE a.cluster_id < b.cluster_id""")
def bucket_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = tpch.table(spark, d, "part").select(F.col("p_name").alias("cluster_id"), F.col("p_name").alias("sequence")).distinct()
    return clustering.bucket_pairs(rows)


FOLD = "len(list_filter(range(1, least(length(q.sequence), length(c.sequence)) + 1), lambda i: upper(substr(q.sequence, i, 1)) = upper(substr(c.sequence, i, 1)))) / greatest(length(q.sequence), length(c.sequence))"


@query(f"""WITH q AS (SELECT DISTINCT p_name AS sequence FROM part WHERE p_size > 25), c AS (SELECT DISTINCT p_name AS sequence FROM part WHERE p_size <= 25),
s AS (SELECT q.sequence AS query_id, c.sequence AS cluster_id, {FOLD} AS identity FROM q, c)
SELECT query_id, cluster_id, round(identity, 6) AS identity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY identity DESC, cluster_id) AS k FROM s WHERE identity >= 0.6) WHERE k = 1""")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    part = tpch.table(spark, d, "part")
    q = part.where("p_size > 25").select(F.col("p_name").alias("query_id"), F.col("p_name").alias("sequence")).distinct()
    c = part.where("p_size <= 25").select(F.col("p_name").alias("cluster_id"), F.col("p_name").alias("sequence")).distinct()
    return clustering.best_match(q, c, 0.6).withColumn("identity", F.round("identity", 6))


@query("""WITH first AS (SELECT p_brand AS cluster_id, CAST(p_size AS VARCHAR) AS genome_id, p_type AS sequence, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey, p_type) AS k FROM part),
once AS (SELECT cluster_id, sequence, min(genome_id) AS name FROM first WHERE k = 1 GROUP BY 1, 2) SELECT cluster_id, name, sequence FROM once WHERE cluster_id IN (SELECT cluster_id FROM once GROUP BY 1 HAVING count(*) >= 2)""")
def alignment_rows(spark: SparkSession, d: str) -> DataFrame:
    part = tpch.table(spark, d, "part")
    members = part.select(F.col("p_brand").alias("cluster_id"), F.col("p_size").cast("string").alias("genome_id"), F.col("p_partkey").alias("line_idx"), F.col("p_type").alias("sequence"))
    centroids = part.groupBy(F.col("p_brand").alias("cluster_id")).agg(F.min("p_type").alias("sequence"))
    return clustering.alignment_rows(members, centroids)
