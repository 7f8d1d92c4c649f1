"""Queries of trees, changes along them and association with structure: nations are genomes, regions their ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import association, matrix, statistics, trees
from strandloom.plans import matrix_queries, tpch
from strandloom.plans.matrix_queries import GENOMES, TABLES, rounded
from strandloom.plans.tpch import PRESENCE_SQL
from strandloom.session import fresh_path
from strandloom.sinks import files as sink
from strandloom.sources import trees as source

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH lines AS (SELECT l_orderkey AS tree, l_returnflag AS flag, CAST(l_partkey AS VARCHAR) AS name, CAST(l_quantity AS DOUBLE) AS length FROM lineitem)
SELECT tree, name, flag AS parent, length, 2 AS depth FROM lines UNION ALL SELECT tree, flag, 'order ' || tree, sum(length), 1 FROM lines GROUP BY 1, 2
UNION ALL SELECT DISTINCT tree, 'order ' || tree, NULL, CAST(NULL AS DOUBLE), 0 FROM lines""")
def newick_nodes(spark: SparkSession, d: str) -> DataFrame:
    lines = tpch.table(spark, d, "lineitem").repartition("l_orderkey").select("l_orderkey", "l_returnflag", F.col("l_quantity").cast("double").alias("length"), F.concat(F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_quantity").cast("double").cast("string")).alias("leaf"))
    flags = lines.groupBy("l_orderkey", "l_returnflag").agg(F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list("leaf")), ","), F.lit(")"), F.first("l_returnflag"), F.lit(":"), F.sum("length").cast("string")).alias("inner"))
    text = F.concat(F.lit("["), F.col("tree").cast("string"), F.lit("]("), F.array_join(F.sort_array("parts"), ",\n"), F.lit(")'order "), F.col("tree").cast("string"), F.lit("';"))
    texts = flags.groupBy(F.col("l_orderkey").alias("tree")).agg(F.collect_list("inner").alias("parts")).select("tree", text.alias("value"))
    return source.tree_nodes(texts).select("tree", "name", F.col("above").alias("parent"), "length", "depth")


LENGTHS = """, size AS (SELECT n_nationkey, n_regionkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
CHANGES = "WITH " + PRESENCE_SQL + LENGTHS + """, leaf AS (SELECT c.cluster_id, n_nationkey AS k, n_regionkey AS r, p.cluster_id IS NOT NULL AS s FROM (SELECT DISTINCT cluster_id FROM presence) c CROSS JOIN nation LEFT JOIN presence p ON p.cluster_id = c.cluster_id AND p.genome_id = CAST(n_nationkey AS VARCHAR)),
region_can AS (SELECT cluster_id, r, count(*) FILTER (s) >= count(*) FILTER (NOT s) AS one, count(*) FILTER (NOT s) >= count(*) FILTER (s) AS zero FROM leaf GROUP BY 1, 2),
root AS (SELECT cluster_id, count(*) FILTER (one) > count(*) FILTER (zero) AS s FROM region_can GROUP BY 1),
inner_state AS (SELECT cluster_id, r, root.s AS above, CASE WHEN root.s THEN one ELSE NOT zero END AS s FROM region_can JOIN root USING (cluster_id)),
changed AS (SELECT 'r' || r AS name, above, s FROM inner_state UNION ALL SELECT CAST(k AS VARCHAR), i.s, l.s FROM leaf l JOIN inner_state i USING (cluster_id, r)),
branches AS (SELECT name, length, CAST(count(*) FILTER (s AND NOT above) AS BIGINT) AS gains, CAST(count(*) FILTER (above AND NOT s) AS BIGINT) AS losses FROM changed JOIN
 (SELECT CAST(n_nationkey AS VARCHAR) AS name, n * 0.25::DOUBLE AS length FROM size UNION ALL SELECT 'r' || n_regionkey, sum(n) * 0.125::DOUBLE FROM size GROUP BY n_regionkey) USING (name) GROUP BY 1, 2)"""


def region_tree(spark: SparkSession, d: str) -> DataFrame:
    """The nodes of a written and read tree: nations under regions, branches as long as they have customers."""
    size = tpch.table(spark, d, "nation").join(tpch.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n")), "n_nationkey", "left").fillna(0, "n")
    leaf = F.concat(F.col("n_nationkey").cast("string"), F.lit(":"), (F.col("n") * 0.25).cast("string"))
    regions = size.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(leaf)), ",").alias("leaves"), (F.sum("n") * 0.125).cast("string").alias("length"))
    text = regions.agg(F.concat(F.lit("("), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("("), "leaves", F.lit(")r"), F.col("n_regionkey").cast("string"), F.lit(":"), "length"))), ","), F.lit(");")).alias("value"))
    path = fresh_path(spark, "tree")
    sink.write_lines(text.coalesce(1), path)
    return source.tree_file(spark, path)


@query(CHANGES + " SELECT name, length, gains, losses FROM branches")
def branch_changes(spark: SparkSession, d: str) -> DataFrame:
    return trees.branch_changes(tpch.presence(spark, d), region_tree(spark, d)).select("name", "length", "gains", "losses")


@query(CHANGES + """, fit AS (SELECT regr_slope(gains, length) AS gain_rate, regr_slope(losses, length) AS loss_rate, regr_intercept(gains + losses, length) AS alpha, CAST(1 AS DOUBLE) AS convergence, regr_r2(gains + losses, length) AS r_squared FROM branches)
SELECT parameter, round(value, 4) AS value FROM (UNPIVOT fit ON gain_rate, loss_rate, alpha, convergence, r_squared INTO NAME parameter VALUE value)""")
def change_rates(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trees.change_rates(trees.branch_changes(tpch.presence(spark, d), region_tree(spark, d))), "value", digits=4)


SHARE = "(CASE WHEN {k} > 0 THEN {k} * ln({k} / {n}) ELSE 0 END + CASE WHEN {n} > {k} THEN ({n} - {k}) * ln(({n} - {k}) / {n}) ELSE 0 END)"
RATIO = f"2 * ({SHARE.format(k='n11', n='(n11 + n10)')} + {SHARE.format(k='n01', n='(n01 + n00)')} - {SHARE.format(k='(n11 + n01)', n='(n11 + n10 + n01 + n00)')})"


@query(TABLES + f""" SELECT cluster_id, trait, n11 + n10 AS present, CASE WHEN n01 + n00 = 0 THEN 0 WHEN n11 * n10 * n01 * n00 > 0 THEN round(ln(n11 * n00 / (n10 * n01)), 4) + 0.0 END AS effect,
CASE WHEN n01 + n00 = 0 THEN 0 ELSE round(greatest(0.0, {RATIO}), 5) END AS lrt FROM tables""")
def pattern_association(spark: SparkSession, d: str) -> DataFrame:
    out = association.structured_association(tpch.presence(spark, d), matrix_queries.traits(spark, d))
    return out.select("cluster_id", "trait", "present", (F.round("effect", 4) + 0.0).alias("effect"), F.round("lrt", 5).alias("lrt"))


@query("WITH " + PRESENCE_SQL + """, balance AS (SELECT CAST(c_nationkey AS VARCHAR) AS genome_id, CAST(avg(c_acctbal) AS DOUBLE) AS y FROM customer GROUP BY 1),
cells AS (SELECT c.cluster_id, b.y, CASE WHEN p.cluster_id IS NULL THEN 0 ELSE 1 END AS x FROM (SELECT DISTINCT cluster_id FROM presence) c CROSS JOIN balance b LEFT JOIN presence p ON p.cluster_id = c.cluster_id AND p.genome_id = b.genome_id),
fits AS (SELECT cluster_id, count(*) AS n, CAST(sum(x) AS BIGINT) AS present, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2 FROM cells GROUP BY 1)
SELECT cluster_id, n, present, CASE WHEN present = n THEN 0 ELSE round(slope, 4) + 0.0 END AS effect, CASE WHEN present = n THEN 0 ELSE round(-n * ln(1 - r2), 5) + 0.0 END AS lrt FROM fits""")
def continuous_association(spark: SparkSession, d: str) -> DataFrame:
    balance = tpch.table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("genome_id")).agg(F.avg(F.col("c_acctbal").cast("double")).alias("value")).withColumn("trait", F.lit("balance"))
    out = association.structured_association(tpch.presence(spark, d), balance, continuous=True)
    return out.select("cluster_id", "n", "present", (F.round("effect", 4) + 0.0).alias("effect"), (F.round("lrt", 5) + 0.0).alias("lrt"))


@query()
def structured_association(spark: SparkSession, d: str) -> DataFrame:
    presence = tpch.presence_once(spark, d)
    plane = statistics.scaled_plane(matrix.genome_pairs(presence), GENOMES)
    out = association.structured_association(presence, matrix_queries.traits(spark, d), {g: (x, y) for g, x, y in plane})
    out = statistics.significant(statistics.false_discovery(out.withColumn("p_value", F.round("p_value", 9)), ["trait"]))
    return rounded(out, "effect", "lrt", "p_value", "fdr", digits=4)
