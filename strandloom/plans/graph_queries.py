"""Queries of the graph operators, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import correction, features, graph
from strandloom.plans import tpch
from strandloom.plans.tpch import EDGES_SQL, ENDS_SQL, NODES_SQL, ORDER, PAIRS_SQL, PLACED_SQL
from strandloom.session import stored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = graph.build(tpch.placed(spark, d), ORDER)
    return stored(nodes, "nodes"), stored(edges, "edges")


def joined(col: str):
    return F.array_join(col, ",")


@query(f"WITH {PAIRS_SQL} SELECT a, b, genome_id, count(*) AS n FROM pairs GROUP BY 1, 2, 3")
def adjacent_pairs(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacent_pairs(tpch.placed(spark, d), ORDER).groupBy("a", "b", "genome_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {EDGES_SQL} SELECT src, dst, array_to_string(genomes, ',') AS genomes, support FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_of(graph.adjacent_pairs(tpch.placed(spark, d), ORDER)).withColumn("genomes", joined("genomes"))


@query(f"WITH {PLACED_SQL} {ENDS_SQL} SELECT cluster_id, genome_id FROM ends")
def contig_ends(spark: SparkSession, d: str) -> DataFrame:
    return graph.contig_ends(tpch.placed(spark, d), ORDER)


@query(f"WITH {NODES_SQL} SELECT cluster_id, is_paralog FROM paralogs")
def paralog_clusters(spark: SparkSession, d: str) -> DataFrame:
    return graph.paralog_clusters(tpch.placed(spark, d))


@query(f"WITH {NODES_SQL} SELECT cluster_id, support, n_genomes, is_paralog, CAST(n_ends AS BIGINT) AS n_ends FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    p = tpch.placed(spark, d)
    return graph.nodes_of(p, graph.contig_ends(p, ORDER)).select("cluster_id", "support", "n_genomes", "is_paralog", F.size("contig_end_genomes").cast("long").alias("n_ends"))


@query(f"WITH {NODES_SQL} SELECT cluster_id, degree FROM degrees")
def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.edges_of(graph.adjacent_pairs(tpch.placed(spark, d), ORDER)))


@query(f"WITH {NODES_SQL}, kept AS (SELECT cluster_id FROM nodes WHERE n_genomes >= 22) SELECT src, dst, support FROM edges WHERE src IN (SELECT cluster_id FROM kept) AND dst IN (SELECT cluster_id FROM kept)")
def remove_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = built(spark, d)
    return graph.without_nodes(nodes, edges, nodes.where("n_genomes < 22"))[1].select("src", "dst", "support")


@query(f"WITH {NODES_SQL}, kept AS (SELECT cluster_id FROM nodes WHERE n_genomes >= 24) SELECT src, dst, support FROM edges WHERE src IN (SELECT cluster_id FROM kept) AND dst IN (SELECT cluster_id FROM kept)")
def induced_edges(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = built(spark, d)
    return graph.induced_edges(edges, nodes.where("n_genomes >= 24")).select("src", "dst", "support")


@query(f"""WITH {NODES_SQL}, ends2 AS (SELECT e.src, e.dst, e.support, a.support AS s1, b.support AS s2, a.n_ends > 0 AS e1, b.n_ends > 0 AS e2 FROM edges e JOIN nodes a ON a.cluster_id = e.src JOIN nodes b ON b.cluster_id = e.dst)
SELECT src, dst FROM ends2 WHERE support < 2 AND (e1 OR e2 OR support / least(s1, s2) < 0.05)""")
def misassembled_edges(spark: SparkSession, d: str) -> DataFrame:
    return correction.misassembled_edges(*built(spark, d), correction.misassembly_threshold("default", 25))


DIRECTED = PAIRS_SQL + ", directed AS (SELECT a, b, list_sort(list(DISTINCT genome_id)) AS genomes FROM pairs GROUP BY 1, 2)"


@query(f"""WITH {DIRECTED} SELECT f.a AS a, f.b AS b, CAST(least(len(f.genomes), len(r.genomes)) AS BIGINT) AS support FROM directed f JOIN directed r ON f.a = r.b AND f.b = r.a WHERE f.a < f.b AND NOT list_has_any(f.genomes, r.genomes)""")
def inversions(spark: SparkSession, d: str) -> DataFrame:
    pairs = graph.adjacent_pairs(tpch.placed(spark, d), ORDER)
    return features.inversions(features.directed_edges(pairs)).select(F.col("clusters")[0].alias("a"), F.col("clusters")[1].alias("b"), "support")


@query(f"""WITH {NODES_SQL} SELECT 'duplication' AS kind, cluster_id, support FROM nodes JOIN degrees USING (cluster_id) WHERE degree >= 3 UNION ALL SELECT 'tandem_duplication', src, support FROM edges WHERE src = dst""")
def duplications(spark: SparkSession, d: str) -> DataFrame:
    return features.duplications(*built(spark, d)).select("kind", F.col("clusters")[0].alias("cluster_id"), "support")


#: A sparse graph of all rows: a cluster is a part of a supplier. Its ends count in genomes of even numbers only.
FINE_SQL = NODES_SQL.replace("p_name || '|' || p_brand AS cluster_id", "CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS cluster_id").replace("count(*) AS n_ends FROM ends", "count(*) AS n_ends FROM ends WHERE CAST(genome_id AS INTEGER) % 2 = 0")


def fine(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    placed = tpch.placed(spark, d).withColumn("cluster_id", F.concat_ws("-", "tie1", "tie2"))
    nodes, edges = graph.build(placed, ORDER)
    even = F.filter("contig_end_genomes", lambda g: g.cast("int") % 2 == 0)
    return stored(nodes.withColumn("contig_end_genomes", even), "nodes"), stored(edges, "edges")


def rounds_sql(n: int, more: str) -> str:
    """Rounds of removing nodes of degree 1 and support below 2, one after another."""
    out = [FINE_SQL + ", n0 AS MATERIALIZED (SELECT * FROM nodes), e0 AS MATERIALIZED (SELECT src, dst FROM edges)"]
    for i in range(n):
        out.append(f"g{i} AS MATERIALIZED (SELECT cluster_id FROM n{i} JOIN (SELECT id, count(DISTINCT nbr) AS deg FROM (SELECT src AS id, dst AS nbr FROM e{i} UNION ALL SELECT dst, src FROM e{i}) GROUP BY 1) ON id = cluster_id WHERE support < 2 AND deg = 1{more})")
        out.append(f"n{i + 1} AS MATERIALIZED (SELECT * FROM n{i} WHERE cluster_id NOT IN (SELECT cluster_id FROM g{i}))")
        out.append(f"e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} WHERE src NOT IN (SELECT cluster_id FROM g{i}) AND dst NOT IN (SELECT cluster_id FROM g{i}))")
    return f"WITH {', '.join(out)} SELECT cluster_id, support FROM n{n}"


LABELS_SQL = EDGES_SQL + ", sides2 AS MATERIALIZED (SELECT src AS id, dst AS nbr FROM edges WHERE src <> dst UNION SELECT dst, src FROM edges WHERE src <> dst), l0 AS MATERIALIZED (SELECT DISTINCT id, id AS low FROM sides2)" + "".join(
    f", l{i + 1} AS MATERIALIZED (SELECT l.id, least(any_value(l.low), min(m.low)) AS low FROM l{i} l JOIN sides2 s ON s.id = l.id JOIN l{i} m ON m.id = s.nbr GROUP BY l.id)" for i in range(12))


@query(f"WITH {LABELS_SQL} SELECT id AS cluster_id, low AS component FROM l12")
def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(built(spark, d)[1])


@query(f"""WITH {NODES_SQL}, target AS (SELECT cluster_id, min(cluster_id) OVER (PARTITION BY split_part(cluster_id, '|', 1)) AS low FROM nodes),
best AS (SELECT split_part(cluster_id, '|', 1) AS name, cluster_id AS target FROM (SELECT *, row_number() OVER (PARTITION BY split_part(cluster_id, '|', 1) ORDER BY support DESC, cluster_id) AS k FROM nodes) WHERE k = 1)
SELECT target AS cluster_id, CAST(sum(support) AS BIGINT) AS support, bool_or(is_paralog) AS is_paralog FROM nodes JOIN best ON split_part(cluster_id, '|', 1) = name GROUP BY 1""")
def merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = built(spark, d)
    name = nodes.select("cluster_id", F.substring_index("cluster_id", "|", 1).alias("name"))
    first = name.groupBy("name").agg(F.min("cluster_id").alias("src"))
    pairs = name.join(first, "name").where("src <> cluster_id").select("src", F.col("cluster_id").alias("dst"))
    return graph.merge(nodes, edges, pairs)[0].select("cluster_id", "support", "is_paralog")


@query(rounds_sql(12, ""))
def remove_contamination(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = fine(spark, d)
    return correction.remove_contamination(nodes, edges, 2)[0].select("cluster_id", "support")


@query(rounds_sql(12, " AND n_ends > 0"))
def prune_contig_ends(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = fine(spark, d)
    return correction.prune_contig_ends(nodes, edges, 2)[0].select("cluster_id", "support")


#: Trees from each component's least id, cycles of the other edges, and sets of cycles that share two nodes or more, by rounds of passing on the least cycle.
CYCLES_SQL = LABELS_SQL + """, tree0 AS MATERIALIZED (SELECT id AS node, 0 AS depth FROM l12 WHERE id = low),
walk AS (SELECT node, depth FROM tree0 UNION SELECT nbr, depth + 1 FROM walk JOIN sides2 ON id = node WHERE depth < 12), depths AS MATERIALIZED (SELECT node, min(depth) AS depth FROM walk GROUP BY 1),
tree AS MATERIALIZED (SELECT d.node, d.depth, min(p.node) AS parent FROM depths d LEFT JOIN sides2 s ON s.id = d.node LEFT JOIN depths p ON p.node = s.nbr AND p.depth = d.depth - 1 GROUP BY 1, 2),
paths AS (SELECT node, [node] AS path FROM tree0 UNION ALL SELECT t.node, list_prepend(t.node, p.path) FROM paths p JOIN tree t ON t.parent = p.node),
chords AS MATERIALIZED (SELECT a.node || '~' || b.node AS cycle, list_concat(list_filter(x.path, lambda v: NOT list_contains(y.path, v)), list_filter(y.path, lambda v: NOT list_contains(x.path, v)), [list_filter(x.path, lambda v: list_contains(y.path, v))[1]]) AS path
  FROM edges e JOIN tree a ON a.node = e.src JOIN tree b ON b.node = e.dst JOIN paths x ON x.node = a.node JOIN paths y ON y.node = b.node WHERE e.src <> e.dst AND a.parent IS DISTINCT FROM b.node AND b.parent IS DISTINCT FROM a.node),
c0 AS MATERIALIZED (SELECT cycle, unnest(path) AS node FROM chords WHERE len(path) BETWEEN 3 AND 20),
both2 AS MATERIALIZED (SELECT a.cycle, a.node AS x, b.node AS y FROM c0 a JOIN c0 b ON a.cycle = b.cycle AND a.node < b.node), m0 AS MATERIALIZED (SELECT DISTINCT cycle, cycle AS low FROM c0)""" + "".join(
    f", m{i + 1} AS MATERIALIZED (SELECT cycle, min(low) AS low FROM (SELECT b.cycle, min(m.low) OVER (PARTITION BY b.x, b.y) AS low FROM both2 b JOIN m{i} m USING (cycle)) GROUP BY 1)" for i in range(12)) + """,
big AS (SELECT low FROM m12 GROUP BY 1 HAVING count(*) >= 2), members AS (SELECT DISTINCT low, node FROM c0 JOIN m12 USING (cycle) JOIN big USING (low)),
flagged AS (SELECT DISTINCT node FROM (SELECT node, support, floor(0.5 * max(support) OVER (PARTITION BY low)) AS least FROM members JOIN nodes ON cluster_id = node) WHERE support < least)"""


@query(f"WITH RECURSIVE {CYCLES_SQL.replace(EDGES_SQL, NODES_SQL, 1)} SELECT cluster_id, support, node IS NOT NULL AS is_highly_variable FROM nodes LEFT JOIN flagged ON node = cluster_id")
def highly_variable(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = built(spark, d)
    return features.highly_variable(nodes, edges, min_cycles=2).select("cluster_id", "support", "is_highly_variable")


@query(f"""WITH {EDGES_SQL}, fresh AS (SELECT src AS a, dst AS b, 'new' AS genome_id FROM edges WHERE support >= 3), every AS (SELECT src, dst, unnest(genomes) AS genome_id FROM edges UNION SELECT a, b, genome_id FROM fresh)
SELECT src, dst, count(DISTINCT genome_id) AS support FROM every GROUP BY 1, 2""")
def upsert_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = built(spark, d)[1]
    fresh = edges.where("support >= 3").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit("new").alias("genome_id"))
    return graph.upsert_edges(edges, fresh).select("src", "dst", "support")


#: The whole graph, both ways.
WHOLE = NODES_SQL + """, both_ways AS (SELECT src AS id, dst AS nbr FROM edges UNION SELECT dst, src FROM edges)"""


@query(f"""WITH RECURSIVE {WHOLE}, walk AS (SELECT min(src) AS node, 0 AS depth FROM edges UNION SELECT nbr, depth + 1 FROM walk JOIN both_ways ON id = node WHERE depth < 3)
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1""")
def breadth_first(spark: SparkSession, d: str) -> DataFrame:
    edges = built(spark, d)[1]
    return graph.bfs(edges, edges.agg(F.min("src").alias("start")), 3).select("node", "depth")


@query(f"""WITH {WHOLE}, pairs2 AS (SELECT DISTINCT a.id AS a, b.id AS b FROM both_ways a JOIN both_ways b USING (nbr) WHERE a.id < b.id AND split_part(a.id, '|', 2) = split_part(b.id, '|', 2))
SELECT a, b FROM pairs2""")
def shared_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from strandloom.operators.clustering import sharing_a_neighbour

    nodes, edges = built(spark, d)
    brand = nodes.select("cluster_id", F.substring_index("cluster_id", "|", -1).alias("brand"))
    pairs = brand.withColumnRenamed("cluster_id", "a").join(brand.withColumnRenamed("cluster_id", "b"), "brand").where("a < b").select("a", "b")
    return sharing_a_neighbour(pairs, edges)


@query(f"""WITH {FINE_SQL} SELECT cluster_id, support FROM nodes JOIN degrees USING (cluster_id) WHERE support < 2 AND degree = 1""")
def low_support_leaves(spark: SparkSession, d: str) -> DataFrame:
    """On the sparse graph of all rows: that of names has no leaf."""
    return graph.low_support_leaves(*fine(spark, d), 2).select("cluster_id", "support")


@query(f"""WITH RECURSIVE {WHOLE}, walk AS (SELECT min(src) AS node, 0 AS depth FROM edges UNION SELECT nbr, depth + 1 FROM walk JOIN both_ways ON id = node WHERE depth < 2), near AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)
SELECT cluster_id, support, CAST(depth AS INTEGER) AS depth FROM near JOIN nodes ON cluster_id = node""")
def gene_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = built(spark, d)
    return graph.neighbourhood(nodes, edges, edges.agg(F.min("src")).first()[0], 2)[0].select("cluster_id", "support", "depth")


@query(f"""WITH {EDGES_SQL} SELECT t.src, t.dst, p.genome_id FROM edges t JOIN presence p ON p.cluster_id = t.src WHERE NOT EXISTS (SELECT 1 FROM presence q WHERE q.cluster_id = t.dst AND q.genome_id = p.genome_id)""")
def missing_genomes(spark: SparkSession, d: str) -> DataFrame:
    p = tpch.placed(spark, d)
    return correction.missing_genomes(graph.edges_of(graph.adjacent_pairs(p, ORDER)), p.select("cluster_id", "genome_id").distinct())


@query(f"""WITH {NODES_SQL}, best AS (SELECT split_part(cluster_id, '|', 1) AS name, cluster_id AS target FROM (SELECT *, row_number() OVER (PARTITION BY split_part(cluster_id, '|', 1) ORDER BY support DESC, cluster_id) AS k FROM nodes) WHERE k = 1),
several AS (SELECT split_part(cluster_id, '|', 1) AS name FROM nodes GROUP BY 1 HAVING count(*) > 1), moved AS (SELECT cluster_id, target FROM nodes JOIN best ON split_part(cluster_id, '|', 1) = name WHERE name IN (SELECT name FROM several)),
wired AS (SELECT coalesce(s.target, src) AS a, coalesce(t.target, dst) AS b, s.target IS NOT NULL OR t.target IS NOT NULL AS moved, genomes FROM edges LEFT JOIN moved s ON s.cluster_id = src LEFT JOIN moved t ON t.cluster_id = dst)
SELECT least(a, b) AS src, greatest(a, b) AS dst, count(DISTINCT g) AS support FROM (SELECT a, b, unnest(genomes) AS g FROM wired WHERE a <> b OR NOT moved) GROUP BY 1, 2""")
def merged_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges that merge_nodes leaves, rewired."""
    nodes, edges = built(spark, d)
    name = nodes.select("cluster_id", F.substring_index("cluster_id", "|", 1).alias("name"))
    first = name.groupBy("name").agg(F.min("cluster_id").alias("src"))
    pairs = name.join(first, "name").where("src <> cluster_id").select("src", F.col("cluster_id").alias("dst"))
    return graph.merge(nodes, edges, pairs)[1].select("src", "dst", "support")


@query(f"""WITH {WHOLE}, near AS MATERIALIZED (SELECT DISTINCT id, nbr FROM both_ways WHERE id <> nbr), size AS (SELECT id, count(*) AS n FROM near GROUP BY 1),
brand AS (SELECT a.cluster_id AS a, b.cluster_id AS b FROM nodes a JOIN nodes b ON split_part(a.cluster_id, '|', 2) = split_part(b.cluster_id, '|', 2) AND a.cluster_id < b.cluster_id),
shared AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM near x JOIN near y USING (nbr) WHERE x.id < y.id AND split_part(x.id, '|', 2) = split_part(y.id, '|', 2) GROUP BY 1, 2)
SELECT a, b, round(CASE WHEN coalesce(p.n, 0) + coalesce(q.n, 0) - coalesce(k, 0) > 0 THEN coalesce(k, 0) / (coalesce(p.n, 0) + coalesce(q.n, 0) - coalesce(k, 0)) ELSE 0 END, 6) AS similarity FROM brand LEFT JOIN shared USING (a, b) LEFT JOIN size p ON p.id = a LEFT JOIN size q ON q.id = b""")
def context_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of one brand by their direct neighbours."""
    nodes, edges = built(spark, d)
    contexts = graph.bfs(edges, nodes.select(F.col("cluster_id").alias("start")), 1)
    brand = nodes.select("cluster_id", F.substring_index("cluster_id", "|", -1).alias("brand"))
    pairs = stored(brand.withColumnRenamed("cluster_id", "a").join(brand.withColumnRenamed("cluster_id", "b"), "brand").where("a < b").select("a", "b"), "pairs")
    return correction.context_similarity(contexts, pairs).withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {NODES_SQL} SELECT 'g0_' || cluster_id AS cluster_id, support, degree FROM nodes JOIN degrees USING (cluster_id) UNION ALL SELECT 'g1_' || cluster_id, support, degree FROM nodes JOIN degrees USING (cluster_id)""")
def united_graphs(spark: SparkSession, d: str) -> DataFrame:
    """Two relabelled copies of the graph side by side."""
    nodes, edges = built(spark, d)
    (n0, e0), (n1, e1) = graph.relabelled(nodes, edges, 0), graph.relabelled(nodes, edges, 1)
    return n0.unionByName(n1).join(graph.degrees(e0.unionByName(e1)), "cluster_id").select("cluster_id", "support", "degree")


@query(f"WITH {PLACED_SQL} SELECT DISTINCT cluster_id, genome_id, contig FROM placed")
def placements(spark: SparkSession, d: str) -> DataFrame:
    return graph.placements(tpch.placed(spark, d))
