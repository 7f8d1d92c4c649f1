"""Queries of the presence, curve and statistics operators, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import curves, matrix, statistics
from strandloom.plans import tpch
from strandloom.plans.tpch import PLACED_SQL, PRESENCE_SQL

GENOMES = [str(i) for i in range(25)]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(f"WITH {PRESENCE_SQL} SELECT cluster_id, genome_id FROM presence")
def presence_matrix(spark: SparkSession, d: str) -> DataFrame:
    return tpch.presence(spark, d)


SHARE = PRESENCE_SQL + ", total AS (SELECT count(DISTINCT genome_id) AS n_total FROM presence), counts AS (SELECT cluster_id, count(*) AS n_genomes FROM presence GROUP BY 1), shares AS (SELECT cluster_id, n_genomes, n_total, n_genomes / n_total AS share FROM counts, total)"
BAND = "CASE WHEN share >= 0.99 THEN 'core' WHEN share >= 0.95 THEN 'soft_core' WHEN share >= 0.15 THEN 'shell' ELSE 'cloud' END"


@query(f"WITH {SHARE} SELECT {BAND} AS band, count(*) AS n_clusters FROM shares GROUP BY 1")
def partition_summary(spark: SparkSession, d: str) -> DataFrame:
    return matrix.partition_summary(tpch.presence_once(spark, d))


@query(f"WITH {SHARE} SELECT cluster_id, n_genomes, {BAND} AS band FROM shares")
def cluster_bands(spark: SparkSession, d: str) -> DataFrame:
    return matrix.classified(tpch.presence_once(spark, d)).select("cluster_id", "n_genomes", "band")


@query(f"WITH {PRESENCE_SQL} SELECT cluster_id, count(*) AS n_genomes FROM presence GROUP BY 1")
def cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    return matrix.cluster_counts(tpch.presence(spark, d))


@query(f"WITH {PRESENCE_SQL} SELECT cluster_id, count(*) AS n_genomes FROM presence GROUP BY 1")
def packed_matrix_counts(spark: SparkSession, d: str) -> DataFrame:
    return matrix.packed_counts(matrix.packed_rows(tpch.presence(spark, d)))


@query(f"WITH {PRESENCE_SQL} SELECT genome_id, count(*) AS n_clusters FROM presence GROUP BY 1")
def genome_counts(spark: SparkSession, d: str) -> DataFrame:
    return matrix.genome_counts(tpch.presence(spark, d))


@query(f"WITH {PRESENCE_SQL} SELECT count(*) AS total_present FROM presence")
def total_present(spark: SparkSession, d: str) -> DataFrame:
    return matrix.total_present(tpch.presence(spark, d))


@query(f"WITH {SHARE} SELECT count(*) FILTER (n_genomes >= greatest(1, ceil(0.99 * n_total))) AS n_core, count(*) FILTER (n_genomes < greatest(1, ceil(0.99 * n_total))) AS n_accessory FROM shares")
def core_accessory(spark: SparkSession, d: str) -> DataFrame:
    return matrix.core_accessory(tpch.presence_once(spark, d))


@query(f"WITH {SHARE} SELECT n_genomes, count(*) AS n_families FROM shares GROUP BY 1")
def frequency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return matrix.frequency_histogram(tpch.presence(spark, d))


@query(f"WITH {SHARE} SELECT CASE WHEN n_genomes / 25 >= 0.99 THEN 'core' WHEN n_genomes / 25 >= 0.95 THEN 'soft_core' WHEN n_genomes / 25 >= 0.15 THEN 'shell' ELSE 'cloud' END AS band, count(*) AS n_families FROM shares GROUP BY 1")
def histogram_bands(spark: SparkSession, d: str) -> DataFrame:
    return matrix.histogram_bands(matrix.frequency_histogram(tpch.presence(spark, d)), 25)


@query(f"WITH {SHARE} SELECT genome_id, count(*) FILTER (n_genomes = n_total) AS n_core, count(*) FILTER (n_genomes <> n_total) AS n_accessory FROM presence JOIN shares USING (cluster_id) GROUP BY 1")
def genome_profile(spark: SparkSession, d: str) -> DataFrame:
    return matrix.genome_profile(tpch.presence_once(spark, d))


@query(f"WITH {SHARE} SELECT cluster_id, round(share * (1 - share), 6) AS variance FROM shares")
def presence_variance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.presence_variance(tpch.presence_once(spark, d)), "variance")


@query(f"WITH {SHARE} SELECT cluster_id, round(share * (1 - share), 6) AS variance FROM shares ORDER BY share * (1 - share) DESC, cluster_id LIMIT 50")
def most_variable(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.most_variable(tpch.presence_once(spark, d)), "variance")


@query(f"WITH {PRESENCE_SQL} SELECT cluster_id, " + ", ".join(f"CAST(count(*) FILTER (genome_id = '{g}') AS INTEGER) AS g{g}" for g in GENOMES) + " FROM presence GROUP BY 1")
def binary_matrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix.binary_matrix(tpch.presence(spark, d), GENOMES).withColumnsRenamed({g: f"g{g}" for g in GENOMES})


@query(f"WITH {PLACED_SQL} SELECT cluster_id, genome_id, string_agg(gene_id, ';' ORDER BY gene_id) AS cell FROM placed GROUP BY 1, 2")
def member_cells(spark: SparkSession, d: str) -> DataFrame:
    return matrix.member_cells(tpch.placed(spark, d))


PAIRS = """WITH {p}, size AS (SELECT genome_id, count(*) AS n FROM presence GROUP BY 1),
both_have AS (SELECT p.genome_id AS g1, q.genome_id AS g2, count(*) AS shared FROM presence p JOIN presence q USING (cluster_id) WHERE p.genome_id < q.genome_id GROUP BY 1, 2)
SELECT a.genome_id AS g1, b.genome_id AS g2, coalesce(shared, 0) AS shared, a.n + b.n - coalesce(shared, 0) AS either, round(1 - coalesce(shared, 0) / (a.n + b.n - coalesce(shared, 0)), 6) AS distance
FROM size a JOIN size b ON a.genome_id < b.genome_id LEFT JOIN both_have ON g1 = a.genome_id AND g2 = b.genome_id"""


@query(PAIRS.format(p=PRESENCE_SQL))
def genome_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.genome_pairs(tpch.presence_once(spark, d)), "distance")


FACTORIAL = ", lf AS (SELECT CAST(i AS BIGINT) AS i, lgamma(i + 1) AS lf FROM range(0, 26) t(i))"
GRID = ", ks AS (SELECT DISTINCT CAST(unnest([" + ", ".join(map(str, curves.grid(25))) + "]) AS BIGINT) AS k)"
CURVE = "WITH " + SHARE + FACTORIAL + GRID + """, curve AS (
SELECT k, sum(f * (1 - CASE WHEN 25 - n_genomes - k < 0 THEN 0 ELSE exp(lgamma(25 - n_genomes + 1) - lgamma(greatest(25 - n_genomes - k, 0) + 1) - lgamma(26) + lgamma(25 - k + 1)) END)) AS total,
       sum(f * CASE WHEN n_genomes < k THEN 0 ELSE exp(lgamma(n_genomes + 1) - lgamma(greatest(n_genomes - k, 0) + 1) - lgamma(26) + lgamma(25 - k + 1)) END) AS core
FROM (SELECT n_genomes, count(*) AS f FROM shares GROUP BY 1), ks GROUP BY 1)"""


@query(CURVE + " SELECT k, round(total, 4) AS total, round(core, 4) AS core, round(total - core, 4) AS accessory FROM curve")
def accumulation_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.expected_curve(matrix.frequency_histogram(tpch.presence(spark, d)), 25), "total", "core", "accessory", digits=4)


@query(CURVE + """ SELECT points, round(alpha, 6) AS alpha, round(exp(log_a), 3) AS a, round(r2, 6) AS r2, CASE WHEN points < 2 THEN 'unknown' WHEN alpha >= 1 THEN 'open' ELSE 'closed' END AS openness,
CASE WHEN alpha > 0 THEN 'Open' ELSE 'Closed' END AS growth_openness FROM (SELECT count(*) AS points, regr_slope(ln(total), ln(k)) AS alpha, regr_intercept(ln(total), ln(k)) AS log_a, regr_r2(ln(total), ln(k)) AS r2 FROM curve)""")
def power_law_fit(spark: SparkSession, d: str) -> DataFrame:
    fit = curves.power_law(curves.expected_curve(matrix.frequency_histogram(tpch.presence(spark, d)), 25))
    return rounded(rounded(fit, "alpha", "r2"), "a", digits=3)


@query(f"""WITH {PRESENCE_SQL}, ranks AS (SELECT genome_id, row_number() OVER (ORDER BY genome_id) AS rank FROM (SELECT DISTINCT genome_id FROM presence)),
firsts AS (SELECT cluster_id, min(rank) AS rank FROM presence JOIN ranks USING (genome_id) GROUP BY 1)
SELECT rank, coalesce(n, 0) AS new_clusters, CAST(sum(coalesce(n, 0)) OVER (ORDER BY rank) AS BIGINT) AS total FROM ranks LEFT JOIN (SELECT rank, count(*) AS n FROM firsts GROUP BY 1) USING (rank)""")
def rarefaction(spark: SparkSession, d: str) -> DataFrame:
    p = tpch.presence(spark, d)
    order = p.select("genome_id").distinct().withColumn("rank", F.expr("cast(row_number() over (order by genome_id) as bigint)"))
    return curves.rarefaction(p, order)


@query()
def sampled_accumulation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.sampled_curve(tpch.presence(spark, d), 25, samples=100), "mean_total", "mean_core", "stderr")


TRAITS = ", traits AS (SELECT CAST(n_nationkey AS VARCHAR) AS genome_id, 'region' AS trait, CASE WHEN n_regionkey IN (0, 1) THEN 1 ELSE 0 END AS value FROM nation)"


def traits(spark: SparkSession, d: str) -> DataFrame:
    return tpch.table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("genome_id"), F.lit("region").alias("trait"), F.col("n_regionkey").isin(0, 1).cast("int").alias("value"))


TABLES = "WITH " + PRESENCE_SQL + TRAITS + """, tables AS (SELECT cluster_id, trait, CAST(sum(value) AS BIGINT) AS n11, CAST(count(*) - sum(value) AS BIGINT) AS n10,
 CAST((SELECT sum(value) FROM traits) - sum(value) AS BIGINT) AS n01, CAST((SELECT count(*) - sum(value) FROM traits) - (count(*) - sum(value)) AS BIGINT) AS n00 FROM presence JOIN traits USING (genome_id) GROUP BY 1, 2)"""


@query(TABLES + " SELECT cluster_id, trait, n11, n10, n01, n00 FROM tables")
def trait_tables(spark: SparkSession, d: str) -> DataFrame:
    return statistics.contingency(tpch.presence(spark, d), traits(spark, d))


HYPER = """exp(lgamma(n11+n10+1)+lgamma(n01+n00+1)+lgamma(n11+n01+1)+lgamma(n10+n00+1)-lgamma(n11+n10+n01+n00+1)-lgamma({a}+1)-lgamma(n11+n10-{a}+1)-lgamma(n11+n01-{a}+1)-lgamma(n00-n11+{a}+1))"""
TESTED = TABLES + f""", shapes AS (SELECT DISTINCT n11, n10, n01, n00 FROM tables), cells AS (SELECT n11, n10, n01, n00, CAST(unnest(range(greatest(0, n11 - n00), least(n11 + n10, n11 + n01) + 1)) AS BIGINT) AS x FROM shapes),
probs AS (SELECT n11, n10, n01, n00, {HYPER.format(a='x')} AS px, {HYPER.format(a='n11')} AS p0 FROM cells),
ps AS (SELECT n11, n10, n01, n00, least(1.0, sum(CASE WHEN ln(px) <= ln(p0) + 1e-7 THEN px ELSE 0 END)) AS p_value FROM probs GROUP BY 1, 2, 3, 4),
tested AS (SELECT tables.*, CASE WHEN tables.n10 * tables.n01 > 0 THEN tables.n11 * tables.n00 / (tables.n10 * tables.n01) END AS odds_ratio, round(p_value, 9) AS p_value FROM tables JOIN ps USING (n11, n10, n01, n00)),
dist AS (SELECT p_value, count(*) AS n FROM tested GROUP BY 1), ranked AS (SELECT p_value, sum(n) OVER (ORDER BY p_value) AS rank, sum(n) OVER () AS m FROM dist),
fdrs AS (SELECT p_value, least(1.0, min(p_value * m / rank) OVER (ORDER BY p_value DESC)) AS fdr FROM ranked)"""


@query(TESTED + " SELECT cluster_id, trait, round(odds_ratio, 6) AS odds_ratio, round(p_value, 6) AS p_value, round(fdr, 6) AS fdr, CASE WHEN fdr < 0.05 THEN 'yes' ELSE 'no' END AS significant FROM tested JOIN fdrs USING (p_value)")
def trait_association(spark: SparkSession, d: str) -> DataFrame:
    tested = statistics.fisher(statistics.contingency(tpch.presence(spark, d), traits(spark, d)), 25).withColumn("p_value", F.round("p_value", 9))
    out = statistics.significant(statistics.false_discovery(tested, ["trait"]))
    return rounded(out.select("cluster_id", "trait", "odds_ratio", "p_value", "fdr", "significant"), "odds_ratio", "p_value", "fdr")


MI_LEAST = 0.25
MI_CELL = "CASE WHEN {c} > 0 THEN {c} / 12 * ln({c} * 12 / ({a} * {b})) ELSE 0 END"
MI_WHOLE = " + ".join(MI_CELL.replace("12", "25").format(c=c, a=a, b=b) for c, a, b in (("(n11)", "m1", "m2"), ("(m1 - n11)", "m1", "(25 - m2)"), ("(m2 - n11)", "(25 - m1)", "m2"), ("(25 - m1 - m2 + n11)", "(25 - m1)", "(25 - m2)")))


@query(f"""WITH {PRESENCE_SQL}, size AS (SELECT cluster_id, count(*) AS m FROM presence GROUP BY 1), both_have AS (SELECT p.cluster_id AS c1, q.cluster_id AS c2, count(*) AS n11 FROM presence p JOIN presence q USING (genome_id) WHERE p.cluster_id < q.cluster_id GROUP BY 1, 2),
mis AS (SELECT c1, c2, {MI_WHOLE} AS mi FROM (SELECT c1, c2, n11, a.m AS m1, b.m AS m2 FROM both_have JOIN size a ON a.cluster_id = c1 JOIN size b ON b.cluster_id = c2)) SELECT c1, c2, round(mi, 6) AS mi FROM mis WHERE mi >= {MI_LEAST}""")
def mutual_information(spark: SparkSession, d: str) -> DataFrame:
    return rounded(statistics.mutual_information(tpch.presence(spark, d), 25, MI_LEAST), "mi")


@query("""WITH l AS (SELECT lang, length(text) AS length FROM documents), n AS (SELECT lang, length, count(*) AS n FROM l GROUP BY 1, 2),
r AS (SELECT lang, length, n, sum(n * length) OVER (PARTITION BY lang ORDER BY length DESC) AS run, sum(n * length) OVER (PARTITION BY lang) AS total FROM n)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, CAST(max(total) AS BIGINT) AS total, round(max(total) / sum(n), 4) AS mean, max(CASE WHEN run >= floor(total / 2) THEN length END) AS n50, CAST(sum(n * greatest(length - 30, 0)) AS BIGINT) AS kmers FROM r GROUP BY 1""")
def assembly_statistics(spark: SparkSession, d: str) -> DataFrame:
    lengths = tpch.table(spark, d, "documents").select("lang", F.length("text").cast("long").alias("length"))
    return rounded(statistics.length_statistics(lengths, ["lang"]), "mean", digits=4)


@query("""WITH n AS (SELECT p_brand AS cluster_id, length(p_name) AS length, count(*) AS n FROM part GROUP BY 1, 2)
SELECT cluster_id, length AS mode_length FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, length) AS k FROM n) WHERE k = 1""")
def mode_length(spark: SparkSession, d: str) -> DataFrame:
    return matrix.mode_length(tpch.table(spark, d, "part").select(F.col("p_brand").alias("cluster_id"), F.length("p_name").cast("long").alias("length")))


@query("""WITH rows AS (SELECT p_partkey, p_name AS gene_id, p_type AS annotation, p_brand AS cluster_id, length(p_type) AS length FROM part WHERE NOT contains(p_name, ';') AND NOT contains(lower(p_name || ' ' || p_type), 'pseudo') AND NOT contains(lower(p_name || ' ' || p_type), 'fragment')),
n AS (SELECT cluster_id, length, count(*) AS n FROM rows GROUP BY 1, 2), m AS (SELECT cluster_id, length AS mode_length FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, length) AS k FROM n) WHERE k = 1)
SELECT p_partkey, gene_id, cluster_id, length FROM rows JOIN m USING (cluster_id) WHERE abs(length - mode_length) / mode_length <= 0.1""")
def filtered_presence(spark: SparkSession, d: str) -> DataFrame:
    rows = tpch.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("gene_id"), F.col("p_type").alias("annotation"), F.col("p_brand").alias("cluster_id"), F.length("p_type").cast("long").alias("length"), F.lit("").alias("protein"))
    return matrix.filter_presence(rows, [matrix.FRAGMENT, matrix.PSEUDOGENE, matrix.OUTLIER], 0.1).select("p_partkey", "gene_id", "cluster_id", "length")


QC = "WITH qc AS (SELECT c_custkey, 60 + c_acctbal / 250 AS completeness, (c_custkey % 23) / 2 AS contamination, 60 + c_acctbal / 250 >= 70 AND (c_custkey % 23) / 2 <= 10 AS passed FROM customer)"


def qc_table(spark: SparkSession, d: str) -> DataFrame:
    return tpch.table(spark, d, "customer").select("c_custkey", (60 + F.col("c_acctbal") / 250).alias("completeness"), ((F.col("c_custkey") % 23) / 2).alias("contamination"))


@query(QC + " SELECT c_custkey, passed FROM qc")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return matrix.qc_passed(qc_table(spark, d)).select("c_custkey", "passed")


@query(QC + " SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(avg(completeness), 4) AS mean_completeness, round(avg(contamination), 4) AS mean_contamination FROM qc")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(matrix.qc_summary(matrix.qc_passed(qc_table(spark, d))), "mean_completeness", "mean_contamination", digits=4)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type")
def class_counts(spark: SparkSession, d: str) -> DataFrame:
    return matrix.class_counts(tpch.table(spark, d, "events"), "event_type")


@query(PAIRS.format(p=PRESENCE_SQL).replace("SELECT a.genome_id", ", dist AS (SELECT a.genome_id", 1) + """), both_ways AS (SELECT g1 AS i, g2 AS j, distance AS d FROM dist UNION ALL SELECT g2, g1, distance FROM dist UNION ALL SELECT genome_id, genome_id, 0 FROM size),
v AS (SELECT i, j, -0.5 * d * d AS v FROM both_ways) SELECT i, j, round(v - avg(v) OVER (PARTITION BY i) - avg(v) OVER (PARTITION BY j) + avg(v) OVER (), 6) AS b FROM v""")
def double_centred(spark: SparkSession, d: str) -> DataFrame:
    p = rounded(matrix.genome_pairs(tpch.presence_once(spark, d)), "distance")
    both = p.select(F.col("g1").alias("i"), F.col("g2").alias("j"), F.col("distance").alias("d")).unionByName(p.select(F.col("g2").alias("i"), F.col("g1").alias("j"), F.col("distance").alias("d")))
    own = tpch.presence(spark, d).select("genome_id").distinct().select(F.col("genome_id").alias("i"), F.col("genome_id").alias("j"), F.lit(0.0).alias("d"))
    return rounded(statistics.double_centred(both.unionByName(own)), "b")


@query()
def scaled_plane(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(statistics.scaled_plane(matrix.genome_pairs(tpch.presence_once(spark, d)), GENOMES), "genome string, x double, y double")
