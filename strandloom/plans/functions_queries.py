"""Queries of the scalar functions and the text readers, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import sequence as seq
from strandloom.functions import text as txt
from strandloom.operators import correction, sketches
from strandloom.plans import tpch
from strandloom.sources import annotation

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Nucleotides out of part names: vowels and the like become bases, the rest goes.
DNA_SQL = "(SELECT p_partkey, translate(regexp_replace(lower(p_name || p_type || p_brand), '[^aeioulnr]', '', 'g'), 'aeioulnr', 'ACGTACGT') AS dna, p_name, p_type FROM part)"


def dna(spark: SparkSession, d: str) -> DataFrame:
    text = F.regexp_replace(F.lower(F.concat("p_name", "p_type", "p_brand")), "[^aeioulnr]", "")
    return tpch.table(spark, d, "part").select("p_partkey", F.translate(text, "aeioulnr", "ACGTACGT").alias("dna"), "p_name", "p_type")


@query(f"SELECT p_partkey, translate(reverse(dna), 'ACGTacgt', 'TGCATGCA') AS rc FROM {DNA_SQL}")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("p_partkey", seq.reverse_complement(F.col("dna")).alias("rc"))


CODONS = "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in seq.codon_table().items()) + "}"
AMINO = f"array_to_string(list_transform(range(0, CAST(floor(length(dna) / 3) AS BIGINT)), lambda i: CASE WHEN i = 0 AND substr(dna, 1, 3) IN ('ATG', 'GTG', 'TTG') THEN 'M' ELSE coalesce(({CODONS})[substr(dna, i * 3 + 1, 3)], 'X') END), '')"


@query(f"SELECT p_partkey, {AMINO} AS with_stop, split_part({AMINO}, '*', 1) AS protein FROM {DNA_SQL}")
def translated(spark: SparkSession, d: str) -> DataFrame:
    return dna(spark, d).select("p_partkey", seq.translate_with_stop(F.col("dna")).alias("with_stop"), seq.translate(F.col("dna")).alias("protein"))


PLACES = "(SELECT p_partkey, dna, p_size % 7 AS start, p_size % 29 AS stop, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand FROM part JOIN " + DNA_SQL + " USING (p_partkey))"


@query(f"""SELECT p_partkey, CASE WHEN start > 0 AND start <= stop AND stop <= length(dna) THEN CASE WHEN strand = '-' THEN translate(reverse(substr(dna, start, stop - start + 1)), 'ACGTacgt', 'TGCATGCA') ELSE substr(dna, start, stop - start + 1) END ELSE '' END AS gene,
CAST(CASE WHEN start > 0 AND stop > 0 AND stop >= start THEN stop - start + 1 ELSE 0 END AS BIGINT) AS length FROM {PLACES}""")
def sliced_sequences(spark: SparkSession, d: str) -> DataFrame:
    rows = dna(spark, d).join(tpch.table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    start, stop, strand = F.col("p_size") % 7, F.col("p_size") % 29, F.when(F.col("p_partkey") % 3 == 0, "-").otherwise("+")
    return rows.select("p_partkey", seq.slice_sequence(F.col("dna"), start, stop, strand).alias("gene"), seq.gene_length(start, stop).alias("length"))


SAME = "len(list_filter(range(1, least(length(p_name), length(p_type)) + 1), lambda i: {a} = {b}))"
EXACT, FOLDED = SAME.format(a="substr(p_name, i, 1)", b="substr(p_type, i, 1)"), SAME.format(a="upper(substr(p_name, i, 1))", b="upper(substr(p_type, i, 1))")


@query(f"""SELECT p_partkey, round({EXACT} / least(length(p_name), length(p_type)), 6) AS by_min, round({FOLDED} / greatest(length(p_name), length(p_type)), 6) AS by_max,
round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS edit, round(least(length(p_name), length(p_type)) / greatest(length(p_name), length(p_type)), 6) AS coverage FROM part""")
def sequence_identities(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_name"), F.col("p_type")
    scores = {"by_min": seq.identity_by_min(a, b), "by_max": seq.identity_by_max(a, b), "edit": seq.global_identity(a, b), "coverage": seq.coverage(a, b)}
    return tpch.table(spark, d, "part").select("p_partkey", *[F.round(c, 6).alias(n) for n, c in scores.items()])


BASES = "translate(regexp_replace(lower({c}), '[^aeioulnr]', '', 'g'), 'aeioulnr', 'ACGTACGT')"


@query(f"""WITH s AS (SELECT p_partkey, {BASES.format(c='p_type')} AS q, {BASES.format(c='p_name || p_brand || p_name')} AS t FROM part),
cut AS (SELECT DISTINCT q, t, unnest(range(1, length(t) + 1)) AS i FROM s), pieces AS (SELECT q, t, substr(t, i, n) AS piece FROM (SELECT q, t, i, unnest(range(0, 2 * length(q) + 1)) AS n FROM cut)),
best AS (SELECT q, t, min(levenshtein(q, piece)) AS d FROM pieces GROUP BY 1, 2)
SELECT p_partkey, least(coalesce(d, length(q)), length(q)) AS distance, round(CASE WHEN length(q) > 0 THEN 1 - least(coalesce(d, length(q)), length(q)) / length(q) ELSE 0 END, 6) AS identity FROM s LEFT JOIN best USING (q, t)""")
def infix_identities(spark: SparkSession, d: str) -> DataFrame:
    bases = lambda *c: F.translate(F.regexp_replace(F.lower(F.concat(*c)), "[^aeioulnr]", ""), "aeioulnr", "ACGTACGT")
    rows = tpch.table(spark, d, "part").select("p_partkey", bases("p_type").alias("q"), bases("p_name", "p_brand", "p_name").alias("t"))
    identity = seq.infix_identity(F.col("q"), F.col("t"))
    return rows.select("p_partkey", F.round((1 - identity) * F.length("q")).cast("long").alias("distance"), F.round(identity, 6).alias("identity"))


@query(f"""WITH s AS (SELECT source AS g, {BASES.format(c='text')} AS t FROM documents), places AS (SELECT g, t, unnest(range(1, length(t) - 9)) AS i FROM s WHERE length(t) >= 11),
k AS (SELECT DISTINCT g, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS w FROM (SELECT g, substr(t, i, 11) AS w FROM places)), size AS (SELECT g, count(*) AS n FROM k GROUP BY 1),
both_have AS (SELECT a.g AS g1, b.g AS g2, count(*) AS shared FROM k a JOIN k b ON a.w = b.w AND a.g < b.g GROUP BY 1, 2)
SELECT g1, g2, shared, round(pow(greatest(shared / x.n, shared / y.n), 1 / 11), 6) AS ani, round(shared / x.n, 6) AS align_1, round(shared / y.n, 6) AS align_2 FROM both_have JOIN size x ON x.g = g1 JOIN size y ON y.g = g2""")
def genome_identities(spark: SparkSession, d: str) -> DataFrame:
    """The letters of all documents as bases, a source as a genome: shared k-mers without a hash, and the identity from them."""
    text = F.translate(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^aeioulnr]+", ""), "aeioulnr", "ACGTACGT")
    rows = tpch.table(spark, d, "documents").select(F.col("source").alias("genome_id"), text.alias("sequence"))
    found = sketches.genome_identities(rows, k=11, scaled=1)
    return found.select("g1", "g2", "shared", *[F.round(c, 6).alias(c) for c in ("ani", "align_1", "align_2")])


@query(f"""WITH s AS (SELECT p_partkey, p_name || p_type AS cluster_id, p_brand AS genome_id, {BASES.format(c='p_type || p_name')} AS q, {BASES.format(c='p_brand || p_name || p_type || p_name')} AS t FROM part),
wires AS (SELECT DISTINCT least(a.cluster_id, b.cluster_id) AS src, greatest(a.cluster_id, b.cluster_id) AS dst FROM s a JOIN s b ON b.p_partkey = a.p_partkey + 1 WHERE a.cluster_id <> b.cluster_id),
presence AS (SELECT DISTINCT cluster_id, genome_id FROM s), missing AS (SELECT DISTINCT dst, p.genome_id FROM wires JOIN presence p ON p.cluster_id = src WHERE NOT EXISTS (SELECT 1 FROM presence o WHERE o.cluster_id = dst AND o.genome_id = p.genome_id)),
asked AS (SELECT dst, m.genome_id, any_value(q) AS q FROM missing m JOIN s ON s.cluster_id = dst GROUP BY 1, 2 HAVING length(any_value(q)) >= 10), pairs AS (SELECT DISTINCT q, t FROM asked JOIN (SELECT DISTINCT genome_id, t FROM s) USING (genome_id)),
cut AS (SELECT q, t, unnest(range(1, length(t) + 1)) AS i FROM pairs), pieces AS (SELECT q, t, substr(t, i, n) AS piece FROM (SELECT q, t, i, unnest(range(1, 2 * length(q) + 1)) AS n FROM cut)),
best AS (SELECT q, t, min(levenshtein(q, piece)) AS d FROM pieces GROUP BY 1, 2)
SELECT DISTINCT dst, genome_id FROM asked JOIN (SELECT DISTINCT genome_id, t FROM s) USING (genome_id) JOIN best USING (q, t) WHERE 1 - d / length(q) >= 0.7""")
def refound_genes(spark: SparkSession, d: str) -> DataFrame:
    """A part's name and type as a gene, a brand as a genome: genes that a neighbour's brands lack, looked for in those brands' texts."""
    bases = lambda *c: F.translate(F.regexp_replace(F.lower(F.concat(*c)), "[^aeioulnr]", ""), "aeioulnr", "ACGTACGT")
    rows = tpch.table(spark, d, "part").select("p_partkey", F.concat("p_name", "p_type").alias("cluster_id"), F.col("p_brand").alias("genome_id"), bases("p_type", "p_name").alias("query"), bases("p_brand", "p_name", "p_type", "p_name").alias("sequence"))
    after = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("cluster_id").alias("other"))
    wires = rows.join(after, "p_partkey").where("cluster_id <> other").select(F.least("cluster_id", "other").alias("src"), F.greatest("cluster_id", "other").alias("dst")).distinct()
    missing = correction.missing_genomes(wires, rows.select("cluster_id", "genome_id").distinct())
    genes = rows.groupBy("cluster_id").agg(F.min("query").alias("sequence"))
    return correction.refound(missing, genes, rows.select("genome_id", "sequence").distinct())


@query("""SELECT event_id, replace(replace(replace(replace(replace(replace(replace(replace(props, '%', '%25'), chr(9), '%09'), chr(10), '%0A'), chr(13), '%0D'), ';', '%3B'), '=', '%3D'), '&', '%26'), ',', '%2C') AS gff,
replace(replace(props, '\\', '\\\\'), '"', '\\"') AS gml, props AS back, translate(event_type || '/' || props, '/\\:', '___') AS file_name FROM events""")
def escapes(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("props")
    return tpch.table(spark, d, "events").select("event_id", txt.gff_escape(p).alias("gff"), txt.gml_escape(p).alias("gml"), txt.gml_unescape(txt.gml_escape(p)).alias("back"), txt.file_safe(F.concat_ws("/", "event_type", "props")).alias("file_name"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS id, event_type || '=x' AS kind, NULL AS other FROM events".replace("NULL AS other", "CAST(NULL AS VARCHAR) AS other"))
def attribute_map(spark: SparkSession, d: str) -> DataFrame:
    e = tpch.table(spark, d, "events")
    text = F.concat(F.lit("ID=first;ID="), F.col("user_id").cast("string"), F.lit(";kind="), F.col("event_type"), F.lit("=x;other"))
    m = txt.attributes(text)
    return e.select("event_id", F.try_element_at(m, F.lit("ID")).alias("id"), F.try_element_at(m, F.lit("kind")).alias("kind"), F.try_element_at(m, F.lit("other")).alias("other"))


@query("SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS stem FROM pages")
def file_stems(spark: SparkSession, d: str) -> DataFrame:
    return tpch.table(spark, d, "pages").select("page_id", txt.file_stem(F.col("url")).alias("stem"))


@query("SELECT doc_id, CAST(n AS INTEGER) - 1 AS line_idx, rtrim(line, chr(13)) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return annotation.lines(tpch.table(spark, d, "documents").select("doc_id", F.col("text").alias("value")))


#: A file of annotations for each nation: its suppliers as genes on one contig.
GFF_SQL = """(SELECT s_nationkey, s_suppkey, 1 + s_suppkey % 50 AS start, 30 + s_suppkey % 60 AS stop, CASE WHEN s_suppkey % 2 = 0 THEN '-' ELSE '+' END AS strand, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier)"""


def gff_files(spark: SparkSession, d: str) -> DataFrame:
    s = tpch.table(spark, d, "supplier")
    line = F.concat_ws("\t", F.concat(F.lit("c"), F.col("s_nationkey")), F.lit("x"), F.when(F.col("s_suppkey") % 5 == 0, "gene").otherwise("CDS"), (1 + F.col("s_suppkey") % 50).cast("string"), (30 + F.col("s_suppkey") % 60).cast("string"), F.lit("."), F.when(F.col("s_suppkey") % 2 == 0, "-").otherwise("+"), F.lit("0"), F.concat(F.lit("ID=g"), F.col("s_suppkey"), F.lit(";product=p"), F.col("s_nationkey")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))), lambda x: x["line"]), "\n")
    files = s.groupBy("s_nationkey").agg(body.alias("body"))
    fasta = F.concat(F.lit("\n##FASTA\n>c"), F.col("s_nationkey"), F.lit(" contig\n"), F.repeat(F.lit("ACGGT"), 14), F.lit("\n"), F.repeat(F.lit("ATTCG"), 14), F.lit("\n"))
    return files.select(F.concat(F.lit("n"), F.col("s_nationkey")).alias("genome_id"), F.lit(0).alias("file_idx"), F.concat(F.lit("##gff-version 3\n"), F.col("body"), fasta).alias("value"))


@query(f"""WITH kinds AS (SELECT s_nationkey, bool_or(s_suppkey % 5 <> 0) AS has_cds FROM supplier GROUP BY 1), cut AS (SELECT *, substr(repeat('ACGGT', 14) || repeat('ATTCG', 14), start, stop - start + 1) AS dna FROM {GFF_SQL})
SELECT 'n' || s_nationkey AS genome_id, CAST(n AS BIGINT) AS line_idx, 'g' || s_suppkey AS gene_id, 'c' || s_nationkey AS contig, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, strand, 'p' || s_nationkey AS annotation,
CASE WHEN start > stop THEN '' WHEN strand = '-' THEN translate(reverse(dna), 'ACGT', 'TGCA') ELSE dna END AS sequence FROM cut JOIN kinds USING (s_nationkey) WHERE s_suppkey % 5 <> 0 OR NOT has_cds""")
def annotation_scan(spark: SparkSession, d: str) -> DataFrame:
    g = annotation.gff_genes(gff_files(spark, d))
    return g.select("genome_id", "line_idx", "gene_id", "contig", "start", F.col("end").alias("stop"), "strand", "annotation", "sequence")


@query("SELECT lang || doc_id AS id, length(regexp_replace(text, '\\s', '', 'g')) AS length FROM documents WHERE NOT regexp_matches(text, '(^|[\\r\\n])>') AND length(regexp_replace(text, '\\s', '', 'g')) > 0")
def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    files = tpch.table(spark, d, "documents").select(F.concat(F.lit(">"), F.col("lang"), F.col("doc_id"), F.lit(" a header\n"), F.coalesce("text", F.lit(""))).alias("value"))
    return annotation.fasta_records(files).select("id", F.length("sequence").alias("length"))


@query("SELECT o_orderkey, least(o_orderpriority, o_orderstatus) AS low, greatest(o_orderpriority, o_orderstatus) AS high FROM orders")
def canonical_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("o_orderpriority"), F.col("o_orderstatus")
    return tpch.table(spark, d, "orders").select("o_orderkey", txt.pair_low(a, b).alias("low"), txt.pair_high(a, b).alias("high"))


@query("SELECT n_nationkey, '{\"id\":' || n_nationkey || ',\"label\":\"' || n_name || '\"}' AS json FROM nation")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return tpch.table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("label"))).alias("json"))
