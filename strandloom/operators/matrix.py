"""Operators on presence(cluster_id, genome_id): counts, bands, pivots, pairs of genomes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.shared import shared_counts

# The least shares of genomes of the bands.
CORE, SOFT_CORE, SHELL = 0.99, 0.95, 0.15


def genome_total(presence: DataFrame) -> DataFrame:
    """One row: n_total, the number of genomes."""
    return presence.agg(F.count_distinct("genome_id").alias("n_total"))


def cluster_counts(presence: DataFrame) -> DataFrame:
    """(cluster_id, n_genomes)."""
    return presence.groupBy("cluster_id").agg(F.count_distinct("genome_id").alias("n_genomes"))


def genome_counts(presence: DataFrame) -> DataFrame:
    """(genome_id, n_clusters)."""
    return presence.groupBy("genome_id").agg(F.count_distinct("cluster_id").alias("n_clusters"))


def total_present(presence: DataFrame) -> DataFrame:
    return presence.select("cluster_id", "genome_id").distinct().agg(F.count(F.lit(1)).alias("total_present"))


def band(share: Column) -> Column:
    return F.when(share >= CORE, "core").when(share >= SOFT_CORE, "soft_core").when(share >= SHELL, "shell").otherwise("cloud")


def with_share(presence: DataFrame) -> DataFrame:
    """(cluster_id, n_genomes, n_total, share); the total is a single row, so the join is a broadcast of one row."""
    counts = cluster_counts(presence).crossJoin(F.broadcast(genome_total(presence)))
    return counts.withColumn("share", F.col("n_genomes") / F.col("n_total"))


def classified(presence: DataFrame) -> DataFrame:
    return with_share(presence).withColumn("band", band(F.col("share")))


def partition_summary(presence: DataFrame) -> DataFrame:
    """(band, n_clusters)."""
    return classified(presence).groupBy("band").agg(F.count(F.lit(1)).alias("n_clusters"))


def is_core(share: Column, least: float) -> Column:
    return share >= least


def core_threshold(genomes: int, share: float = CORE) -> int:
    """max(1, ceil(share * genomes)); 1 without genomes."""
    return max(1, math.ceil(share * genomes)) if genomes else 1


def core_clusters(presence: DataFrame, least: float = CORE) -> DataFrame:
    """(cluster_id) of at least this share of the genomes."""
    return with_share(presence).where(is_core(F.col("share"), least)).select("cluster_id")


def core_accessory(presence: DataFrame, core: float = CORE) -> DataFrame:
    """One row: clusters at or above the core threshold, and the rest."""
    c = with_share(presence)
    least = F.greatest(F.lit(1), F.ceil(F.lit(core) * F.col("n_total")))
    return c.agg(F.count_if(F.col("n_genomes") >= least).alias("n_core"), F.count_if(F.col("n_genomes") < least).alias("n_accessory"))


def frequency_histogram(presence: DataFrame) -> DataFrame:
    """(n_genomes, n_families)."""
    return cluster_counts(presence).groupBy("n_genomes").agg(F.count(F.lit(1)).alias("n_families"))


def histogram_bands(histogram: DataFrame, genomes: int) -> DataFrame:
    """(band, n_families) of a frequency histogram; no row without genomes."""
    if not genomes:
        return histogram.select(F.lit("").alias("band"), F.lit(0).cast("long").alias("n_families")).limit(0)
    return histogram.groupBy(band(F.col("n_genomes") / genomes).alias("band")).agg(F.sum("n_families").alias("n_families"))


def genome_profile(presence: DataFrame) -> DataFrame:
    """(genome_id, n_core, n_accessory); core is what all genomes have."""
    counts = with_share(presence).select("cluster_id", (F.col("n_genomes") == F.col("n_total")).alias("core"))
    rows = presence.select("cluster_id", "genome_id").distinct().join(counts, "cluster_id")
    return rows.groupBy("genome_id").agg(F.count_if("core").alias("n_core"), F.count_if(~F.col("core")).alias("n_accessory"))


def presence_variance(presence: DataFrame) -> DataFrame:
    """(cluster_id, variance): p(1-p)."""
    return with_share(presence).select("cluster_id", (F.col("share") * (1 - F.col("share"))).alias("variance"))


def most_variable(presence: DataFrame, n: int = 50) -> DataFrame:
    """The report of the n clusters of largest variance, ties by id."""
    return presence_variance(presence).orderBy(F.desc("variance"), "cluster_id").limit(n)


def binary_matrix(presence: DataFrame, genomes: list[str]) -> DataFrame:
    """cluster_id and a 0/1 column for each genome."""
    wide = presence.select("cluster_id", "genome_id").distinct().groupBy("cluster_id").pivot("genome_id", genomes).agg(F.lit(1))
    return wide.na.fill(0)


def genome_matrix(presence: DataFrame, clusters: list[str]) -> DataFrame:
    """genome_id and a 0/1 column for each cluster of a bounded list."""
    wide = presence.select("cluster_id", "genome_id").distinct().groupBy("genome_id").pivot("cluster_id", clusters).agg(F.lit(1))
    return wide.na.fill(0)


def packed_rows(presence: DataFrame) -> DataFrame:
    """(cluster_id, bits): one bitmap a cluster, genome ranks as bit numbers."""
    ranks = presence.select("genome_id").distinct().withColumn("bit", F.row_number().over(Window.orderBy("genome_id")) - 1)
    rows = presence.select("cluster_id", "genome_id").distinct().join(F.broadcast(ranks), "genome_id")
    return rows.groupBy("cluster_id").agg(F.bitmap_construct_agg("bit").alias("bits"))


def packed_counts(packed: DataFrame) -> DataFrame:
    return packed.select("cluster_id", F.bitmap_count("bits").alias("n_genomes"))


def member_cells(members: DataFrame) -> DataFrame:
    """(cluster_id, genome_id, cell): the gene ids of a cell, sorted and joined by ';'."""
    return members.groupBy("cluster_id", "genome_id").agg(F.array_join(F.sort_array(F.collect_list("gene_id")), ";").alias("cell"))


def genome_pairs(presence: DataFrame) -> DataFrame:
    """(g1, g2, shared, either, distance) of all pairs of genomes, 1 - shared/either; what they share comes from bitmap blocks."""
    p = presence.select("cluster_id", "genome_id").distinct()
    size = p.groupBy("genome_id").agg(F.count(F.lit(1)).alias("n"))
    both = shared_counts(p.select(F.col("cluster_id").alias("item"), F.col("genome_id").alias("owner"))).select(F.col("a").alias("g1"), F.col("b").alias("g2"), "shared")
    ids = size.select(F.col("genome_id").alias("g1"), F.col("n").alias("n1"))
    pairs = ids.join(F.broadcast(ids.withColumnsRenamed({"g1": "g2", "n1": "n2"})), F.col("g1") < F.col("g2"))  # one row per genome; the pairs are the result
    out = pairs.join(both, ["g1", "g2"], "left").na.fill(0, ["shared"]).withColumn("either", F.col("n1") + F.col("n2") - F.col("shared"))
    return out.select("g1", "g2", "shared", "either", F.when(F.col("either") > 0, 1 - F.col("shared") / F.col("either")).otherwise(F.lit(1.0)).alias("distance"))


def mode_length(members: DataFrame) -> DataFrame:
    """(cluster_id, mode_length) of (cluster_id, length); the smallest of equal modes."""
    n = members.groupBy("cluster_id", "length").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("cluster_id").agg(F.max_by("length", F.struct("n", -F.col("length"))).alias("mode_length"))


FRAGMENT, PSEUDOGENE, OUTLIER = "fragment", "pseudo", "length"


def filter_presence(rows: DataFrame, kinds: list[str], tolerance: float = 0.5) -> DataFrame:
    """(gene_id, annotation, protein, length, cluster_id) without fragments, pseudogenes, length outliers."""
    text = F.lower(F.concat_ws(" ", "gene_id", "annotation"))
    inner_stop = F.col("protein").rlike(r"\*.")
    if FRAGMENT in kinds:
        rows = rows.where(~F.contains("gene_id", F.lit(";")))
    if PSEUDOGENE in kinds:
        rows = rows.where(~(text.contains("pseudo") | text.contains("fragment") | F.coalesce(inner_stop, F.lit(False))))
    if OUTLIER in kinds:
        rows = rows.join(mode_length(rows), "cluster_id").where(F.abs(F.col("length") - F.col("mode_length")) / F.col("mode_length") <= tolerance).drop("mode_length")
    return rows


# Completeness and contamination by mode.
QC_MODES = {"strict": (90.0, 5.0), "default": (70.0, 10.0), "sensitive": (50.0, 20.0)}


def qc_passed(qc: DataFrame, mode: str = "default") -> DataFrame:
    """qc with passed: completeness at least and contamination at most the mode's."""
    complete, contaminated = QC_MODES[mode]
    return qc.withColumn("passed", (F.col("completeness") >= complete) & (F.col("contamination") <= contaminated))


def qc_summary(qc: DataFrame) -> DataFrame:
    return qc.agg(F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.avg("completeness").alias("mean_completeness"), F.avg("contamination").alias("mean_contamination"))


def class_counts(hits: DataFrame, column: str) -> DataFrame:
    """(column, n) by n descending, ties by name."""
    return hits.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
