"""Trait association, correlation of clusters, assembly statistics and scaling of distances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.curves import log_factorials
from strandloom.operators.shared import folded, shared_counts
from strandloom.session import stored


def contingency(presence: DataFrame, traits: DataFrame) -> DataFrame:
    """(cluster_id, trait, n11, n10, n01, n00) of presence and a 0/1 trait (genome_id, trait, value)."""
    totals = F.broadcast(traits.groupBy("trait").agg(F.sum("value").cast("long").alias("pos"), F.count(F.lit(1)).alias("n")))
    seen = presence.select("cluster_id", "genome_id").distinct().join(F.broadcast(traits), "genome_id").groupBy("cluster_id", "trait").agg(F.sum("value").cast("long").alias("n11"), F.count(F.lit(1)).alias("present"))
    return seen.join(totals, "trait").select("cluster_id", "trait", "n11", (F.col("present") - F.col("n11")).alias("n10"), (F.col("pos") - F.col("n11")).alias("n01"), (F.col("n") - F.col("pos") - F.col("present") + F.col("n11")).alias("n00"))


def odds_ratio(t: DataFrame) -> Column:
    return F.when((F.col("n10") * F.col("n01")) > 0, F.col("n11") * F.col("n00") / (F.col("n10") * F.col("n01")))


def fisher(tables: DataFrame, n: int) -> DataFrame:
    """tables with odds_ratio and p_value: two-sided exact test, at most n genomes.

    The log factorials are one array of n + 1 numbers on every row's plan; a table's
    probabilities are summed over its possible first cells.
    """
    spark = tables.sparkSession
    lf = [r["lf"] for r in log_factorials(spark, n).orderBy("i").collect()]
    known = F.array(*[F.lit(float(x)) for x in lf])

    def at(i: Column) -> Column:
        return F.element_at(known, (i + 1).cast("int"))

    row1, row2 = F.col("n11") + F.col("n10"), F.col("n01") + F.col("n00")
    col1, total = F.col("n11") + F.col("n01"), F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")

    def log_p(a: Column) -> Column:
        return at(row1) + at(row2) + at(col1) + at(total - col1) - at(total) - at(a) - at(row1 - a) - at(col1 - a) - at(row2 - col1 + a)

    lo, hi = F.greatest(F.lit(0).cast("long"), col1 - row2), F.least(row1, col1)
    own = log_p(F.col("n11"))
    p = F.aggregate(F.sequence(lo, hi), F.lit(0.0), lambda acc, a: acc + F.when(log_p(a) <= own + 1e-7, F.exp(log_p(a))).otherwise(F.lit(0.0)))
    return tables.withColumn("odds_ratio", odds_ratio(tables)).withColumn("p_value", F.least(F.lit(1.0), p))


def false_discovery(tested: DataFrame, by: list[str]) -> DataFrame:
    """tested with fdr: the least of p * m / rank from here to the largest p, 1 at most.

    Equal p-values are ranked together, so the window runs over distinct p-values only.
    """
    p = tested.groupBy(*by, "p_value").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(*by).orderBy("p_value")
    ranked = p.withColumn("rank", F.sum("n").over(up)).withColumn("m", F.sum("n").over(Window.partitionBy(*by)))
    down = Window.partitionBy(*by).orderBy(F.desc("p_value"))
    fdr = ranked.withColumn("fdr", F.least(F.lit(1.0), F.min(F.col("p_value") * F.col("m") / F.col("rank")).over(down)))
    return tested.join(fdr.select(*by, "p_value", "fdr"), [*by, "p_value"])


def significant(tested: DataFrame, level: float = 0.05) -> DataFrame:
    return tested.withColumn("significant", F.when(F.col("fdr") < level, "yes").otherwise("no"))


def mutual_information(presence: DataFrame, n: int, least: float | None = None) -> DataFrame:
    """(c1, c2, mi) in nats of clusters that share a genome; n genomes. least: only pairs of that much.

    Clusters with the same genomes are folded into a pattern (a row per genome at most), the
    patterns are compared by bitmap blocks and only wanted pairs of patterns are spread to their clusters.
    """
    named = folded(presence)
    p = stored(named.groupBy("pattern").agg(F.first("genomes").alias("genomes")).select("pattern", F.size("genomes").alias("m"), F.explode("genomes").alias("genome_id")), "members")
    both = shared_counts(p.select(F.col("genome_id").alias("item"), F.col("pattern").alias("owner")))
    own = p.select("pattern", "m").distinct()
    rows = both.withColumnsRenamed({"a": "p1", "b": "p2", "shared": "n11"}).join(own.toDF("p1", "m1"), "p1").join(own.toDF("p2", "m2"), "p2")
    rows = rows.select("p1", "p2", "m1", "m2", "n11").unionByName(own.select(F.col("pattern").alias("p1"), F.col("pattern").alias("p2"), F.col("m").alias("m1"), F.col("m").alias("m2"), F.col("m").cast("long").alias("n11")))

    def cell(count: Column, a: Column, b: Column) -> Column:
        return F.when(count > 0, count / n * F.ln(count * n / (a * b))).otherwise(F.lit(0.0))

    n11, m1, m2 = F.col("n11"), F.col("m1"), F.col("m2")
    mi = cell(n11, m1, m2) + cell(m1 - n11, m1, n - m2) + cell(m2 - n11, n - m1, m2) + cell(n - m1 - m2 + n11, n - m1, n - m2)
    scored = rows.select("p1", "p2", mi.alias("mi"))
    if least is not None:
        scored = scored.where(F.col("mi") >= least)
    a, b = (named.select(F.col("pattern").alias(f"p{k}"), F.col("cluster_id").alias(c)) for k, c in ((1, "a"), (2, "b")))
    spread = scored.join(a, "p1").join(b, "p2").where((F.col("p1") != F.col("p2")) | (F.col("a") < F.col("b")))
    return spread.select(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2"), "mi")


def length_statistics(lengths: DataFrame, by: list[str], k: int = 31) -> DataFrame:
    """n, total, mean, n50 (half by whole numbers) and k-mers of (length) by group.

    Lengths are counted first, so the window runs over distinct lengths.
    """
    n = lengths.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("length"))
    run = n.withColumn("run", F.sum(F.col("n") * F.col("length")).over(w)).withColumn("total", F.sum(F.col("n") * F.col("length")).over(Window.partitionBy(*by)))
    kmers = F.sum(F.col("n") * F.greatest(F.col("length") - k + 1, F.lit(0).cast("long")))
    half = F.floor(F.col("total") / 2)
    return run.groupBy(*by).agg(F.sum("n").alias("n"), F.max("total").alias("total"), (F.max("total") / F.sum("n")).alias("mean"), F.max(F.when(F.col("run") >= half, F.col("length"))).alias("n50"), kmers.alias("kmers"))


def double_centred(distances: DataFrame) -> DataFrame:
    """(i, j, b): -d2/2 less its row and column means plus the grand mean, of symmetric (i, j, d)."""
    sq = distances.withColumn("v", -0.5 * F.col("d") * F.col("d"))
    rows = sq.groupBy("i").agg(F.avg("v").alias("ri"))
    cols = sq.groupBy("j").agg(F.avg("v").alias("cj"))
    grand = sq.agg(F.avg("v").alias("g"))
    return sq.join(F.broadcast(rows), "i").join(F.broadcast(cols), "j").crossJoin(F.broadcast(grand)).select("i", "j", (F.col("v") - F.col("ri") - F.col("cj") + F.col("g")).alias("b"))


def scaled_plane(pairs: DataFrame, labels: list[str], rounds: int = 200, eps: float = 1e-10) -> list[tuple[str, float, float]]:
    """(genome, x, y) by classical scaling of (g1, g2, distance); one row and column per genome.

    Centring runs in Spark; the matrix of the genomes (a few thousand at most) is solved on the
    driver by power iteration with deflation.
    """
    both = pairs.select(F.col("g1").alias("i"), F.col("g2").alias("j"), F.col("distance").alias("d")).unionByName(pairs.select(F.col("g2").alias("i"), F.col("g1").alias("j"), F.col("distance").alias("d")))
    own = pairs.sparkSession.createDataFrame([(x, x, 0.0) for x in labels], "i string, j string, d double")
    at = {x: k for k, x in enumerate(labels)}
    b = np.zeros((len(labels), len(labels)))
    for r in double_centred(both.unionByName(own)).toLocalIterator():
        b[at[r["i"]], at[r["j"]]] = r["b"]
    axes = []
    for _ in range(2):
        v = np.ones(len(b)) + np.arange(len(b)) * 1e-3
        value = 0.0
        for _ in range(rounds):
            w = b @ v
            norm = float(np.linalg.norm(w))
            if norm < eps:
                break
            w /= norm
            done = float(np.abs(w - v).max()) < eps
            v, value = w, float(w @ b @ w)
            if done:
                break
        axes.append(v * np.sqrt(max(value, 0.0)))
        b = b - value * np.outer(v, v)
    return [(x, float(axes[0][k]), float(axes[1][k])) for x, k in at.items()]
