"""Accumulation curves, their power-law fit, and rarefaction by sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def grid(n: int, points: int = 20) -> list[int]:
    """At most so many evenly spaced sizes from 1 to n."""
    if n <= 0:
        return []
    if n <= points or points < 2:
        return list(range(1, n + 1))
    return sorted({round(1 + (n - 1) * i / (points - 1)) for i in range(points)})


def log_factorials(spark: SparkSession, n: int) -> DataFrame:
    """(i, lf): ln(i!) for 0..n; n is the number of genomes."""
    i = spark.range(0, n + 1).select(F.col("id").alias("i"))
    return i.select("i", F.sum(F.when(F.col("i") > 0, F.ln("i")).otherwise(F.lit(0.0))).over(Window.orderBy("i")).alias("lf"))


def expected_curve(histogram: DataFrame, n: int, points: int = 20) -> DataFrame:
    """(k, total, core, accessory): exact expectations over all subsets of k of n genomes.

    histogram(n_genomes, n_families) has at most n rows, so the curve is a join of two small
    tables, whatever the number of clusters. total: 1 - C(n-c,k)/C(n,k); core: C(c,k)/C(n,k).
    """
    spark = histogram.sparkSession
    ks = spark.createDataFrame([(k,) for k in grid(n, points)], "k long")
    f = F.broadcast(log_factorials(spark, n))

    def lf(df: DataFrame, at: Column, name: str) -> DataFrame:
        return df.join(f.select(F.col("i").alias(f"__{name}"), F.col("lf").alias(name)), at == F.col(f"__{name}"), "left").drop(f"__{name}")

    rows = histogram.crossJoin(F.broadcast(ks)).withColumn("n", F.lit(n).cast("long"))
    for at, name in ((F.col("n"), "a"), (F.col("n") - F.col("k"), "b"), (F.col("n") - F.col("n_genomes"), "c"), (F.col("n") - F.col("n_genomes") - F.col("k"), "d"), (F.col("n_genomes"), "e"), (F.col("n_genomes") - F.col("k"), "f")):
        rows = lf(rows, at, name)
    missed = F.when(F.col("d").isNull(), F.lit(0.0)).otherwise(F.exp(F.col("c") - F.col("d") - F.col("a") + F.col("b")))
    full = F.when(F.col("f").isNull(), F.lit(0.0)).otherwise(F.exp(F.col("e") - F.col("f") - F.col("a") + F.col("b")))
    out = rows.groupBy("k").agg(F.sum(F.col("n_families") * (1 - missed)).alias("total"), F.sum(F.col("n_families") * full).alias("core"))
    return out.withColumn("accessory", F.col("total") - F.col("core"))


def power_law(curve: DataFrame) -> DataFrame:
    """One row: alpha, intercept and R2 of ln(total) over ln(k), and both rules of openness."""
    p = curve.where("total > 0").select(F.ln("k").alias("x"), F.ln("total").alias("y"))
    fit = p.agg(F.count(F.lit(1)).alias("points"), F.regr_slope("y", "x").alias("alpha"), F.regr_intercept("y", "x").alias("log_a"), F.regr_r2("y", "x").alias("r2"))
    openness = F.when(F.col("points") < 2, "unknown").when(F.col("alpha") >= 1, "open").otherwise("closed")
    return fit.select("points", "alpha", F.exp("log_a").alias("a"), "r2", openness.alias("openness"), F.when(F.col("alpha") > 0, "Open").otherwise("Closed").alias("growth_openness"))


def rarefaction(presence: DataFrame, order: DataFrame) -> DataFrame:
    """(rank, new_clusters, total): distinct clusters along an order (genome_id, rank)."""
    first = presence.join(F.broadcast(order), "genome_id").groupBy("cluster_id").agg(F.min("rank").alias("rank"))
    new = order.select("rank").join(first.groupBy("rank").agg(F.count(F.lit(1)).alias("new_clusters")), "rank", "left").na.fill(0)
    return new.withColumn("total", F.sum("new_clusters").over(Window.orderBy("rank")))  # one narrow row per genome


def sampled_curve(presence: DataFrame, n: int, samples: int = 100, points: int = 20, seed: int = 42) -> DataFrame:
    """(k, mean_total, mean_core, stderr) over seeded random orders of the genomes.

    For an order, a cluster counts towards the total from its least rank on, and towards the
    core up to the rank before its first missing genome.
    """
    spark = presence.sparkSession
    genomes = presence.select("genome_id").distinct()
    reps = spark.range(samples).select(F.col("id").alias("rep"))
    drawn = genomes.crossJoin(F.broadcast(reps)).withColumn("r", F.xxhash64("genome_id", "rep", F.lit(seed)))
    order = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("rep").orderBy("r", "genome_id"))).select("genome_id", "rep", "rank")
    rows = presence.select("cluster_id", "genome_id").distinct().join(F.broadcast(order), "genome_id")
    run = F.row_number().over(Window.partitionBy("cluster_id", "rep").orderBy("rank"))
    each = rows.withColumn("run", run).groupBy("rep", "cluster_id").agg(F.min("rank").alias("first"), F.count_if(F.col("run") == F.col("rank")).alias("unbroken"))
    ks = F.broadcast(spark.createDataFrame([(k,) for k in grid(n, points)], "k long"))
    counted = each.groupBy("rep", "first", "unbroken").agg(F.count(F.lit(1)).alias("n")).crossJoin(ks)
    per = counted.groupBy("rep", "k").agg(F.sum(F.when(F.col("first") <= F.col("k"), F.col("n")).otherwise(0)).alias("total"), F.sum(F.when(F.col("unbroken") >= F.col("k"), F.col("n")).otherwise(0)).alias("core"))
    return per.groupBy("k").agg(F.avg("total").alias("mean_total"), F.avg("core").alias("mean_core"), (F.stddev_samp("total") / F.sqrt(F.count(F.lit(1)))).alias("stderr"))
