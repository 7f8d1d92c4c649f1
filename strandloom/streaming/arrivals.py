"""New annotation files as a stream: each micro-batch adds its genomes to a stored graph.

The tables are versioned folders; a batch writes version n + 1 and then points to it, so a batch
that is run again after a failure starts from the same version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.functions import text as txt
from strandloom.operators import combine, graph
from strandloom.sources import annotation

TABLES = ("nodes", "edges", "centroids")


def read_version(spark: SparkSession, folder: str, version: int) -> tuple[DataFrame, ...]:
    return tuple(spark.read.parquet(f"{folder}/v{version}/{t}") for t in TABLES)


def write_version(folder: str, version: int, *frames: DataFrame) -> None:
    for name, df in zip(TABLES, frames):
        df.write.mode("overwrite").parquet(f"{folder}/v{version}/{name}")


def add_batch(folder: str, identity: float):
    """The foreachBatch function: batch n reads version n and writes version n + 1."""

    def add(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        nodes, edges, centroids = read_version(spark, folder, n)
        files = batch.select(txt.file_stem(F.col("path")).alias("genome_id"), F.lit(n).alias("file_idx"), "value")
        genes = annotation.gff_genes(files)
        grown, wired, placed = combine.integrate(nodes, edges, centroids, genes, identity)
        fresh = placed.where("new").groupBy("cluster_id").agg(F.min_by("sequence", "line_idx").alias("sequence"))
        write_version(folder, n + 1, grown, wired, centroids.unionByName(fresh))

    return add


def watch(spark: SparkSession, inputs: str, folder: str, checkpoint: str, identity: float = 0.9) -> StreamingQuery:
    """Take in what is there now and stop; run again, or with another trigger, for what comes later."""
    files = spark.readStream.format("text").option("wholetext", True).load(inputs).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.writeStream.foreachBatch(add_batch(folder, identity)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edge_counts(events: DataFrame, delay: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Adjacency support by event-time window, for gene pairs (a, b, genome_id, ts) that come late or out of order.

    The genomes of an edge are held as a set, of one entry per genome, so the support is exact. A
    window that ends before the watermark (the latest time seen less the delay) is forgotten, and
    rows of it that come later are refused.
    """
    pairs = events.withWatermark("ts", delay).select("ts", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "genome_id")
    return pairs.groupBy(F.window("ts", width), "src", "dst").agg(F.size(F.collect_set("genome_id")).cast("long").alias("support"))


def write_edge_counts(events: DataFrame, folder: str, checkpoint: str, delay: str = "10 minutes", width: str = "5 minutes") -> StreamingQuery:
    """Write what each batch changes of edge_counts() into the folder. Takes in what is there and stops; run again for what comes later.

    In update mode state is dropped behind the watermark, and a batch's output is the edges that it
    touched, under the batch's number: a batch that is run again after a failure replaces its own.
    """
    def put(batch: DataFrame, n: int) -> None:
        batch.select(F.col("window.start").alias("start"), "src", "dst", "support").write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return edge_counts(events, delay, width).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_edge_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(start, src, dst, support): of each window and edge what the last batch that touched it says."""
    schema = "start timestamp, src string, dst string, support long, batch long"
    rows = spark.read.schema(schema).option("basePath", folder).parquet(folder)
    return rows.groupBy("start", "src", "dst").agg(F.max_by("support", "batch").alias("support"))


def write_chunk(placed: DataFrame, order: list[str], folder: str, chunk: int) -> None:
    """The adjacent pairs of a chunk of genomes, as compressed Parquet; writing a chunk again replaces it."""
    graph.adjacent_pairs(placed, order).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/chunk={chunk}")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of all chunks: partial sets in each, united in the final aggregate."""
    return graph.edges_of(spark.read.parquet(folder).select("a", "b", "genome_id"))
