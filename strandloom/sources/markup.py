"""Graph files: a line-state reader that works on byte ranges of large files.

A file is read as lines, range by range. A block begins at a `node [` or `edge [` line, and the
task that reads a range puts its blocks together where the lines lie, so no line is shuffled. Only
what stands at the borders of ranges, the lines before the first block and the last block, is
gathered by file and joined. Brackets and quotes inside values don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import text as txt
from strandloom.session import ship, stored

#: Names of nodes that may be broadcast to the ends of edges; beyond, the join shuffles.
BROADCAST_NAMES = 400_000
_OPENS = r"^(?:node|edge)[ \t\n\v\f\r]*\[$"
_FOUND = "file long, range long, kind string, border boolean, lines array<string>"


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, and lines before the first one of a range (kind ''), of the lines of ranges; border: may go on in the next range, or did in the one before."""
    held = None  # the lines of a block or head whose end hasn't come yet
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        table = table.combine_chunks()
        if not table.num_rows:
            continue
        file, at, lines = (table.column(c).chunk(0) for c in ("file", "range", "line"))
        opens = pc.match_substring_regex(lines, _OPENS).to_numpy(zero_copy_only=False)
        other = np.concatenate(([True], (np.diff(file.to_numpy()) != 0) | (np.diff(at.to_numpy()) != 0)))
        first = np.flatnonzero(opens | other)
        if len(first) > 1:
            yield _cut(file, at, lines, opens, other, first)
        held = table.slice(first[-1])
    if held is not None:
        file, at, lines = (held.combine_chunks().column(c).chunk(0) for c in ("file", "range", "line"))
        opens = pc.match_substring_regex(lines, _OPENS).to_numpy(zero_copy_only=False)
        yield _cut(file, at, lines, opens, np.array([True]), np.array([0, len(lines)]))


def _cut(file: pa.Array, at: pa.Array, lines: pa.Array, opens: np.ndarray, other: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    """The runs of lines that begin at first, without the last; other: a range begins, past the end too."""
    begin, end = first[:-1], first[1:]
    ends_range = np.append(other, True)[end] if len(other) == len(lines) else np.array([True])
    kind = np.where(opens[begin], pc.utf8_slice_codeunits(lines.take(pa.array(begin)), 0, 4).to_numpy(zero_copy_only=False), "")
    own = pa.array(begin)
    return pa.RecordBatch.from_arrays([file.take(own), at.take(own), pa.array(kind.astype(object), pa.string()), pa.array((kind == "") | ends_range), pa.ListArray.from_arrays(pa.array(first.astype("i4")), lines)], names=["file", "range", "kind", "border", "lines"])


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, kind, lines): the trimmed lines of each block, in order, the opening one first."""
    ship(spark)
    line = F.trim(F.col("value"), F.lit(" \t\n\x0b\f\r"))
    raw = spark.read.text(path).select(F.xxhash64(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("range"), line.alias("line"))
    found = stored(raw.where("line not in ('', ']')").mapInArrow(_ranges, _FOUND), "blocks")
    # a last block goes on with the heads of the ranges after it, until one has a block of its own
    in_file = Window.partitionBy("file").orderBy("range", F.col("kind") != "").rowsBetween(Window.unboundedPreceding, 0)
    border = found.where("border").withColumn("k", F.count_if(F.col("kind") != "").over(in_file)).where("k > 0")
    gathered = F.array_sort(F.collect_list(F.struct("range", "lines")))
    joined = border.groupBy("file", "k").agg(F.max("kind").alias("kind"), F.flatten(F.transform(gathered, lambda x: x["lines"])).alias("lines"))
    return found.where("not border").select("file", "kind", "lines").unionByName(joined.select("file", "kind", "lines"))


def graph_markup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph files: flags and lists typed, ends of edges by cluster id.

    Ids are labels in quotes, or numbers with a label beside them; edges may name either. Lists
    are blocks of quoted lines, or one quoted value. A node without a support has 1, an edge the
    number of its genomes. Of several centroids the first is the sequence.
    """
    blocks = _blocks(spark, path)

    def last(*names: str, quoted: bool = False) -> Column:
        named = lambda x: x.rlike(rf"^(?:{'|'.join(names)})(?!\w)")
        return F.try_element_at(F.filter("lines", lambda x: named(x) & x.rlike('".*"') if quoted else named(x)), F.lit(-1))

    def text(line: Column) -> Column:
        return txt.gml_unescape(F.regexp_extract(line, r'^[^"]*"(.*)"[^"]*$', 1))

    def split(value: Column, by: str) -> Column:
        return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")

    bare = lambda line: F.regexp_extract(line, r"^\w+\s+(\S+)", 1)
    either = lambda name: F.when(last(name).rlike('".*"'), text(last(name))).otherwise(bare(last(name)))
    number = lambda *names: bare(last(*names)).try_cast("double").cast("long")
    flag = lambda *names: F.coalesce(number(*names), F.lit(0)) != 0
    entries = F.transform(F.filter("lines", lambda x: x.startswith('"')), text)
    genomes = F.array_union(F.sort_array(F.array_distinct(entries)), split(text(last("genomes")), ";")).alias("genomes")
    node = blocks.where("kind = 'node'").withColumn("id", either("id")).withColumn("cluster_id", F.coalesce(text(last("id", "label", quoted=True)), "id")).where("cluster_id is not null")
    nodes = node.select(
        "cluster_id", F.coalesce(number("support", "weight"), F.lit(1)).alias("support"), genomes, split(text(last("member", "members")), ";").alias("members"),
        split(text(last("contig_end_genomes", "contig_ends")), "[,;]").alias("contig_end_genomes"), flag("is_paralog", "paralog").alias("is_paralog"), flag("is_highly_variable", "highly_variable").alias("is_highly_variable"),
        F.coalesce(text(last("annotation")), F.lit("")).alias("annotation"), F.split(F.coalesce(text(last("seq")), F.lit("")), ",")[0].alias("sequence"),
    )
    names = stored(node.where("id <> cluster_id").select("file", "id", "cluster_id"), "names")
    few = names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    raw = blocks.where("kind = 'edge'").select("file", F.coalesce(either("source"), F.lit("unknown")).alias("s"), F.coalesce(either("target"), F.lit("unknown")).alias("t"), genomes, number("support", "weight").alias("support"))
    for side in ("s", "t"):
        to = names.withColumnsRenamed({"id": side, "cluster_id": f"{side}_name"})
        raw = raw.join(F.broadcast(to) if few else to, ["file", side], "left")
    a, b = F.coalesce("s_name", "s"), F.coalesce("t_name", "t")
    return nodes, raw.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "genomes", F.coalesce("support", F.size("genomes").cast("long")).alias("support"))
