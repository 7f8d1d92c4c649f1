"""How many items two owners share, for all pairs of owners, by blocks of bitmaps.

Owners are dealt into tiles and items into chunks of one bitmap each, by hash. A tile's bitmaps of a chunk are multiplied with those of every tile: AND and a count of
bits for each pair of owners. Sums over chunks are the counts. So an item that all owners have
costs a bit for each, not a row for each pair, and no row is wider than a tile of bitmaps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import ship, stored

#: Bits of a bitmap as bitmap_construct_agg() makes them, and owners of a tile: at most 1 MB together.
CHUNK, TILE = 32_768, 256
#: Pairs of tiles that a Python worker has in memory at once.
AT_ONCE = 8
_CELLS = T.ArrayType(T.StructType([T.StructField("r1", T.IntegerType()), T.StructField("r2", T.IntegerType()), T.StructField("n", T.LongType())]))


@F.pandas_udf(_CELLS)
def _products(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def words(tile) -> tuple[np.ndarray, np.ndarray]:
        return np.array([x["row"] for x in tile], dtype="i4"), np.frombuffer(b"".join(x["bits"] for x in tile), dtype="u8").reshape(len(tile), -1)

    for left, right, same in batches:
        out = []
        for one, other, own in zip(left, right, same, strict=True):
            (r1, w1), (r2, w2) = words(one), words(other)
            cells = []
            for row, bits in zip(r1, w1):
                n = np.bitwise_count(w2 & bits).sum(axis=1, dtype="i8")
                keep = np.flatnonzero((n > 0) & ((r2 > row) | (not own)))
                cells += [{"r1": int(row), "r2": int(b), "n": int(c)} for b, c in zip(r2[keep], n[keep])]
            out.append(cells)
        yield pd.Series(out)


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written with few rows in an Arrow batch; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(AT_ONCE))
    try:
        return stored(df, name)
    finally:
        spark.conf.set(key, before)


def _dealt(names: DataFrame, name: str, most: int, group: str, place: str) -> DataFrame:
    """(name, group, place): names dealt by hash into groups of most or fewer, each with its place in its group."""
    names = stored(names, "names")
    n = names.count()
    groups = 1 if n <= most else math.ceil(n / (0.9 * most))
    by_hash = Window.partitionBy("hashed").orderBy(name)
    found = names.withColumn("hashed", F.pmod(F.xxhash64(name), F.lit(groups))).withColumn("n", F.row_number().over(by_hash) - 1)
    return found.select(name, (F.col("hashed") * (1 << 20) + F.expr(f"n div {most}")).alias(group), (F.col("n") % most).alias(place))  # what a group has too many is one more group


def shared_counts(members: DataFrame) -> DataFrame:
    """(a, b, shared) of (item, owner): pairs of owners, a < b, with the number of items that both have, where there are any."""
    ship(members.sparkSession)
    rows = stored(members.select("item", "owner").distinct(), "members")
    owners = stored(_dealt(rows.select("owner").distinct(), "owner", TILE, "tile", "row"), "owners")
    items = _dealt(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("item"), "item", CHUNK, "chunk", "bit")
    placed = rows.join(items, "item").join(owners, "owner")
    return _multiplied(placed.groupBy("chunk", "tile", "row").agg(F.bitmap_construct_agg("bit").alias("bits")), owners)


def shared_bits(maps: DataFrame) -> DataFrame:
    """As shared_counts(), of items that are bits already: (owner, chunk, bits), once each, of CHUNK bits."""
    ship(maps.sparkSession)
    owners = stored(_dealt(maps.select("owner").distinct(), "owner", TILE, "tile", "row"), "owners")
    return _multiplied(maps.join(owners, "owner").select("chunk", "tile", "row", "bits"), owners)


def _multiplied(maps: DataFrame, owners: DataFrame) -> DataFrame:
    """(a, b, shared) of bitmaps (chunk, tile, row, bits) of owners(owner, tile, row)."""
    tiles = stored(maps.groupBy("chunk", "tile").agg(F.sort_array(F.collect_list(F.struct("row", "bits"))).alias("rows")), "tiles")
    one, other = (tiles.select("chunk", F.col("tile").alias(f"t{k}"), F.col("rows").alias(f"rows{k}")) for k in (1, 2))
    paired = one.join(other, "chunk").where("t1 <= t2").repartition("chunk", "t1", "t2")
    cells = _kept(maps.sparkSession, paired.select("t1", "t2", _products("rows1", "rows2", F.col("t1") == F.col("t2")).alias("cells")), "cells")
    sums = cells.select("t1", "t2", F.explode("cells").alias("c")).groupBy("t1", F.col("c.r1").alias("r1"), "t2", F.col("c.r2").alias("r2")).agg(F.sum("c.n").alias("shared"))
    x, y = (owners.select(F.col("tile").alias(f"t{k}"), F.col("row").alias(f"r{k}"), F.col("owner").alias(name)) for k, name in ((1, "x"), (2, "y")))
    return sums.join(x, ["t1", "r1"]).join(y, ["t2", "r2"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "shared")


def folded(presence: DataFrame) -> DataFrame:
    """(cluster_id, pattern, genomes), stored: clusters with the same genomes have the same pattern."""
    sets = presence.groupBy("cluster_id").agg(F.sort_array(F.collect_set("genome_id")).alias("genomes"))
    return stored(sets.select("cluster_id", F.sha2(F.array_join("genomes", "\x1f"), 256).alias("pattern"), "genomes"), "patterns")
