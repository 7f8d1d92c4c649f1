"""Near-duplicate vectors by sorted projection passes (operator 4).

Equal vectors of a label form one class. A pass concatenates the signs of random projections
into a key and orders the classes of a label lexicographically by it; the neighbour window of a
class is its run of equal keys, about RUN classes where the label is spread evenly. A crowded
run is cut into blocks of bounded size and every pair of its blocks is compared, so the window
never cuts a run short. Two vectors at the threshold share a projection's sign with a
probability that depends on nothing but their angle, so the number of passes that a label
needs to miss such a pair with probability MISS follows from its key length alone, whatever
the label's density. Keys have LEAST_BITS bits at least, with which the passes compare fewer pairs
than all of a label; only a label of up to FEW classes, about the vectors of one run of a pass,
is one run as it is: its key is empty, and one pass finds every pair.

The pairs verified in the passes are united into components, and inside each component the
links are counted in full, again in blocks. A pair of blocks returns link counts and, in place
of the pairs, the least class that each class reaches there.

Defined results. A null vec_id or label, a null or empty vector, a zero vector, and a vector with null
or non-finite components link with nothing; vectors of different lengths don't link; rows that
repeat a vec_id with the same vector count as one vector; an empty table gives no row; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.components import connected_components

#: Classes of a run, by which a label's key length is chosen; the probability of missing a pair at the threshold; the longest and the shortest key.
RUN, MISS, BITS, LEAST_BITS = 1024, 1e-6, 40, 4
#: Classes of a label that is one run.
FEW = 128
#: Numbers of a block of vectors, and cosines held at once.
BLOCK_NUMBERS, COSINES = 1 << 21, 1 << 22


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = np.array(vectors, dtype=float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _united(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's component, after the places a and b are joined too."""
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return least
        a, b = a[apart], b[apart]
        root = np.arange(len(least))
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(root, further := root[root]):
            root = further
        least = root[least]


def _compared(one: np.ndarray, other: np.ndarray | None, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, least place reached) of the unit vectors of a block, or of two blocks one after the other."""
    cols, start = (one, 0) if other is None else (other, len(one))
    links, least = np.zeros(len(copies), dtype="i8"), np.arange(len(copies))
    step = max(1, COSINES // max(1, len(cols)))
    for at in range(0, len(one), step):
        skip = at if other is None else 0
        linked = one[at : at + step] @ cols[skip:].T >= threshold
        if other is None:
            linked = np.triu(linked, 1)
        a, b = np.nonzero(linked)
        if len(a):
            a, b = a + at, b + skip + start
            links += np.bincount(a, copies[b], len(links)).astype("i8") + np.bincount(b, copies[a], len(links)).astype("i8")
            least = _united(least, a, b)
    return links, least


def schedule(n: Column, threshold: float) -> tuple[Column, Column]:
    """(key bits, passes) for a label of n classes."""
    bits = F.when(n <= FEW, 0).otherwise(F.least(F.lit(BITS), F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2(n / RUN)).cast("int"))))
    same = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    passes = F.ceil(math.log(MISS) / F.log1p(-F.pow(F.lit(same), bits) * (1 - 1e-12))).cast("int")
    dearer = (bits == 0) | (passes >= F.pow(F.lit(2.0), bits))
    return F.when(dearer, 0).otherwise(bits).cast("int"), F.when(dearer, 1).otherwise(passes).cast("int")


@functools.lru_cache(maxsize=8)
def _planes(seed: int, number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, number, dim]).standard_normal((dim, BITS))


def keyed(classes: DataFrame, number: int, seed: int = 11) -> DataFrame:
    """classes(kind, dim, class_id, copies, vector, bits) with the key of one pass: a sign for each bit, the first hash foremost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, bits = batch.column("dim").to_numpy(), batch.column("bits").to_numpy()
            keys = np.zeros(batch.num_rows, dtype="i8")
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                values = batch.column("vector").take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                signs = _unit(values) @ _planes(seed, number, dim) >= 0
                keys[own] = (signs @ (1 << np.arange(BITS - 1, -1, -1, dtype="i8"))).astype("i8") >> (BITS - bits[own])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "dim", "class_id", "copies", "vector")), pa.array(keys)], names=["kind", "dim", "class_id", "copies", "vector", "key"])

    vector = dict(classes.dtypes)["vector"]
    return classes.select("kind", "dim", "class_id", "copies", "vector", "bits").mapInArrow(run, f"kind string, dim int, class_id long, copies long, vector {vector}, key long")


def links_of_runs(rows: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """(class_id, links, near) of stored rows(*group, dim, class_id, copies, vector), all pairs of a run (group, dim) compared.

    links: vectors of other classes linked to a class in a pair of blocks; near: the least class
    reached there. Only runs of several blocks have their rows copied, once for each block.
    """
    spark = rows.sparkSession
    group = [*group, "dim"]
    blocks = F.ceil(F.count(F.lit(1)) / F.greatest(F.lit(1), F.floor(F.lit(BLOCK_NUMBERS) / F.col("dim")))).cast("int")
    crowded = store.stored(rows.groupBy(group).agg(blocks.alias("blocks")).where("blocks > 1"), "crowded")
    own = rows.join(crowded, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    key = [*group, "i", "j"]
    dealt = own.withColumn("other", other).select(*group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class_id", "copies", "vector")
    dealt = dealt.repartition(store.partitions(spark), *key).sortWithinPartitions(*key, "own", "class_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: tuple, parts: list[tuple]) -> pa.RecordBatch:
            side, ids, copies, unit = (np.concatenate([p[k] for p in parts]) for k in range(4))
            n = int((side == key[-2]).sum())
            both = key[-2] != key[-1]
            count, least = _compared(unit[:n] if both else unit, unit[n:] if both else None, copies, threshold)
            smallest = np.full(len(ids), np.iinfo("i8").max)
            np.minimum.at(smallest, least, ids)
            hit = np.flatnonzero(count)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[hit], count[hit], smallest[least[hit]])], names=["class_id", "links", "near"])

        now, parts = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if keys[lo] != now and parts:
                    if len(parts) > 1 or len(parts[0][0]) > 1:
                        yield links(now, parts)
                    parts = []
                now, cut = keys[lo], batch.slice(lo, hi - lo)
                values = cut.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, -1)
                parts.append((cut.column("own").to_numpy(), cut.column("class_id").to_numpy(), cut.column("copies").to_numpy(), _unit(values)))
        if parts:
            yield links(now, parts)

    return dealt.mapInArrow(run, "class_id long, links long, near long")


def linked_components(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, component) of the classes(kind, dim, class_id, copies, vector) that link, from all passes."""
    group = ["kind", "dim"]
    bits, passes = schedule(F.col("n"), threshold)
    sizes = classes.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    planned = store.stored(sizes.select(*group, bits.alias("bits"), passes.alias("passes")), "schedule")
    edges = None
    for number in range(planned.agg(F.max("passes")).first()[0] or 0):
        rows = store.stored(keyed(classes.join(planned.where(F.col("passes") > number), group), number), "pass")
        found = store.stored(links_of_runs(rows, ["kind", "key"], threshold).select(F.col("class_id").alias("a"), F.col("near").alias("b")).where("a <> b").distinct(), "verified")
        store.forget(rows)
        edges = found if edges is None else edges.unionByName(found)
    if edges is None:
        edges = classes.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")).limit(0)
    return store.stored(connected_components(edges), "components")


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per vector."""
    spark = df.sparkSession
    store.small_batches(spark)
    same = ["kind", "h1", "h2"]  # a class: its label and 128 bits of its vector
    kept = "array<float>" if dict(df.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("kind"), F.col(vector_col).cast(kept).alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("kind").isNotNull() & finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("usable", usable).withColumn("h1", F.xxhash64("vector", F.lit(1))).withColumn("h2", F.xxhash64(F.lit(2), "vector"))
    narrow = store.stored(rows.select("vec_id", "usable", *same).distinct(), "vectors")
    good = narrow.where("usable")
    counted = good.groupBy(same).agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    vectors = rows.where("usable").groupBy(same).agg(F.first("vector").alias("vector"))
    classes = store.stored(counted.join(vectors, same).withColumn("dim", F.size("vector")), "classes")
    components = linked_components(classes.select("kind", "dim", "class_id", "copies", "vector"), threshold)
    members = store.stored(classes.select("dim", "class_id", "copies", "vector").join(components, F.col("class_id") == F.col("id")).drop("id"), "members")
    links = links_of_runs(members, ["component"], threshold).groupBy("class_id").agg(F.sum("links").alias("links"))
    of_class = classes.select(*same, "class_id", "copies").join(links, "class_id", "left").join(components, F.col("class_id") == F.col("id"), "left")
    of_class = of_class.select(*same, (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "class_id").alias("component_id"))
    linked = good.join(of_class, same).select("vec_id", "n_links", "component_id")
    alone = narrow.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
