"""MinHash near-duplicate detection (operator 7).

Universal hash minima of a document's word shingles are cut into bands. Documents with one
shingle set form a class; classes that share a band meet in a bucket, where the signatures are
verified and a spanning forest of the likely links is kept, never all pairs. The forests'
components hold every possible link; inside each, the full shingle sets settle the links, in
blocks of bounded size, and a pair is skipped only when both are already connected. Components
come from alternating large-star and small-star.

A pair at similarity 0.8 misses all bands with probability (1 - 0.8^4)^24 = 3e-6, and is more
than 4 standard deviations above the signature threshold.

Defined results. Words are split at blanks and controls 9 to 13 after A-Z is lower-cased; a
document with fewer words than a shingle has its whole sequence as one; a null, empty or blank
text has no shingle and links with nothing; a text of any length is shingled whole; repeated
rows are copies of each other and come back once per row; an empty table gives no row; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.components import connected_components

BANDS, ROWS = 24, 4
#: Classes in a block of a bucket, and of a group of likely links, whose block also holds so many shingles on average (8 bytes each).
BUCKET_BLOCK, GROUP_BLOCK, BLOCK_SHINGLES = 2048, 384, 4_000_000
#: Ids that may be broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 400_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of word shingles; word hashes are cached within a bound."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.words: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.translate(_LOWER)) if text else []
        if not words:
            return np.zeros(0, dtype="u8")
        known = self.words
        if len(known) > 500_000:
            known.clear()
        for w in {*words}.difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), dtype="u8", count=len(words))
        k = min(self.width, len(h))
        out = np.full(len(h) - k + 1, k, dtype="u8")
        for i in range(k):
            out = _mixed(out * _MIX + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_607)
    a = rng.integers(1, 1 << 63, size=n, dtype="u8") * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, size=n, dtype="u8")


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minima of the universal hashes (a*x + b, high 32 bits)."""
    out = np.full(len(a), 0xFFFFFFFF, dtype="u8")
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        for i in range(0, len(a), 8):
            h = (part[None, :] * a[i : i + 8, None] + b[i : i + 8, None]) >> np.uint64(32)
            np.minimum(out[i : i + 8], h.min(axis=1), out=out[i : i + 8])
    return out.astype("u4")


def sketched(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, d1 and d2 (digest of the set), bands, sig for every row."""
    a, b = _functions(BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        salt = np.arange(BANDS, dtype="u8") * _MIX
        for batch in batches:
            n, d1, d2, bands, sigs = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle(text)
                raw = s.tobytes()
                sig = signature(s, a, b)
                key = salt
                for r in range(ROWS):
                    key = _mixed(key * _MIX + sig[r::ROWS])
                n.append(len(s))
                digest = xxhash.xxh128_digest(raw)
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                bands.append(key.astype("i8"))
                sigs.append((sig & 0xFF).astype("u1").tobytes())
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, "i8"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype="i4")), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists, pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "bands", "sig"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, bands array<long>, sig binary")


def _forest(sig: np.ndarray, least: int, side: np.ndarray | None) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph of signatures that agree in least places or more.

    With sides, only edges across them count.
    """
    n = len(sig)
    free = np.ones(n, dtype=bool)
    for start in range(n):
        if not free[start]:
            continue
        free[start] = False
        front = [start]
        while front:
            x = front.pop()
            left = np.flatnonzero(free if side is None else free & (side != side[x]))
            if not len(left):
                continue
            near = left[(sig[left] == sig[x]).sum(axis=1) >= least]
            free[near] = False
            for y in near.tolist():
                yield x, y
            front.extend(near.tolist())


def _grouped(batches: Iterator[pa.RecordBatch], keys: int, names: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of batches sorted by their first columns; a group's size is bounded upstream."""
    now, rows = None, []
    for batch in batches:
        for values in zip(*(batch.column(c).to_pylist() for c in names)):
            if values[:keys] != now and rows:
                yield now, rows
                rows = []
            now = values[:keys]
            rows.append(values[keys:])
    if rows:
        yield now, rows


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _in_blocks(rows: DataFrame, group: str, size: str, block: int, member: str, keep: list[str]) -> DataFrame:
    """Every row once for each pair of blocks that its block is in, dealt and sorted by that pair."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64(member), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    out = own.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", member, *keep)
    return out.repartition(store.partitions(rows.sparkSession), group, "i", "j").sortWithinPartitions(group, "i", "j", member)


def likely_links(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): forests of the pairs that share a band and whose signatures agree well enough."""
    hashes = BANDS * ROWS
    p = similarity + (1 - similarity) / 256
    least = int(np.floor(hashes * p - 4.5 * np.sqrt(hashes * p * (1 - p))))
    keyed = classes.select("rep", F.explode("bands").alias("bucket"))
    full = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    meet = store.stored(keyed.join(full, "bucket"), "buckets")
    rows = _in_blocks(meet.join(classes.select("rep", "sig"), "rep"), "bucket", "members", BUCKET_BLOCK, "rep", ["sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[tuple[int, int], None] = {}
        for (_, i, j), members in _grouped(batches, 3, ["bucket", "i", "j", "own", "rep", "sig"]):
            if len(members) < 2:
                continue
            sig = np.frombuffer(b"".join(m[2] for m in members), dtype="u1").reshape(len(members), -1)
            side = None if i == j else np.array([m[0] for m in members])
            for x, y in _forest(sig, least, side):
                a, b = members[x][1], members[y][1]
                out[max(a, b), min(a, b)] = None
            if len(out) > 20_000:
                yield _edges(list(out))
                out = {}
        if out:
            yield _edges(list(out))

    return rows.mapInArrow(run, "a long, b long").distinct()


def verified_links(groups: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(a, b): enough true links to connect whatever the links of (grp, size, rep, sig, shingles) connect."""
    hashes = BANDS * ROWS
    p = numerator / denominator
    p += (1 - p) / 256
    least = int(np.floor(hashes * p - 4.5 * np.sqrt(hashes * p * (1 - p))))
    rows = _in_blocks(groups, "grp", "size", GROUP_BLOCK, "rep", ["sig", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), members in _grouped(batches, 3, ["grp", "i", "j", "own", "rep", "sig", "shingles"]):
            n = len(members)
            sets: dict[int, np.ndarray] = {}
            sizes = np.array([len(m[3]) // 8 for m in members])
            sig = np.frombuffer(b"".join(m[2] for m in members), dtype="u1").reshape(n, -1)
            side = np.array([m[0] for m in members])
            root = np.arange(n)
            found: list[tuple[int, int]] = []
            tries: list[np.ndarray] = []
            for x in range(n - 1):
                agree = (sig[x + 1 :] == sig[x]).sum(axis=1)
                y = np.flatnonzero((agree >= least) & (denominator * np.minimum(sizes[x + 1 :], sizes[x]) >= numerator * np.maximum(sizes[x + 1 :], sizes[x])) & ((i == j) | (side[x + 1 :] != side[x])))
                if len(y):
                    tries.append(np.column_stack((-agree[y], np.full(len(y), x), y + x + 1)))
            order = np.concatenate(tries) if tries else np.zeros((0, 3), dtype=int)
            for _, x, y in order[np.argsort(order[:, 0], kind="stable")].tolist():
                if root[x] == root[y]:
                    continue
                for z in (x, y):
                    if z not in sets:
                        sets[z] = np.frombuffer(members[z][3], dtype="u8")
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if denominator * both >= numerator * int(sizes[x] + sizes[y] - both):
                    a, b = members[x][1], members[y][1]
                    found.append((max(a, b), min(a, b)))
                    root[root == root[y]] = root[x]
            if found:
                yield _edges(found)

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, kept; one row per row of docs.

    Documents link with denominator * intersection >= numerator * union of their shingle sets.
    """
    spark = docs.sparkSession
    store.small_batches(spark, 256)
    rows = store.stored(sketched(docs, id_col, text_col, width), "sketches")
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    classes = store.stored(filled.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    likely = store.stored(likely_links(classes, numerator / denominator), "likely")
    groups = store.stored(connected_components(likely), "groups").withColumnRenamed("component", "grp")
    grouped = classes.select("rep", "d1", "d2", "sig", "n_shingles").join(groups, F.col("rep") == F.col("id"))
    # a group of long texts is cut into more blocks, so that a block's sets stay small
    weight = F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n_shingles") * F.lit(GROUP_BLOCK) / F.lit(BLOCK_SHINGLES)))
    wanted = store.stored(grouped.join(grouped.groupBy("grp").agg(weight.alias("size")), "grp").select("rep", "d1", "d2", "sig", "grp", "size"), "wanted")
    texts = shingle_sets(docs, wanted, id_col, text_col, width)
    links = store.stored(verified_links(wanted.join(texts, ["rep", "d1", "d2"]), numerator, denominator), "links")
    components = store.stored(connected_components(links), "components")
    of_class = classes.join(components, F.col("rep") == F.col("id"), "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    linked = filled.select("doc_id", "text_hash", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id", "text_hash")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(rep, d1, d2, shingles) of the wanted representatives, made again from their texts."""
    ids = wanted.select("rep")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sets = [shingle(t).tobytes() for t in batch.column("text").to_pylist()]
            digests = [xxhash.xxh128_digest(s) for s in sets]
            half = [[int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests] for k in (0, 8)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(half[0], pa.int64()), pa.array(half[1], pa.int64()), pa.array(sets, pa.binary())], names=["rep", "d1", "d2", "shingles"])

    return rows.mapInArrow(run, "rep long, d1 long, d2 long, shingles binary").dropDuplicates(["rep", "d1", "d2"])


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
