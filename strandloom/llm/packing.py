"""Sequence packing by non-negative least squares (operator 5).

Full windows of a document are sequences of their own. The histogram of the remainders (at most
window - 1 bins) goes to the driver, which enumerates shallow combinations of lengths that fill
a window exactly, solves their repeat counts against the histogram by non-negative least
squares, rounds them down, and fills up greedily. The n-th remainder of a length takes the n-th
slot of that length. What is left is packed greedily in row order, cut at window borders, so
only the last sequence has padding. Ranks and running sums are by scan partition with offsets
between partitions: no group grows with a hot length.

Defined results. A null text counts as empty and has just the end id; a text of any length
fills as many windows as it needs; repeated rows are packed
as documents of their own; an empty table gives no row; other columns are left out, whatever
their names. The ids of a piece can be read from the stored tokens by row, start and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.tokens import encoded

WINDOW = 2048
#: The solver stops when no round moves the solution by more than this share of it, or after ROUNDS; what it leaves is packed greedily.
SETTLED, ROUNDS = 1e-4, 200


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored: row, part (its scan partition), doc_id, n, crcs (of each window, the last may be short), ids."""
    store.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encoded(batches, tokenizer, end_id):
            crcs = [[zlib.crc32(x[i : i + 4 * window]) for i in range(0, len(x), 4 * window)] for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.binary())], names=["doc_id", "n", "crcs", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n long, crcs array<long>, ids binary")
    out = out.withColumn("row", F.monotonically_increasing_id())
    return store.stored(out.withColumn("part", F.shiftright("row", 33)), "tokens")


@dataclass(frozen=True)
class Plan:
    """Slots: of a length, ranks lo..hi-1 go to sequences first, first+1, ... at the offset."""

    length: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence or -1, offset)."""
        if not len(self.length):
            return np.full(len(lengths), -1, dtype="i8"), np.zeros(len(lengths), dtype="i8")
        base = max(int(self.hi.max()), int(ranks.max(initial=0))) + 1
        at = np.searchsorted(self.length * base + self.lo, lengths * base + ranks, side="right") - 1
        safe = np.maximum(at, 0)
        ok = (at >= 0) & (self.length[safe] == lengths) & (self.lo[safe] <= ranks) & (ranks < self.hi[safe])
        return np.where(ok, self.first[safe] + ranks - self.lo[safe], -1), np.where(ok, self.offset[safe], 0)


def combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """All rows (a, b, c), a >= b >= c, of present lengths that sum to the window, c 0 if unused; counts: by length, from 0.

    At most (window - 1)^2 / 12 rows, whatever the number of documents.
    """
    present = np.flatnonzero(counts)
    high = present[(present * 2 >= window) & (counts[np.maximum(window - present, 0)] > 0) & (present < window)]
    out = [np.column_stack((high, window - high, np.zeros_like(high)))]
    for b in present.tolist():
        c = present[(present <= b) & (window - b - present >= b)]
        a = window - b - c
        there = counts[a] > 0
        out.append(np.column_stack((a[there], np.full(int(there.sum()), b), c[there])))
    return np.concatenate(out)


def non_negative_least_squares(items: np.ndarray, target: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 that make the items' counts close to the target, by accelerated projection.

    items: rows of lengths, 0 for none; a row's column of the matrix has a 1 for each item.
    """
    n = len(items)
    if not n:
        return np.zeros(0)

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(items[:, k], x, len(target)) for k in range(items.shape[1]))
        out[0] = 0
        return out

    def back(r: np.ndarray) -> np.ndarray:
        r = r.copy()
        r[0] = 0
        return sum(r[items[:, k]] for k in range(items.shape[1]))

    v = np.ones(n)
    for _ in range(20):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0, y - back(forward(y) - target) / (1.05 * norm))
        moved, size = np.abs(nxt - x).sum(), nxt.sum()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
        if moved <= SETTLED * size:
            break
    return x


def solve(histogram: dict[int, int], window: int = WINDOW) -> Plan:
    """The slots for a histogram of remainders; counts beyond the slots are left to greedy packing."""
    counts = np.zeros(window + 1, dtype="i8")
    for length, n in histogram.items():
        counts[length] = n
    items = combinations(counts, window)
    solved = np.floor(non_negative_least_squares(items, counts.astype(float)) + 1e-9).astype("i8")
    left, rows, wanted = counts.tolist(), items.tolist(), solved.tolist()
    left[0] = 1 << 62  # stands for no item
    repeats = np.zeros(len(items), dtype="i8")
    for most in (lambda k: wanted[k], lambda k: 1 << 62):  # the solution as far as it fits, then whatever still fits
        for k in np.argsort(-solved, kind="stable").tolist():
            n = min(most(k), *(left[x] // (rows[k].count(x) if x else 1) for x in rows[k]))
            if n > 0:
                for x in rows[k]:
                    left[x] -= n if x else 0
                repeats[k] += n
    slots, next_rank, sequence = [], np.zeros(window + 1, dtype="i8"), 0
    for k in np.flatnonzero(repeats).tolist():
        at = 0
        for length in items[k][items[k] > 0].tolist():
            slots.append((length, next_rank[length], next_rank[length] + repeats[k], sequence, at))
            next_rank[length] += repeats[k]
            at += length
        sequence += int(repeats[k])
    table = np.array(sorted(slots), dtype="i8").reshape(-1, 5)
    return Plan(*table.T, sequence)


def _offsets(spark: SparkSession, sums: list, kind: str) -> DataFrame:
    """(part, before): running totals over the scan partitions, one row each."""
    rows, before = [], 0
    for r in sorted(sums, key=lambda r: r["part"]):
        rows.append((r["part"], before))
        before += r["total"]
    return spark.createDataFrame(rows, f"part long, {kind} long")


def pack(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row; one row per piece."""
    spark = tokens.sparkSession
    rows = tokens.select("row", "part", "doc_id", "n", "crcs", (F.col("n") % window).cast("int").alias("rest"), F.floor(F.col("n") / window).alias("full"))
    tails = rows.where("rest > 0")
    by_part = tails.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("rows"))
    by_part = store.stored(by_part.withColumn("base", F.sum("rows").over(Window.partitionBy("rest").orderBy("part")) - F.col("rows")), "lengths")
    plan = solve({r["rest"]: r["rows"] for r in by_part.groupBy("rest").agg(F.sum("rows").alias("rows")).collect()}, window)
    nth = F.row_number().over(Window.partitionBy("part", "rest").orderBy("row")) - 1
    ranked = tails.select("row", "part", "rest").withColumn("nth", nth).join(by_part.select("part", "rest", "base"), ["part", "rest"]).select("row", "part", "rest", (F.col("base") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, at = plan.place(batch.column("rest").to_numpy().astype("i8"), batch.column("rank").to_numpy().astype("i8"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("part"), batch.column("rest"), pa.array(seq), pa.array(at)], names=["row", "part", "rest", "sequence_id", "offset"])

    placed = store.stored(ranked.mapInArrow(run, "row long, part long, rest int, sequence_id long, offset long"), "placed")
    left = placed.where("sequence_id < 0").select("row", "part", "rest")
    left_sums = left.groupBy("part").agg(F.sum("rest").alias("total")).collect()
    left_tokens = sum(r["total"] for r in left_sums)
    full_first = plan.sequences + -(-left_tokens // window)

    base = rows.select("row", "part", "doc_id", F.col("n").alias("doc_tokens"), "crcs", "full", "rest")
    in_slots = placed.where("sequence_id >= 0").select("row", "sequence_id", "offset")
    slotted = base.join(in_slots, "row").select("doc_id", (F.col("full") * window).alias("start"), F.col("rest").cast("long").alias("length"), F.element_at("crcs", -1).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "row")

    long_docs = rows.where("full > 0").select("row", "part", "doc_id", "n", "crcs", "full")
    full_sums = long_docs.groupBy("part").agg(F.sum("full").alias("total")).collect()
    by_row = Window.partitionBy("part").orderBy("row")
    numbered = long_docs.withColumn("before", F.sum("full").over(by_row) - F.col("full")).join(F.broadcast(_offsets(spark, full_sums, "earlier")), "part")
    first = F.col("before") + F.col("earlier") + full_first
    windows = numbered.select("doc_id", "n", "row", first.alias("first"), F.posexplode(F.slice("crcs", 1, F.col("full").cast("int"))).alias("k", "crc"))
    whole = windows.select("doc_id", (F.col("k").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "row")

    queue = left.withColumn("before", F.sum("rest").over(by_row) - F.col("rest")).join(F.broadcast(_offsets(spark, left_sums, "earlier")), "part").select("row", (F.col("before") + F.col("earlier")).alias("at"))
    few = left.count() <= 400_000
    cut_rows = tokens.select("row", "doc_id", "n", "ids").join(F.broadcast(queue) if few else queue, "row")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out = []
            for row, doc, n, ids, at in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "n", "ids", "at"))):
                start = n - n % window
                while start < n:
                    size = min(n - start, window - at % window)
                    out.append((doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, plan.sequences + at // window, at % window, row))
                    start, at = start + size, at + size
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(len(names))], names=names)

    return slotted.unionByName(whole).unionByName(cut_rows.mapInArrow(cut, schema))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokens = tokenized(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 1)
    return pack(tokens).drop("row")
