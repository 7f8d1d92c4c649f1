"""Removal of long repeated byte strings by sampled suffix naming (operator 2).

The difference-cover scheme sorts sampled suffixes, names them by rank, recurses on the names
and merges the other suffixes through the sample. Suffixes matter here only up to a length L,
so a rank is needed only to tell equal prefixes from different ones, and a name is a 128-bit
hash. The sample is a content-defined difference cover (a synchronising set): a window of L
bytes samples the place of its least PIECE-byte hash, so two equal windows always sample the
same offset, which is what the difference cover is for, at one place in about 150 bytes.

1. Sample: runs of windows with one sampled place; the name of a run is its place's piece.
   Runs whose name is met nowhere else hold no repeated window and go.
2. Recurse on names: the whole name of a run covers all bytes of its windows. A run whose
   whole name is met again is repeated throughout. Where one piece has several whole names, a
   representative of each is cut into parts of PART windows at fixed distances from its place;
   a part's name is what all its windows share, and its whole name what they cover, and the
   same step is taken again.
3. Merge: the windows of parts that are still undecided are named one by one and compared with
   their neighbours of equal name.

A span is local as long as only its own row is known to hold its windows; local spans are settled
with the others, so a text is marked as shared where another row holds one of its windows.

Counts are pre-aggregated before any shuffle, so a passage in a third of all rows is one row per
task; joins go by name and can be split.

Defined results. A text is its UTF-8 bytes; a null text counts as empty; repeated rows are
copies of each other; a text shorter than L keeps all; an empty table gives no row; other
columns are left out, whatever their names. A text of any length is taken in pieces of CHUNK
windows, whose cuts split runs and nothing else: a split run is settled by parts and windows.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.minhash import _mixed

LENGTH = 400
#: Bytes of the sampled piece.
PIECE = 100
#: Windows in a part of a run.
PART = 16
#: Keys of texts that may be broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_KEYS = 400_000
#: Bytes that are hashed at a time, at about 90 bytes of memory each; a longer text is cut into overlapping pieces.
CHUNK = 1 << 20
#: Bits of a place in a chunk: the same in chunks of all sizes, so equal windows settle ties alike.
PLACE_BITS = 22
_BASES = (np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD6E8FEB86659FD93 | 1))


@functools.lru_cache(maxsize=2)
def _tables(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes; powers of the base and of its inverse, for a chunk."""
    values = np.random.default_rng(97 + k).integers(0, 1 << 63, size=256, dtype="u8") * np.uint64(2) + np.uint64(1)
    inverse = np.uint64(pow(int(_BASES[k]), -1, 1 << 64))
    return values, _powers(_BASES[k], CHUNK + 1), _powers(inverse, CHUNK + 1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype="u8")
    out[0] = 1
    return np.multiply.accumulate(out)


class Hashed:
    """64-bit hashes of any substring of a byte array in constant time, for two bases."""

    def __init__(self, data: np.ndarray, bases: int = 2) -> None:
        self.sums, self.inverse = [], []
        for k in range(bases):
            values, power, inverse = _tables(k)
            if len(data) >= len(power):
                base = _BASES[k]
                power, inverse = _powers(base, len(data) + 1), _powers(np.uint64(pow(int(base), -1, 1 << 64)), len(data) + 1)
            total = np.zeros(len(data) + 1, dtype="u8")
            np.cumsum(values[data] * power[: len(data)], out=total[1:])
            self.sums.append(total)
            self.inverse.append(inverse)

    def of(self, start: np.ndarray, stop: np.ndarray, k: int = 0) -> np.ndarray:
        return _mixed((self.sums[k][stop] - self.sums[k][start]) * self.inverse[k][start])


def sampled_runs(data: np.ndarray, hashed: Hashed, ends: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, sampled place) of each run, texts lying one after another.

    ends[i] is the end of the text that byte i belongs to.
    """
    n = len(data)
    if n < length:
        return (np.zeros(0, dtype="i8"),) * 3
    places = np.arange(n - piece + 1)
    bits = np.uint64(PLACE_BITS)
    order = ((hashed.of(places, places + piece) >> bits) << bits) | places.astype("u8")
    order[places + piece > ends[: len(places)]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    width, least, have = length - piece + 1, order, 1  # least place of each window by doubling
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(order) - width + 1], least[width - have : width - have + len(order) - width + 1])
    windows = np.flatnonzero(np.arange(n - length + 1) + length <= ends[: n - length + 1])
    if not len(windows):
        return (np.zeros(0, dtype="i8"),) * 3
    place = (least[windows] & ((np.uint64(1) << bits) - np.uint64(1))).astype("i8")
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(windows) != 1))
    return windows[np.concatenate(([0], cut + 1))], windows[np.concatenate((cut, [len(windows) - 1]))], place[np.concatenate(([0], cut + 1))]


def _chunks(texts: list[bytes], length: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, bytes one after another, start of each, end of each byte's text, place of each in its text).

    A long text comes in pieces that share length - 1 bytes, so each window lies in one of them.
    """
    own: list[int] = []
    size = 0
    for i, t in enumerate([*texts, None]):
        if own and (t is None or size + len(t) > CHUNK):
            lengths = np.array([len(texts[k]) for k in own])
            stop = np.cumsum(lengths)
            yield own, np.frombuffer(b"".join(texts[k] for k in own), dtype="u1"), stop - lengths, np.repeat(stop, lengths), np.zeros(len(own), dtype="i8")
            own, size = [], 0
        if t is None:
            break
        if len(t) <= CHUNK:
            own.append(i)
            size += len(t)
            continue
        for at in range(0, max(1, len(t) - length + 1), CHUNK):
            piece = np.frombuffer(t, dtype="u1", count=min(CHUNK + length - 1, len(t) - at), offset=at)
            yield [i], piece, np.zeros(1, dtype="i8"), np.full(len(piece), len(piece)), np.array([at])


def _pieces(text: str, spans: list[dict], length: int) -> Iterator[tuple[int, "Hashed", list[dict]]]:
    """(place in the text, hashes from there on, the spans that begin there), in pieces of bounded size."""
    data = np.frombuffer(text.encode(), dtype="u1")
    spans = sorted(spans, key=lambda s: s["lo"])
    at = 0
    while at < len(spans):
        first, stop = spans[at]["lo"], at
        while stop < len(spans) and spans[stop]["lo"] < first + CHUNK:
            stop += 1
        own = spans[at:stop]
        low = min(min(s["lo"], s["place"]) for s in own)
        yield low, Hashed(data[low : max(s["hi"] for s in own) + 2 * length]), own
        at = stop


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype("u8").view("i8"))


def _numbered(docs: DataFrame) -> DataFrame:
    """A number that tells the rows of one table apart, those of one id and text too; it holds once it is written."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def runs(docs: DataFrame, length: int, piece: int) -> DataFrame:
    """doc, text_hash, row, lo, hi (first and last window), place, name, w1, w2 (the whole run), of (doc, text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("text").to_pylist()]
            for own, data, start, ends, before in _chunks(texts, length):
                hashed = Hashed(data)
                lo, hi, place = sampled_runs(data, hashed, ends, length, piece)
                if not len(lo):
                    continue
                text = np.searchsorted(start, lo, side="right") - 1
                number = pa.array(np.array(own)[text])
                shift = start[text] - before[text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(number), batch.column("text_hash").take(number), batch.column("row").take(number), pa.array((lo - shift).astype("i4")), pa.array((hi - shift).astype("i4")), pa.array((place - shift).astype("i4")), _signed(hashed.of(place, place + piece)), _signed(hashed.of(lo, hi + length)), _signed(hashed.of(lo, hi + length, 1))],
                    names=["doc", "text_hash", "row", "lo", "hi", "place", "name", "w1", "w2"],
                )

    return _numbered(docs).mapInArrow(run, "doc long, text_hash long, row long, lo int, hi int, place int, name long, w1 long, w2 long")


def parts(docs: DataFrame, length: int) -> DataFrame:
    """The runs in spans (lo, hi, place, alone, local) of (doc, text_hash, text, spans), cut into parts; as runs(), with alone and local."""

    step = min(PART, max(1, length // 4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, all_spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                for low, hashed, spans in _pieces(text, all_spans, length):
                    sizes = [s["hi"] + 1 - s["lo"] for s in spans]
                    at = np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans])
                    own = np.repeat(np.arange(len(spans)), sizes)
                    place = np.repeat([s["place"] for s in spans], sizes)
                    part = (place - at) // step
                    cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(own) != 0))
                    first, last = np.concatenate(([0], cut + 1)), np.concatenate((cut, [len(at) - 1]))
                    lo, hi, place = at[first], at[last], place[first]
                    core = place - step * part[first]
                    same = pa.array(np.full(len(lo), i))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc").take(same), batch.column("text_hash").take(same), batch.column("row").take(same), pa.array(lo.astype("i4")), pa.array(hi.astype("i4")), pa.array(place.astype("i4")), _signed(hashed.of(core - low, core - low + length - step + 1)), _signed(hashed.of(lo - low, hi - low + length)), _signed(hashed.of(lo - low, hi - low + length, 1)), *(pa.array(np.array([s[k] for s in spans])[own[first]]) for k in ("alone", "local"))],
                        names=["doc", "text_hash", "row", "lo", "hi", "place", "name", "w1", "w2", "alone", "local"],
                    )

    return _numbered(docs).mapInArrow(run, "doc long, text_hash long, row long, lo int, hi int, place int, name long, w1 long, w2 long, alone boolean, local boolean")


def window_names(docs: DataFrame, length: int) -> DataFrame:
    """doc, text_hash, row, at, n1, n2, alone, local of (doc, text_hash, text, spans): each window of the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (text, all_spans) in enumerate(zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())):
                for low, hashed, spans in _pieces(text, all_spans, length):
                    at = np.concatenate([np.arange(s["lo"], s["hi"] + 1) for s in spans])
                    flags = [pa.array(np.concatenate([np.full(s["hi"] + 1 - s["lo"], s[k]) for s in spans]).astype(bool)) for k in ("alone", "local")]
                    same = pa.array(np.full(len(at), i))
                    yield pa.RecordBatch.from_arrays([batch.column("doc").take(same), batch.column("text_hash").take(same), batch.column("row").take(same), pa.array(at.astype("i4")), _signed(hashed.of(at - low, at - low + length)), _signed(hashed.of(at - low, at - low + length, 1)), *flags], names=["doc", "text_hash", "row", "at", "n1", "n2", "alone", "local"])

    return _numbered(docs).mapInArrow(run, "doc long, text_hash long, row long, at int, n1 long, n2 long, alone boolean, local boolean")


def _counted(keys: DataFrame, label: str) -> DataFrame:
    """Distinct keys of a count, written: a join with an aggregate in its own stage can't be split at a hot key, one with a table can."""
    return store.stored(keys, label).hint("merge")


def _shared() -> Column:
    """Of rows with equal bytes: two rows hold them, or one of them is known to be in two."""
    return (F.min("row") != F.max("row")) | ~F.bool_and("local")


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans that are repeated throughout, representatives of the undecided) of named spans.

    rows(doc, text_hash, row, lo, hi, place, name, w1, w2, alone, local); alone: not known to be
    repeated; local: not known to be in another row. A local kind lies in its representative's row.
    """
    names = _counted(rows.groupBy("name").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("name"), "names")
    known = store.stored(rows.join(names, "name", "left_semi"), "known")
    whole = known.groupBy("name", "w1", "w2").agg(F.count(F.lit(1)).alias("met"), F.min(F.struct("doc", "text_hash", "lo", "hi", "place", "alone")).alias("one"), _shared().alias("shared"), F.min("row").alias("row"))
    whole = store.stored(whole, "whole")
    full = known.join(whole.where("met > 1").select("name", "w1", "w2", "shared"), ["name", "w1", "w2"]).select("doc", "text_hash", "lo", "hi", "shared")
    left = F.count_if((F.col("met") == 1) & F.col("one.alone"))
    local = F.count_if(~F.col("shared"))
    apart = (F.min("row") != F.max("row")) | F.bool_or("shared")
    mixed = _counted(whole.groupBy("name").agg(F.count(F.lit(1)).alias("kinds"), left.alias("left"), local.alias("local"), apart.alias("apart")).where("kinds > 1 and (left > 0 or local > 0 and apart)").select("name"), "mixed")
    ones = whole.join(mixed, "name", "left_semi").select("one.doc", "one.text_hash", "one.lo", "one.hi", "one.place", ((F.col("met") == 1) & F.col("one.alone")).alias("alone"), (~F.col("shared")).alias("local"))
    return full, ones


def _of_text(ones: DataFrame) -> DataFrame:
    """(span_doc, span_hash, spans): the spans of a text together."""
    return ones.groupBy(F.col("doc").alias("span_doc"), F.col("text_hash").alias("span_hash")).agg(F.collect_list(F.struct("lo", "hi", "place", "alone", "local")).alias("spans"))


def _same_text() -> Column:
    return F.col("doc").eqNullSafe(F.col("span_doc")) & (F.col("text_hash") == F.col("span_hash"))


def _few(keys: DataFrame) -> bool:
    return keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS


def repeated_spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """doc, text_hash, spans: windows lo..hi that are repeated, shared: another row has one; only texts that have some."""
    found = store.stored(runs(docs, length, piece), "runs")
    full, ones = _settled(found.withColumns({"alone": F.lit(True), "local": F.lit(True)}))
    spans = store.stored(_of_text(ones), "undecided")
    store.forget(found)
    keys = spans.select("span_doc", "span_hash")
    held = store.stored(docs.join(F.broadcast(keys) if _few(keys) else keys, _same_text(), "left_semi"), "texts")
    more, ones = _settled(store.stored(parts(held.join(spans, _same_text()), length), "parts"))
    named = store.stored(window_names(held.join(store.stored(_of_text(ones), "undecided"), _same_text()), length), "windows")
    twice = _counted(named.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("met"), _shared().alias("shared")).where("met > 1").select("n1", "n2", "shared"), "twice")
    single = named.where("alone or local").join(twice, ["n1", "n2"]).where("alone or shared").select("doc", "text_hash", F.col("at").alias("lo"), F.col("at").alias("hi"), "shared")
    return full.unionByName(more).unionByName(single).groupBy("doc", "text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"), F.bool_or("shared").alias("shared"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, removed (array of byte ranges), kept (the remaining bytes), shared (another row has some removed window); one row per row."""
    spark = docs.sparkSession
    store.small_batches(spark, 256)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    spans = store.stored(repeated_spans(rows, length, piece), "repeats").select(F.col("doc").alias("span_doc"), F.col("text_hash").alias("span_hash"), "spans", "shared")
    keys = spans.select("span_doc", "span_hash")
    keys = F.broadcast(keys) if _few(keys) else keys
    cut = rows.join(keys, _same_text(), "left_semi").join(spans, _same_text())
    whole = rows.join(keys, _same_text(), "left_anti")
    untouched = whole.select(F.col("doc").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<array<bigint>>").alias("removed"), F.encode("text", "UTF-8").alias("kept"), F.lit(False).alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_n, out_spans, out_kept = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode()
                removed: list[list[int]] = []
                for lo, hi in sorted((s["lo"], s["hi"] + length) for s in spans or []):
                    if removed and lo <= removed[-1][1]:
                        removed[-1][1] = max(removed[-1][1], hi)
                    else:
                        removed.append([lo, hi])
                at, kept = 0, []
                for lo, hi in removed:
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:])
                out_n.append(len(data))
                out_spans.append(removed)
                out_kept.append(b"".join(kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out_n, pa.int64()), pa.array(out_spans, pa.list_(pa.list_(pa.int64()))), pa.array(out_kept, pa.binary()), batch.column("shared")], names=["doc_id", "n_bytes", "removed", "kept", "shared"])

    return cut.select("doc", "text", "spans", "shared").mapInArrow(run, "doc_id long, n_bytes long, removed array<array<long>>, kept binary, shared boolean").unionByName(untouched)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, r: acc + r[1] - r[0])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "shared")
