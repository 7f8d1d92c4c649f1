"""Token-id output as seekable zstandard files (operator 3).

A shard is a run of independent zstandard frames, each holding the little-endian unsigned
32-bit ids of whole documents, then a skippable frame with the document index, then the
seek table of the public zstd seekable format: a skippable frame of (compressed size,
decompressed size, low 32 bits of XXH64 of the content) per frame and a footer. A reader
fetches the tail of the file, then only the frames of the documents that it wants.

Defined results. Documents come in ascending doc_id order, null ids first, ties by text; a
null text counts as empty and has just the end id; a text of any length is one run of ids in
one frame; repeated rows are kept as rows; an empty
table gives no shard and no row; other columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.tokens import encoded

SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: Ids after which a frame is closed.
FRAME_IDS = 1 << 16
LEVEL = 3


def filesystem(uri: str):
    """(pyarrow file system, path) of a local, HDFS or object-store URI."""
    from pyarrow import fs

    if (m := re.match(r"(?:file:/{1,3}|/)(?=[^/])", uri)) is not None:
        return fs.LocalFileSystem(), "/" + uri[m.end():]
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends documents to a file that appears under its name only when it is whole."""

    def __init__(self, uri: str, attempt: str) -> None:
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{attempt}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.waiting: list[bytes] = []
        self.waiting_ids = 0
        self.seek: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.frames: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.frames.append(len(self.seek))
        self.waiting.append(ids)
        self.waiting_ids += len(ids) // 4
        if self.waiting_ids >= FRAME_IDS:
            self._flush()

    def _flush(self) -> None:
        if self.waiting:
            raw = b"".join(self.waiting)
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.waiting, self.waiting_ids = [], 0

    def close(self) -> None:
        self._flush()
        null = np.array([d is None for d in self.doc_ids], dtype="u1")
        columns = (np.array([d or 0 for d in self.doc_ids], dtype="<i8"), null, np.array(self.counts, dtype="<u4"), np.array(self.frames, dtype="<u4"))
        index = self.zstd.compress(struct.pack("<Q", len(null)) + b"".join(c.tobytes() for c in columns))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *e) for e in self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
        self.out.close()
        self.fs.move(self.part, self.path)


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, uri: str) -> None:
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        self.seek = [struct.unpack("<III", self._at(size - 9 - 12 * (n - i), 12)) for i in range(n)] if n < 4 else list(struct.iter_unpack("<III", self._at(size - 9 - 12 * n, 12 * n)))
        self.starts = np.concatenate(([0], np.cumsum([e[0] for e in self.seek], dtype="i8"))).astype("i8")
        at = int(self.starts[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"{uri} has no document index")
        raw = zstandard.ZstdDecompressor().decompress(self._at(at + 8, length))
        (n,) = struct.unpack_from("<Q", raw)
        self.doc_ids = np.frombuffer(raw, "<i8", n, 8)
        self.null = np.frombuffer(raw, "u1", n, 8 + 8 * n).astype(bool)
        self.counts = np.frombuffer(raw, "<u4", n, 8 + 9 * n).astype("i8")
        self.frames = np.frombuffer(raw, "<u4", n, 8 + 13 * n)

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        packed, size, checksum = self.seek[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.starts[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self, wanted: set[int | None] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this shard, its ids); only frames with wanted documents are read."""
        starts = np.concatenate(([0], np.cumsum(self.counts)))
        loaded, raw, base = -1, b"", 0
        for i, (doc, null, count, k) in enumerate(zip(self.doc_ids.tolist(), self.null.tolist(), self.counts.tolist(), self.frames.tolist())):
            doc = None if null else doc
            if wanted is not None and doc not in wanted:
                continue
            if k != loaded:
                loaded, raw = k, self.frame(k)
                base = int(starts[np.searchsorted(self.frames, k)])
            at = 4 * (int(starts[i]) - base)
            yield doc, int(starts[i]), raw[at : at + 4 * count]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write; returns the manifest (shard, path, n_docs, n_tokens), one row per shard.

    The rows are dealt by doc_id range and sorted inside each range, so shard order is document
    order. A retried task writes the same shard again under the same name.
    """
    spark = docs.sparkSession
    store.small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.repartitionByRange(store.partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        path, writer, n = f"{folder}/shard-{shard:06d}.zst", None, 0
        for batch, ids in encoded(batches, tokenizer, end_id):
            writer = writer or ShardWriter(path, f"{task.stageId()}-{task.taskAttemptId()}")
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), ids):
                writer.add(doc_id, own)
                n += len(own) // 4
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [len(writer.counts)], "n_tokens": [n]})

    return store.stored(dealt.mapInArrow(write, "shard long, path string, n_docs long, n_tokens long"), "manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per document, read back from the shards: doc_id, start, n_tokens, ids_crc32, ids.

    The manifest has one row per shard, so its prefix sums are made on the driver.
    """
    shards, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r["shard"]):
        shards.append((r["path"], before))
        before += r["n_tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                rows: list[tuple] = []
                for doc, start, ids in ShardReader(path).documents():
                    rows.append((doc, offset + start, len(ids) // 4, zlib.crc32(ids), ids))
                    if len(rows) == 2000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    listed = spark.sparkContext.parallelize(shards, len(shards)).toDF("path string, before long")
    return listed.mapInArrow(read, schema)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2, store.fresh_path(spark, "tokens"))
    return read_token_files(spark, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
