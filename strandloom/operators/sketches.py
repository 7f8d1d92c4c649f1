"""Distances between genomes from their sequences: scaled k-mer sketches.

A sketch is the k-mers of a genome, each the lesser of itself and its reverse complement, whose
hash lies below a fixed share of all hashes, so sketches of any genomes can be compared and their
sizes follow the genomes'. The share of one sketch found in the other, to the power 1/k, is the
identity that leaves so many k-mers whole. Counts of shared hashes come from bitmap blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.shared import CHUNK, shared_bits, shared_counts
from strandloom.session import ship, stored

K, SCALED = 21, 1000
#: Bases of a piece whose k-mers are made by one row; pieces overlap by k - 1.
PIECE = 20_000
#: Bases of the longest k-mer whose number, two bits a base, fits a long.
CODED = 31
#: Bases of the longest k-mer of which a task marks what it has met as bits: 4 MB a genome while it counts, 512 KB handed on.
MARKED = 11
#: Genomes whose marks a task holds at once, and bases that are numbered at a time.
TABLES, BLOCK = 32, 1 << 17
_CODES = np.full(256, 4, dtype="u1")
_CODES[list(b"ACGT")] = range(4)


def kmers(sequences: DataFrame, k: int = K) -> DataFrame:
    """(genome_id, kmer) of every place of (genome_id, sequence): canonical, of A, C, G and T alone."""
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("sequence") - k, F.lit(0)), F.lit(PIECE)))
    pieces = sequences.where(F.length("sequence") >= k).select("genome_id", F.upper("sequence").alias("sequence"), at.alias("at")).select("genome_id", F.substring(F.col("sequence"), F.col("at") + 1, F.lit(PIECE + k - 1)).alias("piece"))
    each = pieces.select("genome_id", "piece", F.explode(F.sequence(F.lit(1), F.length("piece") - (k - 1))).alias("i")).select("genome_id", F.substring(F.col("piece"), F.col("i"), F.lit(k)).alias("kmer"))
    plain = each.where(F.col("kmer").rlike("^[ACGT]+$"))
    return plain.select("genome_id", F.least("kmer", F.translate(F.reverse("kmer"), "ACGT", "TGCA")).alias("kmer"))


def codes_of(text: bytes, k: int) -> np.ndarray:
    """The canonical k-mers of a text as numbers, in order of their places; those with another letter are left out."""
    base = _CODES[np.frombuffer(text, dtype="u1")]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, dtype="i8")
    other = np.concatenate(([0], np.cumsum(base > 3)))
    base = (base & 3).astype("i8")
    ahead, turned = np.zeros(n, dtype="i8"), np.zeros(n, dtype="i8")
    for i in range(k):
        ahead |= base[i : i + n] << (2 * (k - 1 - i))
        turned |= (3 - base[i : i + n]) << (2 * i)
    return np.minimum(ahead, turned)[other[k:] == other[:-k]]


def _upper(sequences: DataFrame) -> DataFrame:
    return sequences.select("genome_id", F.upper("sequence").alias("sequence"))


def _texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Scalar, list[np.ndarray]]]:
    """(genome, numbers of its k-mers in blocks) of each batch."""
    for batch in batches:
        genomes, texts = batch.column("genome_id"), batch.column("sequence")
        names = genomes.dictionary_encode().dictionary
        own = genomes.dictionary_encode().indices.fill_null(len(names)).to_numpy()
        for g in np.unique(own):
            joined = b"\n".join(t.encode() for t in texts.filter(pa.array(own == g)).to_pylist() if t)
            yield names[int(g)] if g < len(names) else pa.scalar(None, genomes.type), [codes_of(joined[at : at + BLOCK + k - 1], k) for at in range(0, len(joined), BLOCK)]


def marks(sequences: DataFrame, k: int) -> DataFrame:
    """(genome_id, chunk, bits), once each, of (genome_id, sequence): bit b of a chunk is the number chunk * CHUNK + b of a k-mer, k at most MARKED.

    A task hands on one bitmap for each genome and chunk that it has met, not a row for each k-mer.
    """
    ship(sequences.sparkSession)
    kind = sequences.schema["genome_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[pa.Scalar, np.ndarray] = {}

        def full() -> Iterator[pa.RecordBatch]:
            for genome, table in tables.items():
                bits = np.packbits(table, bitorder="little").reshape(-1, CHUNK // 8)
                some = np.flatnonzero(bits.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.repeat(genome, len(some)), pa.array(some.astype("i4")), pa.array([bits[b].tobytes() for b in some], pa.binary())], names=["genome_id", "chunk", "bits"])
            tables.clear()

        for genome, blocks in _texts(batches, k):
            if genome not in tables:
                if len(tables) == TABLES:
                    yield from full()
                tables[genome] = np.zeros(max(1 << 2 * k, CHUNK), dtype=bool)
            for codes in blocks:
                tables[genome][codes] = True
        yield from full()

    found = _upper(sequences).mapInArrow(run, f"genome_id {kind}, chunk int, bits binary")
    return found.groupBy("genome_id", "chunk").agg(F.bitmap_or_agg("bits").alias("bits"))


def coded_kmers(sequences: DataFrame, k: int) -> DataFrame:
    """(genome_id, code), once each, of (genome_id, sequence): what kmers() has, as numbers of two bits a base, k at most CODED."""
    ship(sequences.sparkSession)
    kind = sequences.schema["genome_id"].dataType.simpleString()

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for genome, chunk, bits in zip(batch.column("genome_id"), batch.column("chunk").to_pylist(), batch.column("bits").to_pylist()):
                codes = chunk * CHUNK + np.flatnonzero(np.unpackbits(np.frombuffer(bits, dtype="u1"), bitorder="little"))
                yield pa.RecordBatch.from_arrays([pa.repeat(genome, len(codes)), pa.array(codes)], names=["genome_id", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for genome, blocks in _texts(batches, k):
            if blocks:
                codes = np.unique(np.concatenate(blocks))
                yield pa.RecordBatch.from_arrays([pa.repeat(genome, len(codes)), pa.array(codes)], names=["genome_id", "code"])

    if k <= MARKED:
        return marks(sequences, k).mapInArrow(unpacked, f"genome_id {kind}, code long")
    return _upper(sequences).mapInArrow(run, f"genome_id {kind}, code long").distinct()


def spelt(code: str, k: int) -> Column:
    """The k-mer of a number: its digits to the base 4."""
    return F.translate(F.lpad(F.conv(F.col(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def distinct_kmers(sequences: DataFrame, k: int = K) -> DataFrame:
    """(genome_id, kmer) of (genome_id, sequence), once each."""
    if k > CODED:
        return kmers(sequences, k).distinct()
    return coded_kmers(sequences, k).select("genome_id", spelt("code", k).alias("kmer"))


def sketches(sequences: DataFrame, k: int = K, scaled: int = SCALED) -> DataFrame:
    """(genome_id, item), once each: the hashes of one of `scaled` k-mers; the k-mers themselves, or their numbers, with scaled = 1."""
    if scaled == 1 and k <= CODED:
        return coded_kmers(sequences, k).select("genome_id", F.col("code").alias("item"))
    found = distinct_kmers(sequences, k)
    if scaled == 1:
        return found.select("genome_id", F.col("kmer").alias("item"))
    hashed = found.select("genome_id", F.xxhash64("kmer").alias("item"))
    return hashed.where(F.shiftrightunsigned("item", 1) < (1 << 63) // scaled).distinct()


def genome_identities(sequences: DataFrame, k: int = K, scaled: int = SCALED, least: float = 0.0) -> DataFrame:
    """(g1, g2, shared, ani, align_1, align_2) of pairs of genomes that share a hash, g1 < g2.

    align_1 and align_2 are the shares of each one's sketch in the other; the identity is that of
    the larger, as genomes may differ in length. Pairs below least are left out.
    """
    if scaled == 1 and k <= MARKED:
        rows = stored(marks(sequences, k), "marks")
        n, counts = F.sum(F.bitmap_count("bits")), shared_bits(rows.withColumnRenamed("genome_id", "owner"))
    else:
        rows = stored(sketches(sequences, k, scaled), "sketches")
        n, counts = F.count(F.lit(1)), shared_counts(rows.select("item", F.col("genome_id").alias("owner")))
    size = stored(rows.groupBy("genome_id").agg(n.alias("n")), "sizes")
    both = counts.select(F.col("a").alias("g1"), F.col("b").alias("g2"), "shared")
    a, b = (size.select(F.col("genome_id").alias(f"g{x}"), F.col("n").alias(f"n{x}")) for x in (1, 2))
    shares = both.join(a, "g1").join(b, "g2").select("g1", "g2", "shared", (F.col("shared") / F.col("n1")).alias("align_1"), (F.col("shared") / F.col("n2")).alias("align_2"))
    return shares.select("g1", "g2", "shared", F.pow(F.greatest("align_1", "align_2"), F.lit(1.0 / k)).alias("ani"), "align_1", "align_2").where(F.col("ani") >= least)
