"""Finding genes again in contigs: seeds first, then every contig for what the seeds didn't find.

A gene counts as found in a genome if some stretch of the genome's contigs is within a bounded
number of edits of it. At an identity of 0.7 no seed is certain to be kept, so seeds only spare
work: sampled k-mers that a gene and its genome's contigs share vote for a diagonal, and the
stretch at the best one is compared. Pairs that this doesn't find are looked for in all contigs of
their genome, cut into overlapping pieces, so the answer is that of comparing everything. A piece
travels once for a block of genes; distances advance a whole column of a gene at a time as bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import infix_distance
from strandloom.session import ship, stored

#: Length of seeds, the share of k-mers that are seeds (one of), places in a genome beyond which a seed doesn't vote, and the width of a diagonal.
SEED, SAMPLE, COMMON, BAND = 12, 4, 32, 256
#: Bases of a piece of a contig without its overlap, and genes that share a piece's row on average.
PIECE, BLOCK = 50_000, 32


def most_edits(length: int, identity: float) -> int:
    """The most edits of a gene of this length that leave the identity."""
    d = int((1 - identity) * length) + 1
    while d > 0 and 1 - d / length < identity:
        d -= 1
    return d


def _seeds(rows: DataFrame, keys: list[str], text: str, place: str) -> DataFrame:
    """keys, place and hash of the sampled k-mers of a text."""
    at = F.explode(F.sequence(F.lit(0), F.length(text) - SEED))
    each = rows.where(F.length(text) >= SEED).select(*keys, text, at.alias(place))
    return each.select(*keys, place, F.xxhash64(F.substring(F.col(text), F.col(place) + 1, F.lit(SEED))).alias("seed")).where(F.pmod("seed", F.lit(SAMPLE)) == 0)


def _holds(identity: float):
    @F.pandas_udf("array<string>")
    def holds(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for genes, pieces in batches:
            yield pd.Series([[g["dst"] for g in own if infix_distance(g["query"], piece, most_edits(len(g["query"]), identity)) <= most_edits(len(g["query"]), identity)] for own, piece in zip(genes, pieces, strict=True)])

    return holds


def by_seeds(asked: DataFrame, contigs: DataFrame, identity: float) -> DataFrame:
    """(dst, genome_id) of asked (dst, genome_id, query) found at the diagonal with the most seeds."""
    texts = stored(contigs.select("genome_id", F.monotonically_increasing_id().alias("contig"), "sequence"), "contigs")
    wanted = _seeds(asked.select("dst", "query").distinct(), ["dst"], "query", "off")
    there = _seeds(texts, ["genome_id", "contig"], "sequence", "pos")
    there = there.join(there.groupBy("genome_id", "seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= COMMON).drop("n"), ["genome_id", "seed"])
    met = asked.select("dst", "genome_id").join(wanted, "dst").join(there, ["genome_id", "seed"])
    votes = met.groupBy("dst", "genome_id", "contig", F.floor((F.col("pos") - F.col("off")) / BAND).alias("diagonal")).agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("dst", "genome_id").agg(F.max_by(F.struct("contig", "diagonal"), F.struct("votes", "contig", "diagonal")).alias("best")).select("dst", "genome_id", "best.*")
    near = best.join(asked, ["dst", "genome_id"]).join(texts, ["genome_id", "contig"])
    n = F.length("query")
    start = F.greatest(F.lit(0), F.col("diagonal") * BAND - n)
    piece = F.substring(F.col("sequence"), (start + 1).cast("int"), (3 * n + 2 * BAND).cast("int"))
    hit = near.select("dst", "genome_id", _holds(identity)(F.array(F.struct("dst", "query")), piece).alias("hit"))
    return hit.where(F.size("hit") > 0).select("dst", "genome_id")


def by_pieces(asked: DataFrame, contigs: DataFrame, identity: float) -> DataFrame:
    """(dst, genome_id) of asked found anywhere in the genome's contigs."""
    longest = asked.agg(F.max(F.length("query"))).first()[0]
    if longest is None:
        return asked.select("dst", "genome_id")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("sequence") - 1, F.lit(0)), F.lit(PIECE)))
    pieces = contigs.select("genome_id", "sequence", at.alias("at")).select("genome_id", F.substring(F.col("sequence"), F.col("at") + 1, F.lit(PIECE + 2 * longest)).alias("piece"))
    blocks = asked.groupBy("genome_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = asked.join(blocks, "genome_id").groupBy("genome_id", F.pmod(F.xxhash64("dst"), F.col("blocks")).alias("block")).agg(F.collect_list(F.struct("dst", "query")).alias("genes"))
    hit = dealt.join(pieces, "genome_id").select("genome_id", F.explode(_holds(identity)("genes", "piece")).alias("dst"))
    return hit.distinct().select("dst", "genome_id")


def refound(missing: DataFrame, seqs: DataFrame, contigs: DataFrame, identity: float = 0.7, least: int = 10) -> DataFrame:
    """(dst, genome_id) of missing genomes whose contigs hold the sequence of dst somewhere.

    Each genome is searched in its own contigs; sequences shorter than least aren't looked for.
    """
    ship(missing.sparkSession)
    q = seqs.where(F.length("sequence") >= least).select(F.col("cluster_id").alias("dst"), F.col("sequence").alias("query"))
    asked = stored(missing.select("dst", "genome_id").distinct().join(q, "dst").select("dst", "genome_id", "query"), "asked")
    own = contigs.where(F.length("sequence") > 0).select("genome_id", "sequence")
    first = stored(by_seeds(asked, own, identity), "seeded")
    rest = stored(asked.join(first, ["dst", "genome_id"], "left_anti"), "rest")
    return first.unionByName(by_pieces(rest, own, identity))
