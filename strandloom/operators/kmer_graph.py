"""The coloured graph of k-mers of many genomes, and its unitigs.

A node is a k-mer or its reverse complement, whichever is less; its colours are the genomes that
have it. Two k-mers are linked where they overlap in k - 1 bases. Both sides of every overlap
carry its text, so links come from one grouping by that text, without a join, and no group is
larger than eight rows, however many genomes share it. Where exactly one k-mer leads into an
overlap and one out of it, they belong to one unitig. Unitigs are ranked by pointer doubling from
their heads: rounds grow with the logarithm of the longest one.

k is odd, so no k-mer is its own reverse complement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import sketches, statistics
from strandloom.session import forget, stored

#: Bases that are put together by one row before a unitig is.
PIECE = 4096


def _turned(text):
    return F.translate(F.reverse(text), "ACGT", "TGCA")


def coloured(sequences: DataFrame, k: int) -> DataFrame:
    """(kmer, genome_id), once each, of (genome_id, sequence); rows without a genome have no colour and are left out."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    return sketches.distinct_kmers(sequences.where("genome_id is not null"), k).select("kmer", "genome_id")


def uncoloured(sequences: DataFrame, k: int) -> DataFrame:
    """(kmer), once each, of the rows that coloured() takes."""
    if k % 2 == 0:
        raise ValueError("k must be odd")
    return sketches.distinct_kmers(sequences.where("genome_id is not null").select(F.lit(0).alias("genome_id"), "sequence"), k).select("kmer")


def overlaps(kmers: DataFrame) -> DataFrame:
    """(id, kmer, to, to_kmer, n_out, n_in) by overlap: one of the strands that lead into it and one that leads out.

    A strand is its own text: a k-mer or its reverse complement; kmers(kmer) are distinct.
    """
    k = F.length("kmer")
    strands = kmers.select("kmer", F.explode(F.array("kmer", _turned(F.col("kmer")))).alias("text"))
    sides = strands.select("kmer", "text", F.explode(F.array(F.struct(F.expr("substring(text, 2)").alias("shared"), F.lit(True).alias("out")), F.struct(F.substring(F.col("text"), F.lit(1), k - 1).alias("shared"), F.lit(False).alias("out")))).alias("s"))
    out = F.col("s.out")
    strand = F.struct(F.col("text").alias("id"), F.col("kmer"))
    met = sides.groupBy("s.shared").agg(F.count_if(out).alias("n_out"), F.count_if(~out).alias("n_in"), F.min(F.when(out, strand)).alias("a"), F.min(F.when(~out, strand)).alias("b"))
    return met.select(F.col("a.id").alias("id"), F.col("a.kmer").alias("kmer"), F.col("b.id").alias("to"), F.col("b.kmer").alias("to_kmer"), "n_out", "n_in")


def _ranked(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(strands with a head, strands on rings) of (id, kmer, at, rank, least, goes): at is where the walk back stands.

    A round doubles the reach of each walk that hasn't come to a head. One in which none arrives
    leaves only rings; they go on until each walk has seen its whole ring, for its least k-mer.
    """
    done, going, reach = steps.where("not goes"), stored(steps.where("goes"), "walks"), 1
    n = going.count()
    heads = done
    while n:
        ahead = going.unionByName(heads).select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("rank").alias("rank2"), F.col("least").alias("least2"), F.col("goes").alias("goes2"))
        moved = going.join(ahead, "at").select("id", "kmer", F.col("at2").alias("at"), (F.col("rank") + F.col("rank2")).alias("rank"), F.least("least", "least2").alias("least"), F.col("goes2").alias("goes"))
        moved = stored(moved, "walks")
        arrived, last, going = moved.where("not goes"), going, moved.where("goes")
        done = done.unionByName(arrived)
        heads = heads.unionByName(arrived)
        left, reach = going.count(), reach * 2
        if left == n and reach >= n:
            break
        n = left
        forget(last)
    return done, going


def ranked_kmers(kmers: DataFrame) -> DataFrame:
    """(unitig, rank, text) of distinct (kmer): its unitig's first strand, its place there from 0, the strand that it has there.

    A unitig is named and read from whichever of its two ends has the lesser first strand; a ring
    is cut before its least k-mer. A k-mer isn't linked to itself.
    """
    kmers = stored(kmers.select("kmer"), "kmers")
    links = stored(overlaps(kmers).where("n_out = 1 and n_in = 1 and kmer <> to_kmer").select("id", "to"), "links")
    strands = kmers.select("kmer", F.explode(F.array("kmer", _turned(F.col("kmer")))).alias("id"))
    back = strands.join(links.select(F.col("to").alias("id"), F.col("id").alias("before")), "id", "left")
    goes = F.col("before").isNotNull()
    # a head stands at itself; the last head of a walk is a row that doesn't go
    steps = stored(back.select("id", "kmer", F.coalesce("before", "id").alias("at"), goes.cast("long").alias("rank"), F.col("kmer").alias("least"), goes.alias("goes")), "steps")
    done, rings = _ranked(steps)
    # of a ring and its reverse, the one that has the least k-mer as it is, cut before it
    ours = rings.select("id", F.col("least").alias("ring"))
    cut = stored(steps.join(ours, "id").withColumn("head", F.col("id") == F.col("ring")), "rings")
    again = cut.select("id", "kmer", F.when(F.col("head"), F.col("id")).otherwise(F.col("at")).alias("at"), F.when(F.col("head"), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("rank"), "least", (~F.col("head")).alias("goes"))
    if not cut.isEmpty():
        done = done.unionByName(_ranked(again)[0])
    return done.groupBy("kmer").agg(F.min(F.struct(F.col("at").alias("unitig"), "rank", F.col("id").alias("text"))).alias("u")).select("kmer", "u.unitig", "u.rank", "u.text")


def unitigs(sequences: DataFrame, k: int = 31) -> DataFrame:
    """(unitig, sequence, n_kmers, n_genomes) of (genome_id, sequence); a unitig's genomes have any of its k-mers."""
    colours = stored(coloured(sequences, k), "colours")
    ranked = stored(ranked_kmers(colours.select("kmer").distinct()), "ranked")
    bases = F.when(F.col("rank") == 0, F.col("text")).otherwise(F.expr("right(text, 1)"))
    joined = lambda at: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, "bases"))), lambda x: x["bases"]), "")
    pieces = ranked.select("unitig", "rank", bases.alias("bases"), F.floor(F.col("rank") / PIECE).alias("piece")).groupBy("unitig", "piece").agg(joined("rank").alias("bases"), F.count(F.lit(1)).alias("n"))
    whole = pieces.groupBy("unitig").agg(joined("piece").alias("sequence"), F.sum("n").alias("n_kmers"))
    have = ranked.select("kmer", "unitig").join(colours, "kmer").select("unitig", "genome_id").distinct().groupBy("unitig").agg(F.count(F.lit(1)).alias("n_genomes"))
    return whole.join(have, "unitig").select("unitig", "sequence", "n_kmers", "n_genomes")


def graph_statistics(found: DataFrame, genomes: int) -> DataFrame:
    """One row on (sequence, n_genomes) of unitigs: their number, bases, mean length and n50, k-mers, genomes, mean genomes.

    k-mers are estimated for k = 31 whatever k is, and at least one a unitig; without unitigs all is zero.
    """
    rows = found.select(F.length("sequence").cast("long").alias("length"), F.col("n_genomes").cast("long").alias("n"))
    lengths = statistics.length_statistics(rows.select("length"), []).select("n50")
    kmers = F.greatest(F.col("length") - 30, F.lit(1).cast("long"))
    total = rows.agg(F.count(F.lit(1)).alias("num_unitigs"), F.sum("length").alias("total_bases"), F.avg("length").alias("avg_unitig_length"), F.sum(kmers).alias("num_kmers"), (F.sum("n") / F.count(F.lit(1))).alias("color_complexity"))
    return total.join(lengths, F.lit(True), "left").withColumn("num_colors", F.lit(genomes).cast("long")).na.fill(0)
