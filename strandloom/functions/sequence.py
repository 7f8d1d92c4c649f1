"""Column functions on nucleotide and protein strings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from strandloom.session import ship

# The standard bacterial code (table 11) in the order T, C, A, G of each base.
CODE_BASES = "TCAG"
CODE_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = ("ATG", "GTG", "TTG")


def codon_table() -> dict[str, str]:
    return {a + b + c: CODE_AMINO[16 * i + 4 * j + k] for i, a in enumerate(CODE_BASES) for j, b in enumerate(CODE_BASES) for k, c in enumerate(CODE_BASES)}


def reverse_complement(seq: Column) -> Column:
    """Complement in capitals of A, C, G, T in either case, reversed; other letters stay."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCATGCA")


def slice_sequence(contig: Column, start: Column, end: Column, strand: Column) -> Column:
    """1-based, end inclusive; empty where the place isn't inside the contig."""
    ok = (start > 0) & (start <= end) & (end <= F.length(contig))
    part = F.substring(contig, start.cast("int"), (end - start + 1).cast("int"))
    return F.coalesce(F.when(ok, F.when(strand == "-", reverse_complement(part)).otherwise(part)), F.lit(""))


def gene_length(start: Column, end: Column) -> Column:
    """0 where a coordinate is 0 or they are out of order."""
    return F.when((start > 0) & (end > 0) & (end >= start), end - start + 1).otherwise(F.lit(0)).cast("long")


def translate_with_stop(dna: Column) -> Column:
    """Amino acids codon by codon: a start codon in first place gives M, an ambiguous codon X, a partial one nothing."""
    rna_free = F.translate(F.upper(dna), "U", "T")
    table = F.create_map(*[F.lit(x) for pair in codon_table().items() for x in pair])
    n = F.floor(F.length(dna) / 3).cast("int")

    def amino(i: Column) -> Column:
        codon = F.substring(rna_free, i * 3 + 1, F.lit(3))
        return F.when((i == 0) & codon.isin(*STARTS), F.lit("M")).otherwise(F.coalesce(F.try_element_at(table, codon), F.lit("X")))

    return F.when(n >= 1, F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), amino), "")).otherwise(F.lit(""))


def translate(dna: Column) -> Column:
    """As translate_with_stop(), up to the first stop."""
    return F.substring_index(translate_with_stop(dna), "*", 1)


def _agreeing(a: Column, b: Column) -> Column:
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y) & (x != ""))
    return F.size(F.filter(pairs, lambda p: p))


def identity_by_min(a: Column, b: Column) -> Column:
    """Equal places over the shorter length; case counts; 0 if either is empty."""
    least = F.least(F.length(a), F.length(b))
    return F.when(least > 0, _agreeing(a, b) / least).otherwise(F.lit(0.0))


def identity_by_max(a: Column, b: Column) -> Column:
    """Equal places over the longer length; case doesn't count; 0 if either is empty."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), _agreeing(F.upper(a), F.upper(b)) / most).otherwise(F.lit(0.0))


def global_identity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length; 0 if either is empty."""
    both = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(both, 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(F.lit(0.0))


def coverage(a: Column, b: Column) -> Column:
    """The shorter length over the longer."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most > 0, F.least(F.length(a), F.length(b)) / most).otherwise(F.lit(0.0))


def length_ratio_ok(a: Column, b: Column, least: float) -> Column:
    """The length difference is at most 1 - least of the longer length; two empty sequences agree."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most > 0, F.abs(F.length(a) - F.length(b)) / most <= 1 - least + 1e-12).otherwise(F.lit(True))


def infix_distance(query: str, target: str, enough: int = 0) -> int:
    """Least edits that place query anywhere in target (free target ends), at most len(query).

    A column of the query is held as bits of where the distances rise and fall, so a letter of
    the target costs a few operations on whole words; the search ends once enough is reached.
    """
    n = len(query)
    if not n or not target:
        return n
    places: dict[str, int] = {}
    for i, c in enumerate(query):
        places[c] = places.get(c, 0) | 1 << i
    whole, last = (1 << n) - 1, 1 << (n - 1)
    rises, falls, now, best = whole, 0, n, n
    for c in target:
        same = places.get(c, 0)
        across = (((same & rises) + rises) ^ rises | same) & whole
        more, less = falls | whole & ~(across | rises), rises & across
        if more & last:
            now += 1
        elif less & last:
            now -= 1
            if now < best:
                best = now
                if best <= enough:
                    break
        kept, more, less = same | falls, more << 1, less << 1
        rises, falls = (less | ~(kept | more)) & whole, more & kept & whole
    return best


@F.pandas_udf(IntegerType())
def infix_distance_udf(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """infix_distance() by Arrow batch; there is no built-in for free end gaps."""
    for query, target in batches:
        yield pd.Series([infix_distance(q or "", t or "") for q, t in zip(query, target)], dtype="int32")


def infix_identity(query: Column, target: Column) -> Column:
    ship(SparkSession.active())
    n = F.length(query)
    return F.when(n > 0, 1 - infix_distance_udf(query, target) / n).otherwise(F.lit(0.0))
