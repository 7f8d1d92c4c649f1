"""Matrices, gene tables, phenotypes and results of other tools as typed tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import text as txt
from strandloom.session import ship, stored
from strandloom.sources.markup import graph_markup  # noqa: F401  one more reader

#: The leading columns of the wide presence table.
METADATA = ("Gene", "Non-unique Gene name", "Annotation", "No. isolates", "No. sequences", "Avg sequences per isolate", "Genome Fragment", "Order within Fragment", "Accessory Fragment", "Accessory Order with Fragment", "QC", "Min group size nuc", "Max group size nuc", "Avg group size nuc")
GENE_DATA = ("gene_id", "gene_name", "annotation", "contig", "start", "end", "strand", "support", "dna_sequence", "protein_sequence")


def long_presence(wide: DataFrame, genomes: list[str], cluster: str, present: Column | None = None) -> DataFrame:
    """presence(cluster_id, genome_id, cell) of a wide table: one pass, no shuffle."""
    rows = wide.select(F.col(cluster).alias("cluster_id"), F.explode(F.array(*[F.struct(F.lit(g).alias("genome_id"), F.col(f"`{g}`").cast("string").alias("cell")) for g in genomes])).alias("x"))
    rows = rows.select("cluster_id", "x.genome_id", "x.cell")
    cell = F.trim(F.coalesce("cell", F.lit("")))
    return rows.where(~cell.isin("", "0", "FALSE") if present is None else present)


def presence_csv(spark: SparkSession, path: str) -> DataFrame:
    """The wide CSV with metadata columns; a cell is absent if it is empty, 0 or FALSE."""
    wide = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if len(wide.columns) <= len(METADATA):
        raise ValueError(f"{path} has no genome column")
    return long_presence(wide, wide.columns[len(METADATA):], wide.columns[0])


def genome_count(spark: SparkSession, path: str) -> int:
    """Columns beyond the metadata, 0 at least; only the header is read, quoted cells as one."""
    return max(0, len(spark.read.csv(path, header=True, escape='"').columns) - len(METADATA))


def rtab(spark: SparkSession, path: str) -> DataFrame:
    """Cluster rows by genome columns, tab-separated; 1, true and present count."""
    wide = spark.read.csv(path, header=True, sep="\t")
    return long_presence(wide, wide.columns[1:], wide.columns[0], F.lower(F.trim("cell")).isin("1", "true", "present"))


def gene_data(spark: SparkSession, path: str) -> DataFrame:
    """By column name; a missing column is empty."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return raw.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in GENE_DATA])


def phenotypes(spark: SparkSession, path: str, genomes: DataFrame) -> DataFrame:
    """(genome_id, trait, value) of a tab- or comma-separated table, each column after the first a trait; an unknown genome is an error."""
    first = spark.read.text(path).first()[0]
    raw = spark.read.csv(path, header=True, sep="\t" if "\t" in first else ",")
    key, *traits = raw.columns
    own = F.array(*[F.struct(F.lit(t).alias("trait"), F.col(f"`{t}`").try_cast("double").alias("value")) for t in traits])
    rows = raw.select(F.col(f"`{key}`").alias("genome_id"), F.explode(own).alias("own")).select("genome_id", "own.*")
    unknown = rows.join(genomes, "genome_id", "left_anti").take(1)
    if unknown:
        raise ValueError(f"unknown genome {unknown[0][0]!r} in {path}")
    return rows


def by_alias(raw: DataFrame, aliases: dict[str, tuple[tuple[str, ...], str, object]]) -> DataFrame:
    """Columns found under any of their names, typed, with a default: name -> (aliases, type, default)."""
    low = {c.lower(): c for c in raw.columns}
    out = []
    for name, (names, kind, default) in aliases.items():
        found = [F.col(f"`{low[n.lower()]}`") for n in names if n.lower() in low]
        out.append(F.coalesce(*[c.try_cast(kind) for c in found], F.lit(default).cast(kind)).alias(name))
    return raw.select(*out)


# The names under which other tools write these columns.
ASSOCIATION_NAMES = {
    "gene": (("Gene", "gene", "gene_id", "cluster_id", "variant"), "string", ""),
    "trait": (("Trait", "trait", "phenotype"), "string", ""),
    "p_value": (("Naive_p", "p_value", "pvalue", "p_value_corrected", "lrt-pvalue", "fisher_p"), "double", 1.0),
    "fdr": (("Benjamini_H_p", "fdr", "padj", "q_value", "fisher_q"), "double", 1.0),
    "odds_ratio": (("Odds_ratio", "odds_ratio", "effect_size", "effect", "beta"), "double", 1.0),
    "n_present": (("n_present", "present", "cases"), "long", 0),
    "n_absent": (("n_absent", "absent", "controls"), "long", 0),
}
AMR_NAMES = {
    "gene_name": (("gene_name", "Gene symbol", "Element symbol"), "string", ""),
    "drug_class": (("resistance", "Class"), "string", ""),
    "method": (("method", "Method"), "string", ""),
    "identity": (("identity", "% Identity to reference sequence"), "double", 0.0),
    "coverage": (("coverage", "% Coverage of reference sequence"), "double", 0.0),
    "contig": (("contig", "Contig id"), "string", ""),
    "start": (("start", "Start"), "long", 0),
    "end": (("end", "Stop"), "long", 0),
}


def associations(spark: SparkSession, path: str) -> DataFrame:
    return by_alias(spark.read.csv(path, header=True), ASSOCIATION_NAMES)


def significant_count(associations: DataFrame, level: float = 0.05) -> DataFrame:
    """One row: n, and n_significant below the level."""
    return associations.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("fdr") < level).alias("n_significant"))


def effect_lines(spark: SparkSession, path: str) -> DataFrame:
    """(variant, effect, p_value, fdr) of lines of four words; comments, a header and other lines go."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("SNP") & (F.size(f) >= 4))
    out = rows.select(f[0].alias("variant"), *[f[k].try_cast("double").alias(n) for k, n in ((1, "effect"), (2, "p_value"), (3, "fdr"))])
    return out.where("effect is not null and p_value is not null and fdr is not null")


# The names under which the correlation tool writes its columns, in their usual order.
CORRELATION_NAMES = (("gene1", "gene_1", "gene_a", "locus1", "id1"), ("gene2", "gene_2", "gene_b", "locus2", "id2"), ("mi", "mutual_information", "mutual-info", "i"), ("pvalue", "p_value", "pval", "p"))


def correlations(spark: SparkSession, path: str) -> DataFrame:
    """(gene1, gene2, mi, p_value) of a table with blanks between columns and a header; bad numbers are 0 and 1."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#"))
    first = lines.first()
    head = first[0].split() if first else []
    low = [h.lower() for h in head]
    at = [next((low.index(n) for n in names if n in low), k) for k, names in enumerate(CORRELATION_NAMES)]
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.size(f) >= 4) & (F.trim("value") != (first[0].strip() if first else "")))

    def number(k: int, default: float) -> Column:
        value = F.get(f, F.lit(at[k])).try_cast("double")
        return F.coalesce(F.when(~F.isnan(value), value), F.lit(default))

    return rows.select(F.get(f, F.lit(at[0])).alias("gene1"), F.get(f, F.lit(at[1])).alias("gene2"), number(2, 0.0).alias("mi"), number(3, 1.0).alias("p_value"))


# The rows of a table of gain and loss rates, by their names.
RATE_NAMES = {"gain_rate": ("gain", "gain_rate"), "loss_rate": ("loss", "loss_rate"), "alpha": ("alpha",), "convergence": ("convergence", "converged"), "r_squared": ("r_squared", "R2", "adj.r.squared")}


def rates(spark: SparkSession, path: str) -> DataFrame:
    """One row of the rates, 0 where missing, of lines name,value; quoted lines and headers go."""
    f = F.split("value", ",")
    rows = spark.read.text(path).where(~F.col("value").startswith(",") & ~F.col("value").startswith('"') & (F.size(f) >= 2))
    rows = rows.select(F.trim(f[0]).alias("name"), F.trim(f[1]).try_cast("double").alias("v"))
    return rows.agg(*[F.coalesce(F.max(F.when(F.col("name").isin(*names), F.col("v"))), F.lit(0.0)).alias(k) for k, names in RATE_NAMES.items()])


def alpha_kappa(text: DataFrame, value: str = "value") -> DataFrame:
    """text with alpha and kappa of its lines (the first number after the name), 0 where missing."""
    def number(pattern: str) -> Column:
        return F.coalesce(F.regexp_extract(value, pattern, 1).try_cast("double"), F.lit(0.0))

    return text.withColumn("alpha", number(r"(?im)^(?!.*kappa).*alpha[^0-9\-\r\n]*(-?[0-9]+(?:\.[0-9]+)?)")).withColumn("kappa", number(r"(?im)^(?!.*alpha)(?:.*kappa|k)[^0-9\-\r\n]*(-?[0-9]+(?:\.[0-9]+)?)"))


def cluster_members(spark: SparkSession, path: str) -> DataFrame:
    """(cluster_id, gene_id) of lines 'representative member', each pair once per line."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(f) >= 2).select(f[0].alias("cluster_id"), f[1].alias("gene_id"))


def identity_matrix(pairs: DataFrame, genomes: DataFrame) -> DataFrame:
    """(g1, g2, ani) of all pairs of genomes(genome_id): 1 on the diagonal, 0 where (g1, g2, ani) has none, either way round.

    One row per genome on each side; the square is the result.
    """
    g = genomes.select("genome_id").distinct()
    grid = g.select(F.col("genome_id").alias("g1")).crossJoin(F.broadcast(g.select(F.col("genome_id").alias("g2"))))
    both = pairs.select("g1", "g2", "ani").unionByName(pairs.select(F.col("g2").alias("g1"), F.col("g1").alias("g2"), "ani")).groupBy("g1", "g2").agg(F.max("ani").alias("ani"))
    return grid.join(both, ["g1", "g2"], "left").select("g1", "g2", F.when(F.col("g1") == F.col("g2"), 1.0).otherwise(F.coalesce("ani", F.lit(0.0))).alias("ani"))


def alignment_groups(genes: DataFrame, presence: DataFrame | None, genomes: int, core: bool = False, share: float = 0.99) -> DataFrame:
    """(cluster_id, name, sequence) for an aligner, of a gene table and the presence of its clusters.

    One row for each genome of a cluster, or one for the cluster where presence lacks it; clusters
    with fewer than two rows or no sequence go; core: only clusters with the core's support.
    """
    from strandloom.operators.matrix import core_threshold

    rows = genes.where(F.length("dna_sequence") > 0).select(F.col("gene_id").alias("cluster_id"), F.col("support").try_cast("long").alias("support"), F.col("dna_sequence").alias("sequence"))
    if core:
        rows = rows.where(F.col("support") >= core_threshold(genomes, share))
    if presence is None:
        return rows.select("cluster_id", F.col("cluster_id").alias("name"), "sequence").limit(0)
    several = presence.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("cluster_id")
    met = rows.join(several, "cluster_id", "left_semi").join(presence.select("cluster_id", "genome_id"), "cluster_id")
    return met.select("cluster_id", F.concat_ws("__", "cluster_id", "genome_id").alias("name"), "sequence")


def amr_hits(spark: SparkSession, path: str) -> DataFrame:
    return by_alias(spark.read.csv(path, header=True, sep="\t"), AMR_NAMES)


def ani_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(g1, g2, ani) of tab-separated lines: file stems, percent as a fraction; header lines go."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 3)
    return rows.select(txt.file_stem(f[0]).alias("g1"), txt.file_stem(f[1]).alias("g2"), txt.ani_fraction(f[2].try_cast("double")).alias("ani")).where("ani is not null")


def growth_points(spark: SparkSession, path: str) -> DataFrame:
    """(block, n, size): pairs of numbers; blank lines start the next block, '#' is a comment.

    The part files of a folder, in the order of their names, are one text; any other file is its own.
    Lines are read range by range: a task counts the runs of blank lines in its ranges, and only the
    ranges' counts (one row a range) are added up.
    """
    ship(spark)
    file = F.col("_metadata.file_path")
    found = stored(spark.read.text(path, lineSep="\n").select(file.alias("file"), F.col("_metadata.file_block_start").alias("range"), "value").mapInArrow(_growth_lines, "file string, range long, runs long, line string, lead long, n long, blank_end boolean"), "growth")
    text = F.coalesce(F.nullif(F.regexp_extract("file", r"^(.*/)part-[^/]*$", 1), F.lit("")), F.col("file"))
    in_text = Window.partitionBy("text").orderBy("file", "range")
    earlier = in_text.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    ranges = found.where("n is not null").withColumn("text", text)
    # a run over a border is counted by both ranges; one blank line at a text's beginning has no line before it
    ranges = ranges.withColumn("twice", ((F.col("lead") > 0) & F.coalesce(F.lag("blank_end").over(in_text), F.lit(False))).cast("long")).withColumn("leading", F.when(total(F.col("n") - F.col("lead")) == 0, F.col("lead")).otherwise(0))
    lone = (F.sum("leading").over(Window.partitionBy("text")) == 1).cast("long")
    before = ranges.select("file", "range", (total("runs") - total("twice") - F.col("twice") - lone).alias("before"))
    f = F.split(F.trim("line"), r"\s+")
    rows = found.where("line is not null").join(before, ["file", "range"]).where(~F.col("line").startswith("#") & (F.size(f) >= 2))
    return rows.select((F.col("before") + F.col("runs")).cast("int").alias("block"), f[0].try_cast("long").alias("n"), f[1].try_cast("double").alias("size")).where("n is not null and size is not null")


def _growth_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that aren't blank, with the runs of blank ones before them in their range; after each range a row with its sums."""
    names = ["file", "range", "runs", "line", "lead", "n", "blank_end"]
    last = None  # file, range, runs, blank lines at the beginning, lines, whether the last one is blank

    def closed() -> pa.RecordBatch:
        at, start, runs, lead, n, end = last
        return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([start]), pa.array([runs]), pa.nulls(1, pa.string()), pa.array([lead]), pa.array([n]), pa.array([end])], names=names)

    for batch in batches:
        files, starts, lines = batch.column("file").dictionary_encode(), batch.column("range").to_numpy(), batch.column("value")
        own = files.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(own) != 0) | (np.diff(starts) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(lines)]):
            if lo == hi:
                continue
            key = (files.dictionary[int(own[lo])].as_py(), int(starts[lo]))
            if last is not None and last[:2] != key:
                yield closed()
                last = None
            _, _, runs, lead, n, end = last or (*key, 0, 0, 0, False)
            part = lines.slice(lo, hi - lo)
            blank = pc.match_substring_regex(part, r"^[ \t\n\v\f\r]*$").to_numpy(zero_copy_only=False)
            met = runs + np.cumsum(blank & ~np.concatenate(([end], blank[:-1])))
            keep = pa.array(np.flatnonzero(~blank))
            m = len(keep)
            yield pa.RecordBatch.from_arrays([pa.repeat(key[0], m), pa.repeat(pa.scalar(key[1], pa.int64()), m), pa.array(met).take(keep), part.take(keep), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_())], names=names)
            if lead == n:
                lead += int(np.argmin(blank)) if not blank.all() else len(blank)
            last = (*key, int(met[-1]), lead, n + len(blank), bool(blank[-1]))
    if last is not None:
        yield closed()


def quality_report(files: DataFrame) -> DataFrame:
    """completeness (100 if missing), contamination (0), by genome, from keyword lines."""
    def number(word: str, default: float) -> Column:
        return F.coalesce(F.regexp_extract("value", rf"(?i){word}[^0-9\r\n]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(default))

    return files.select("genome_id", number("completeness", 100.0).alias("completeness"), number("contamination", 0.0).alias("contamination"))
