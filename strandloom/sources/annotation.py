"""Annotation and sequence files as typed tables.

Every reader is one multi-path scan of whole files, so files are read in parallel and a file
that can't be parsed yields no row instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence as seq
from strandloom.functions import text as txt

GENE_TYPES = ("CDS", "gene")


def whole_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, genome_id (file stem), file_idx (order of the paths) and value (the text)."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    order = F.dense_rank().over(Window.orderBy("path")) - 1
    known = files.select("path").distinct().withColumn("file_idx", order.cast("int"))  # one narrow row per file
    return files.join(F.broadcast(known), "path").withColumn("genome_id", txt.file_stem(F.col("path")))


def lines(files: DataFrame) -> DataFrame:
    """One row per line, CRLF or LF, with its number."""
    return files.select(*[c for c in files.columns if c != "value"], F.posexplode(F.split("value", "\r?\n")).alias("line_idx", "line"))


def is_gff(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("gff", "gff3")


def is_genbank(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin("gb", "gbk", "gbff", "genbank")


def gff_records(files: DataFrame) -> DataFrame:
    """Typed records: nine fields or more, whole-number coordinates, strand + - or . ; others go."""
    head = files.withColumn("value", F.element_at(F.split("value", r"##FASTA[\r\n]", 2), 1))
    rows = lines(head).where((F.trim("line") != "") & ~F.col("line").startswith("#"))
    f = F.split("line", "\t")
    typed = rows.where(F.size(f) >= 9).select(
        "genome_id", "file_idx", F.col("line_idx").cast("long").alias("line_idx"), f[0].alias("contig"), f[2].alias("type"),
        f[3].try_cast("long").alias("start"), f[4].try_cast("long").alias("end"), f[6].alias("strand"), txt.attributes(f[8]).alias("attributes"),
    )
    return typed.where(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("strand").isin("+", "-", "."))


def fasta_records(text: DataFrame, value: str = "value") -> DataFrame:
    """header, id (its first word), sequence of line-anchored records; records without sequence go."""
    parts = F.posexplode(F.split(F.concat(F.lit("\n"), F.col(value)), r"[\r\n]+>"))
    rows = text.select(*[c for c in text.columns if c != value], parts.alias("record_idx", "record")).where("record_idx > 0")
    header = F.trim(F.regexp_extract("record", r"^([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_extract("record", r"^[^\r\n]*[\r\n]*([\s\S]*)$", 1), r"\s", "")
    out = rows.select(*[c for c in rows.columns if c != "record"], header.alias("header"), F.split(header, r"\s+")[0].alias("id"), body.alias("sequence"))
    return out.where(F.length("sequence") > 0)


def fasta_stream(text: DataFrame, value: str = "value") -> DataFrame:
    """record_idx, header, sequence where any '>' starts a record; records without sequence stay, header empty too."""
    parts = F.posexplode(F.slice(F.split(value, ">"), 2, 2**31 - 1)).alias("record_idx", "record")
    rows = text.select(*[c for c in text.columns if c != value], parts)
    body = F.regexp_replace(F.regexp_extract("record", r"^[^\r\n]*([\s\S]*)$", 1), r"\s", "")
    return rows.select(*[c for c in rows.columns if c != "record"], F.trim(F.regexp_extract("record", r"^([^\r\n]*)", 1)).alias("header"), body.alias("sequence"))


def last_of_id(records: DataFrame, keys: list[str]) -> DataFrame:
    """The last record of each id."""
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("record_idx")))
    return records.withColumn("__n", latest).where("__n = 1").drop("__n")


def gff_contigs(files: DataFrame) -> DataFrame:
    """genome_id, contig, sequence of the part after ##FASTA."""
    tail = files.select("genome_id", F.try_element_at(F.split("value", r"##FASTA[\r\n]", 2), F.lit(2)).alias("value")).where("value is not null")
    return last_of_id(fasta_records(tail), ["genome_id", "id"]).select("genome_id", F.col("id").alias("contig"), "sequence")


def gff_genes(files: DataFrame) -> DataFrame:
    """genes(genome_id, file_idx, line_idx, gene_id, contig, start, end, strand, annotation, sequence).

    CDS rows count; where a file has none, its gene rows do. Minus-strand sequences are
    reverse-complemented; a place outside the contig gives an empty sequence.
    """
    records = gff_records(files).where(F.col("type").isin(*GENE_TYPES))
    has_cds = F.max(F.col("type") == "CDS").over(Window.partitionBy("genome_id"))
    kept = records.withColumn("has_cds", has_cds).where((F.col("type") == "CDS") | ~F.col("has_cds"))
    at = F.col("attributes")
    named = F.coalesce(at["ID"], at["Name"], F.concat_ws("_", "contig", "start", "end"))
    joined = kept.join(gff_contigs(files).withColumnRenamed("sequence", "dna"), ["genome_id", "contig"], "left")
    dna = F.coalesce("dna", F.lit(""))
    return joined.select("genome_id", "file_idx", "line_idx", named.alias("gene_id"), "contig", "start", "end", "strand", F.coalesce(at["product"], at["gene"]).alias("annotation"), seq.slice_sequence(dna, F.col("start"), F.col("end"), F.col("strand")).alias("sequence"))


def genbank_sequences(files: DataFrame) -> DataFrame:
    """genome_id and the letters of the first ORIGIN block; a file without one fails."""
    block = F.regexp_extract("value", r"(?s)ORIGIN[^\r\n]*[\r\n]+(.*?)(?://|$)", 1)
    found = files.select("genome_id", F.regexp_replace(block, "[^A-Za-z]", "").alias("sequence"))
    return found.withColumn("sequence", F.when(F.length("sequence") > 0, F.col("sequence")).otherwise(F.raise_error(F.concat(F.lit("no sequence in "), "genome_id"))))


def gene_calls(coordinates: DataFrame, nucleotides: DataFrame, proteins: DataFrame) -> DataFrame:
    """Called genes with both sequences, by gene id; a missing one is empty."""
    n = nucleotides.select(F.col("id").alias("gene_id"), F.col("sequence").alias("sequence"))
    p = proteins.select(F.col("id").alias("gene_id"), F.col("sequence").alias("protein"))
    return coordinates.join(n, "gene_id", "left").join(p, "gene_id", "left").na.fill("", ["sequence", "protein"])
