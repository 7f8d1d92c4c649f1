"""A training corpus from documents: five stages, each one of the operators in strandloom.llm.

Defined results, for every stage but the last: the columns are those of documents, other columns
ride along whatever their names, and an empty table stays empty. Decisions go by doc_id (null
matches null) and text, so repeated rows fare alike, and rows of one id and different texts are
judged each on its own. A null or empty text counts as empty and is kept as it is, in whatever
number of rows; texts are read whole. Ties are settled in the stages' own lines below.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.decontaminate import contaminated_by
from strandloom.llm.keep import without
from strandloom.llm.minhash import near_duplicates
from strandloom.llm.packing import pack, tokenized
from strandloom.llm.secrets import redact, scan_secrets
from strandloom.llm.toxicity import score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go; a score of exactly 0.5 is toxic."""
    scored = store.stored(score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), "scored")
    return without(docs, scored.where("predicted = 1"))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one row stays, of the least doc_id.

    Rows are told apart by a number of their own, so null and repeated ids are linked too; a null
    id comes after all others; a document without words is no copy.
    """
    row = store.free_name(docs, "__row")
    rows = store.stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, id_col=row, width=5).where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id", "text_hash")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "row")
    own = store.stored(found, "copies").join(rows.select(F.col(row).alias("row"), "doc_id"), "row").select("component_id", "text_hash", "row", order.alias("order"))
    least = own.groupBy("component_id").agg(F.min("order").alias("least"))
    gone = own.join(least, "component_id").where(F.col("row") != F.col("least.row")).select(F.col("row").alias("doc_id"), "text_hash")
    return without(rows, store.stored(gone, "gone"), row).drop(row)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; an item covered by exactly four fifths is held."""
    found = store.stored(contaminated_by(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "leaks")
    return without(docs, found.where(F.size("items") > 0))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts and n_chars follows; all documents stay. Overlapping spans become one mark each where a gap is left."""
    return redact(docs, scan_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of 2048, of every row, one piece at least (the end id)."""
    return pack(tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"), 1)).drop("row")


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can express neither the learned toxicity model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each one's rows written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
