"""Taking rows out of a table by id and text, without shuffling the texts where few go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import store

#: Rows that may be broadcast (16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 400_000


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id and text hash are in gone (doc_id, text_hash); null ids match null ids."""
    gone_id, gone_hash = store.free_name(docs, "__gone_id"), store.free_name(docs, "__gone_hash")
    keys = gone.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).distinct()
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    match = F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(gone_hash))
    return docs.join(F.broadcast(keys) if few else keys, match, "left_anti")
