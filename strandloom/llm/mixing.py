"""Mixing sources to target weights (operator 12), by DataFrame functions only.

Every row gets a key from a hash of its id. Rows are range-sorted by source and key, prefix sums
of their sizes are taken over all ranges, and each source is cut at its budget exactly: whole
epochs first, then the rows before the cut; the row at the cut is taken in part.

Targets: all targets add up to a share of all sizes and follow the weights, but none exceeds a
multiple of its source's size; what is above goes to the others by weight. Sources are ordered
by how soon they fill up, so the ones that do are a prefix of that order, found from prefix sums
of limits and weights instead of round by round.

Defined results. A null or empty text has size 0 and takes nothing; null sources are one source,
the last; null ids share a key; rows with one key follow each other by id and size, and rows
equal in these are interchangeable; a source without words has target 0; an empty table gives no
row; a text of any length is counted whole; other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import store
from strandloom.llm.prefix import before

WEIGHTS = (3, 1, 2)
#: Share of all sizes that the mix has, as a fraction, and the times that a source may be taken.
SHARE, EPOCHS = (3, 2), 2
SEED = "mix-1"
_SPACES = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """The number of runs of characters that aren't white space: each run becomes one letter, the spaces go."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "w"), _SPACES, "")), F.lit(0)).cast("long")


def hash_key(identity: Column, seed: str) -> Column:
    """60 bits of an md5, which other systems have too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(identity.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sources (source, source_size, ...) with weight, by their order and repeating, and target."""
    numbered = before(sources, [F.col("source").asc_nulls_last()], number=None)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))
    limited = weighed.withColumn("limit", F.col("source_size") * epochs)
    exact = "decimal(19,0)"
    fills = before(limited, [F.col("limit").cast(exact) / F.col("weight").cast("decimal(9,0)"), F.col("number")], limits=F.col("limit"), weights=F.col("weight"))
    fills = store.stored(fills, "fills")
    whole = fills.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    up, down = share
    total, all_weights = up * (whole["size"] or 0), whole["weight"] or 0
    room, rest = F.lit(all_weights).cast(exact) - F.col("weights"), F.lit(total).cast("decimal(28,0)") - F.col("limits") * down
    full = F.col("limit").cast(exact) * room * down < F.col("weight").cast("decimal(9,0)") * rest
    told = fills.withColumn("full", full)
    gone = told.where("full").agg(F.sum("limit").alias("limit"), F.sum("weight").alias("weight")).first()
    left, of = total - down * (gone["limit"] or 0), down * (all_weights - (gone["weight"] or 0))
    part = F.col("weight") * F.lit(float(left)) / F.lit(float(max(of, 1)))
    return told.withColumn("target", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(part)).drop("limits", "weights", "limit", "full", "number")


def mix(docs: DataFrame, size: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, weight, target, epochs (whole ones), taken.

    A row takes its size once for each whole epoch of its source and what lies before the cut.
    """
    counted = n_words(F.col(text_col).cast("string")) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), counted.alias("size"), hash_key(F.col(id_col), seed).alias("key"))
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size")]
    placed = store.stored(before(store.stored(rows, "sizes"), order, words=F.col("size")), "placed")
    sources = store.stored(placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("words").alias("start")), "sources")
    goals = store.stored(targets(sources, weights, share, epochs).withColumnRenamed("source", "of"), "targets")
    found = placed.join(goals, F.col("source").eqNullSafe(F.col("of")))
    budget = F.round("target").cast("long")
    found = found.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0))
    cut = budget - F.col("epochs") * F.col("source_size")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), cut - (F.col("words") - F.col("start"))))
    return found.select("doc_id", "source", "size", "source_size", "weight", "target", "epochs", (F.col("epochs") * F.col("size") + rest).cast("long").alias("taken"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "weight", "epochs")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::BIGINT AS weight FROM d GROUP BY source),
p AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER ()::HUGEINT * 3 AS total2, sum(weight) OVER ()::HUGEINT AS w,
    coalesce(sum(2 * source_size) OVER o, 0)::HUGEINT AS caps, coalesce(sum(weight) OVER o, 0)::HUGEINT AS ws
  FROM s WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, 2 * cap::HUGEINT * (w - ws) < weight * (total2 - 2 * caps) AS filled FROM p),
t AS (
  SELECT source, source_size, weight, CASE WHEN filled THEN cap::DOUBLE ELSE weight * (total2 - 2 * coalesce(sum(cap) FILTER (filled) OVER (), 0))::DOUBLE
      / (2 * (w - coalesce(sum(weight) FILTER (filled) OVER (), 0)))::DOUBLE END AS target FROM f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, round(t.target)::BIGINT AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS words
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - words)))::BIGINT AS taken, weight, epochs::BIGINT AS epochs FROM e
"""
