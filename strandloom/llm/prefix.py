"""Sums over all rows before a row, in an order of the whole table, without one task that sees it all.

The rows are range-partitioned and sorted, a running sum is taken inside each range, and the
ranges' own sums (one row a range) are added up and broadcast. The ranges are written first, so
that every later step sees the same ones whatever is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import store

#: monotonically_increasing_id() has the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def before(df: DataFrame, order: list[Column], **values: Column | None) -> DataFrame:
    """df with a column for each of values: the sum of it over all rows before, 0 for the first.

    A value of None counts rows, which gives row numbers from 0. Rows that are equal in order come
    as they lie in df; so many of them as there may be, they are dealt over several ranges.
    """
    tie, part, at = (store.free_name(df, c) for c in ("__tie", "__part", "__at"))
    ways = [*order, F.col(tie)]
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(store.partitions(df.sparkSession), *ways).sortWithinPartitions(*ways)
    placed = store.stored(ranged.drop(tie).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "ranges")

    of_part, to_part = Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(F.col(part).alias("range")).agg(*[F.sum(F.lit(1) if v is None else v).alias(name) for name, v in values.items()])
    offsets = sums.select("range", F.struct(*[F.coalesce(F.sum(name).over(to_part), F.lit(0)).alias(name) for name in values]).alias("offset"))
    key, offset = store.free_name(df, "__range"), store.free_name(df, "__offset")
    inside = {n: F.col(at).bitwiseAND((1 << _PLACE_BITS) - 1) if v is None else F.coalesce(F.sum(v).over(of_part), F.lit(0)) for n, v in values.items()}
    found = placed.withColumns(inside).join(F.broadcast(offsets.toDF(key, offset)), F.col(part) == F.col(key))  # one row a range
    return found.withColumns({n: F.col(n) + F.col(f"{offset}.{n}") for n in values}).select(*df.columns, *values)
