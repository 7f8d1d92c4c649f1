"""Row numbers over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import stored

#: monotonically_increasing_id() has the partition above these bits and the row's place in it below.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with its place in the order, from 0: ranges are sorted and written, and their sizes (one row a range) added up."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(ranges, *order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = stored(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << _PLACE_BITS) - 1)
    return placed.join(F.broadcast(before), "__part").withColumn(name, place).select(*df.columns, name)
