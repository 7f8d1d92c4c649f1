"""Tables and folders that every executor can reach, and settings for Python workers.

Lineage is cut by writing Parquet under the folder named in ``spark.checkpoint.dir``, as in
strandloom.session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.session import forget, fresh_path, shared_dir, ship, stored

__all__ = ["forget", "free_name", "fresh_path", "partitions", "shared_dir", "small_batches", "stored"]


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Make Python workers ready: they get this package, and a bounded number of rows at a time."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
