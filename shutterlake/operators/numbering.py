"""Consecutive numbers over a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shutterlake import scratch


def numbered(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    """df with 1, 2, 3, ... in order of key, whose values differ: rows are dealt to ranges of the key, and each range starts where those before end."""
    parts = scratch.written(df.repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = {r["__part"]: r["count"] for r in parts.groupBy("__part").count().collect()}  # a row per partition
    first, run = [], 0
    for part in sorted(sizes):
        first.append((part, run))
        run += sizes[part]
    starts = df.sparkSession.createDataFrame(first, "__part int, __start long")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key))
    return parts.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__start") + inside).alias(name))
