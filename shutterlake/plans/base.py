"""The table of queries: each is a function of views and has SQL over the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shutterlake.sources import adapters as A

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, views: tuple[str, ...], sql: str | None):
    """Register a query over views, and its SQL."""

    def wrap(f):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return f(*(getattr(A, v)(spark, sf) for v in views))

        if name in QUERIES:
            raise ValueError(f"two queries of one name: {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = A.with_views(sql, *views)
        return f

    return wrap


def spread(df: DataFrame, key: str = "id") -> DataFrame:
    """df dealt out to all cores, for rows that cost far more than their shuffle: a small file is read by one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
