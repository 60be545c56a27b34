"""Intermediate tables in the folder that driver and executors share.

Lineage is cut by writing Parquet and reading it back: one pass over the plan,
and the result survives the loss of any executor.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a folder of our own only where the setting is unset and all tasks run in this process."""
    base = spark.conf.get(CHECKPOINT_CONF, "") or None
    if base is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        base = f"file:///tmp/shutterlake-{uuid.uuid4().hex}"
        spark.conf.set(CHECKPOINT_CONF, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str = "table") -> str:
    return f"{shared_dir(spark)}/shutterlake/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "table", gathered: bool = False, codec: str | None = None) -> DataFrame:
    """Write df once and return the written table; its path is in ``.scratch_path``.

    gathered: for tables that come out of a shuffle and are small beside it.
    Their tasks take several partitions each, four tasks a core at least, so
    that a table is not hundreds of tiny files where partitions are not merged.
    codec: of Parquet, if not the session's own.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if gathered:
        df = df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table of written() that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path is None:
        return
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that have ended; it does so only once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
