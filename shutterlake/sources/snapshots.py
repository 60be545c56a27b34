"""Versioned table snapshots on plain Parquet: a write makes a new version, then a mark of its own says that it is whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

class Store:
    """Tables under one folder: <name>/v=<n>/, whole once there is a file <name>/done-<n>. Nothing is ever overwritten but a version that was not finished."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _numbers(self, name: str, prefix: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted((int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)), reverse=True)

    def version(self, name: str) -> int:
        """The newest whole version; 0 if there is none."""
        return max(self._numbers(name, "done-"), default=0)

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """The current version; with a schema, columns that it lacks are null and others are left out."""
        n = self.version(name)
        if not n:
            if schema is None:
                raise ValueError(f"no table {name}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/{name}/v={n}")

    def write(self, name: str, df: DataFrame) -> int:
        n = self.version(name) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={n}")
        fs, mark = self._fs(f"{self.root}/{name}/done-{n}")
        fs.create(mark, False).close()
        return n

    def purge_if_version_differs(self, name: str, wanted: int, cache_version: int) -> bool:
        """Empty a cache table whose contents another version of the code made."""
        if wanted == cache_version:
            return False
        self.write(name, self.read(name).limit(0))
        return True

    def backups(self, name: str) -> list[int]:
        return self._numbers(name, "done-")

    def restore(self, name: str, version: int) -> int:
        return self.write(name, self.spark.read.parquet(f"{self.root}/{name}/v={version}"))


def newest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert by key: rows of new replace those of old."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def keep_known(tables: dict[str, DataFrame], paths: DataFrame, key: str = "path") -> dict[str, DataFrame]:
    """Tables without rows of paths that no longer exist."""
    known = paths.select(key).distinct()
    return {n: t.join(known, key, "left_semi").select(*t.columns) for n, t in tables.items()}


def without(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti").select(*table.columns)


def purge_counts(tables: dict[str, DataFrame], paths: DataFrame, key: str = "path") -> DataFrame:
    """(name, n): rows that keep_known takes out of each table."""
    known = paths.select(key).distinct()
    parts = [t.join(known, key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n, t in sorted(tables.items())]
    return reduce(DataFrame.unionAll, parts)


def all_keys(tables: list[DataFrame], key: str) -> DataFrame:
    """The keys that any table has."""
    return reduce(DataFrame.unionAll, (t.select(key) for t in tables)).distinct()
