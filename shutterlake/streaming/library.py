"""Streams that keep the library current: debounced folder changes, incremental scan and incremental duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shutterlake.functions import columns as C
from shutterlake.operators import catalog, clustering
from shutterlake.sources.files import IMAGE_EXTENSIONS
from shutterlake.sources.snapshots import Store


def debounced(events: DataFrame, key: str = "directory", ts: str = "ts", gap: str = "400 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(key, start, n): one row for a burst of events, once the gap has passed."""
    bursts = events.withWatermark(ts, late).groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("n"))
    return bursts.select(key, F.col("w.start").alias("start"), "n")


def suppressed(events: DataFrame, ttl_ms: int = 10_000) -> DataFrame:
    """Folder changes without those that the program itself declared.

    events: (directory, name, declared, at_ms). A declared name is held for
    ttl_ms and absorbs the next change of that name, once. A folder that holds
    no name has no state, and what nothing asks for goes after ttl_ms.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["directory", "name", "at_ms"])
            return
        held = dict(zip(*state.get)) if state.exists else {}
        out = []
        for frame in frames:
            for row in frame.sort_values(["at_ms", "declared"], ascending=[True, False]).itertuples(index=False):
                held = {n: end for n, end in held.items() if end >= row.at_ms}
                if row.declared:
                    held[row.name] = row.at_ms + ttl_ms
                elif held.pop(row.name, None) is None:
                    out.append((key[0], row.name, row.at_ms))
        if held:
            state.update((list(held), [held[n] for n in held]))
            state.setTimeoutDuration(ttl_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["directory", "name", "at_ms"])

    return events.groupBy("directory").applyInPandasWithState(run, "directory string, name string, at_ms long", "names array<string>, ends array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_scans(store: Store, table: str = "photos") -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that upserts scanned rows by path, newest first; a batch that runs again changes nothing."""

    def step(batch: DataFrame, batch_id: int) -> None:
        newest = batch.withColumn("__t", F.struct("mtime_ts", *(c for c in batch.columns if c not in ("mtime_ts", "tags")))).groupBy("path").agg(F.max("__t").alias("t"), F.max_by("tags", "__t").alias("tags"))
        rows = newest.select(*(F.col("tags") if c == "tags" else F.col(f"t.{c}").alias(c) for c in batch.columns))
        store.write(table, catalog.upsert(store.read(table, batch.schema), rows))

    return step


def incremental_duplicates(store: Store, most: int = 10, table: str = "fingerprints", pairs: str = "pairs") -> Callable[[DataFrame, int], None]:
    """A foreachBatch step that compares new fingerprints with all, and adds the pairs found."""

    def step(batch: DataFrame, batch_id: int) -> None:
        old = store.read(table, batch.schema)
        fresh = batch.join(old, ["id", "bits"], "left_anti").select(*batch.columns)
        kept = old.join(fresh.select("id"), "id", "left_anti").select(*batch.columns)
        every = kept.withColumn("new", F.lit(False)).unionByName(fresh.withColumn("new", F.lit(True)))
        found = clustering.duplicate_pairs(every, most, new="new")
        have = store.read(pairs, found.schema)
        changed = fresh.select("id")
        left = have.join(changed.withColumnRenamed("id", "a"), "a", "left_anti").join(changed.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "distance")
        store.write(pairs, left.unionByName(found.select("a", "b", "distance")).distinct())
        store.write(table, every.drop("new"))

    return step


def scan_stream(spark: SparkSession, folder: str, files_per_trigger: int = 500) -> DataFrame:
    """(path, mtime_ts, file_size) of media files as they appear below a folder, so many a trigger at most."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger)
    rows = files.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    out = rows.select(path.alias("path"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime_ts"), F.col("length").alias("file_size"))
    return out.where(C.extension("path").isin(*IMAGE_EXTENSIONS, *C.VIDEO_EXTENSIONS) & ~C.pruned(F.substring(F.col("path"), len(folder.rstrip("/")) + 1, 1 << 20)))


def visible(photos: DataFrame, criteria: catalog.Search) -> DataFrame:
    """New photos that the current view shows, from a stream as from a table."""
    return catalog.search(photos, criteria)


def partial_groups(members: DataFrame, show: Callable[[DataFrame], None], every: str = "2 seconds") -> StreamingQuery:
    """Start a query that shows, again and again, the sizes of the groups (group_id) that changed since."""
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n"))
    return sizes.writeStream.outputMode("update").trigger(processingTime=every).foreachBatch(lambda batch, _: show(batch)).start()
