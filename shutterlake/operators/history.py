"""Edit history and journal analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shutterlake.functions import columns as C


def capped(history: DataFrame, most: int = 50) -> DataFrame:
    """The newest rows of each photo."""
    n = F.row_number().over(Window.partitionBy("photo").orderBy(F.col("id").desc()))
    return history.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def latest(history: DataFrame, photo: int, n: int = 20) -> DataFrame:
    """The newest rows of a photo whose state is JSON, oldest first."""
    good = history.where((F.col("photo") == photo) & F.expr("try_parse_json(state_json)").isNotNull())
    return good.orderBy(F.col("id").desc()).limit(n).orderBy("id")


def save_edit(current: DataFrame, history: DataFrame, edit: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(current, history) after saving edits: an unmodified edit takes its photo out of current, and still is history.

    edit: (photo, modified, id, operation, state_json, created_at).
    """
    kept = current.join(edit.select("photo"), "photo", "left_anti").select(*current.columns)
    now = edit.where("modified").select(*current.columns)
    return kept.unionByName(now), capped(history.unionByName(edit.select(*history.columns)), most)


def delete_edits(current: DataFrame, history: DataFrame, photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, history) without photos (photo)."""
    gone = photos.select("photo").distinct()
    return tuple(t.join(gone, "photo", "left_anti").select(*t.columns) for t in (current, history))


def rename_edits(current: DataFrame, history: DataFrame, old, new) -> tuple[DataFrame, DataFrame]:
    return tuple(t.withColumn("photo", F.when(F.col("photo") == old, F.lit(new)).otherwise(F.col("photo")).cast(t.schema["photo"].dataType)) for t in (current, history))


def push_history(history: DataFrame, states: DataFrame, most: int = 50) -> DataFrame:
    """History with states from before an operation; what is current stays as it is."""
    return capped(history.unionByName(states.select(*history.columns)), most)


def thread_report(journal: DataFrame, slow_ms: float = 500, critical_ms: float = 2000) -> DataFrame:
    """(thread, runs, avg_ms, max_ms, errors, last_event, severity) of each thread."""
    ended = F.col("event") == "END"
    per = journal.groupBy("thread").agg(
        F.count_if(ended).alias("runs"), F.round(F.avg(F.when(ended, F.col("elapsed_ms"))), 6).alias("avg_ms"), F.max(F.when(ended, F.col("elapsed_ms"))).alias("max_ms"),
        F.count_if(F.col("event") == "ERROR").alias("errors"), F.max_by("event", F.struct("ts", "id")).alias("last_event"),
    )
    m = F.coalesce("max_ms", F.lit(0.0))
    return per.withColumn("severity", F.when((m >= critical_ms) | (F.col("errors") > 0), "critical").when(m >= slow_ms, "slow").otherwise("ok"))


def step_deltas(journal: DataFrame) -> DataFrame:
    """(thread, n, mean_ms, max_ms) of the times between consecutive steps."""
    before = F.lag("ts").over(Window.partitionBy("thread").orderBy("ts", "id"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000.0
    steps = journal.where("event = 'STEP'").withColumn("gap", gap).where("gap is not null")
    return steps.groupBy("thread").agg(F.count("*").alias("n"), F.round(F.avg("gap"), 3).alias("mean_ms"), F.round(F.max("gap"), 3).alias("max_ms"))


def slowest(journal: DataFrame, n: int = 5) -> DataFrame:
    """The slowest ended runs of each thread."""
    rank = F.row_number().over(Window.partitionBy("thread").orderBy(F.col("elapsed_ms").desc(), "id"))
    return journal.where("event = 'END'").withColumn("place", rank).where(F.col("place") <= n).select("thread", "place", "id", "elapsed_ms")


def first_errors(journal: DataFrame, n: int = 5) -> DataFrame:
    return journal.where("event = 'ERROR'").orderBy("ts", "id").limit(n)


def tail(journal: DataFrame, n: int) -> DataFrame:
    return journal.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)


def date_actions(files: DataFrame, now_year: int, tolerance_s: int = 2) -> DataFrame:
    """(action) per file: what to do about the date of the file against the one in its metadata."""
    difference = F.abs(F.unix_micros(F.col("mtime_ts").cast("timestamp")) - F.unix_micros(F.col("date_taken").cast("timestamp")))
    action = F.when(F.col("date_taken").isNull(), "no_date").when(~C.coherent_date("date_taken", now_year), "incoherent").when(difference <= tolerance_s * 1_000_000, "in_sync").otherwise("set_file_date")
    return files.withColumn("action", action)


def sessions(events: DataFrame, key: str, ts: str = "ts", gap: str = "400 milliseconds") -> DataFrame:
    """(key, start, n): bursts of events that a gap ends; works on streams too."""
    return events.groupBy(F.col(key), F.session_window(F.col(ts), gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
