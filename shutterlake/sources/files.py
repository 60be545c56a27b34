"""Sources: files on disk, sidecars, contacts, journals and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shutterlake.functions import columns as C

JOURNAL = T.StructType([T.StructField("ts", T.DoubleType()), T.StructField("wall", T.StringType()), T.StructField("tid", T.LongType()), T.StructField("thread", T.StringType()), T.StructField("event", T.StringType()), T.StructField("msg", T.StringType()), T.StructField("elapsed_ms", T.DoubleType())])
# Extensions that a scan takes, besides videos.
IMAGE_EXTENSIONS = ("arw", "bmp", "cr2", "cr3", "dng", "gif", "heic", "heif", "jpeg", "jpg", "nef", "orf", "png", "raf", "rw2", "tif", "tiff", "webp")


def scan(spark: SparkSession, folder: str, with_content: bool = False) -> DataFrame:
    """(path, mtime_ts, file_size[, content]) of every media file below a folder that a scan takes; contents are read only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.regexp_replace("path", "^file:/+", "/")
    out = files.select(path.alias("path"), F.col("modificationTime").cast("timestamp_ntz").alias("mtime_ts"), F.col("length").alias("file_size"), *(["content"] if with_content else []))
    inside = F.substring(F.col("path"), len(folder.rstrip("/")) + 1, 1 << 20)
    return out.where(C.extension("path").isin(*IMAGE_EXTENSIONS, *C.VIDEO_EXTENSIONS) & ~C.pruned(inside))


def dvd_folders(files: DataFrame) -> DataFrame:
    """Parents of VIDEO_TS folders."""
    parts = F.split("path", "/")
    at = F.array_position(F.transform(parts, lambda p: F.upper(p)), F.lit("VIDEO_TS"))
    return files.where(at > 1).select(F.array_join(F.slice(parts, 1, (at - 1).cast("int")), "/").alias("folder")).distinct()


def json_lines(spark: SparkSession, path: str, schema: T.StructType, needed: str) -> DataFrame:
    """Rows of JSON lines (journals, histories of problems, registries of deleted files); lines that are not JSON, or lack what is needed, are left out."""
    whole = T.StructType([*schema.fields, T.StructField("bad", T.StringType())])
    rows = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    return rows.where(F.col("bad").isNull() & F.col(needed).isNotNull()).drop("bad")


def journal(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, JOURNAL, "event")


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def rotated(rows: DataFrame, above: int = 8000, keep: int = 5000) -> DataFrame:
    """The newest rows, once there are too many."""
    return rows if rows.limit(above + 1).count() <= above else rows.orderBy(F.col("ts").desc()).limit(keep)


def export_journal(rows: DataFrame, path: str) -> None:
    rows.select("wall", "thread", "tid", "event", "elapsed_ms", "msg").write.mode("overwrite").option("header", True).csv(path)


def contacts(spark: SparkSession, path: str) -> DataFrame:
    """(hash, name) of a contacts file."""
    schema = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_name", T.StringType())])
    rows = spark.read.format("xml").option("rowTag", "contact").schema(schema).load(path)
    return rows.select(F.col("_id").alias("hash"), F.col("_name").alias("name")).where("hash is not null and name <> ''")


def sidecar_sections(spark: SparkSession, path: str) -> DataFrame:
    """(ini, section, entries) of sidecar files, read whole: entries is a map of the lines key=value of a [section].

    Files that are no UTF-8 are read as Latin-1; those below a folder Originals are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(~F.exists(F.split("path", "/"), lambda p: F.lower(p) == "originals"))
    value = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    text = files.select(F.col("path").alias("ini"), F.concat(F.lit("\n"), F.regexp_replace(value, "\r", "")).alias("t"))
    part = text.select("ini", F.explode(F.slice(F.split("t", r"\n\["), 2, 1 << 30)).alias("s"))
    lines = F.filter(F.slice(F.split("s", "\n"), 2, 1 << 30), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return part.select("ini", F.regexp_extract("s", r"^([^\]]*)\]", 1).alias("section"), F.map_from_entries(last).alias("entries"))


def sidecar_contacts(sections: DataFrame) -> DataFrame:
    rows = sections.where(F.lower("section").isin("contacts", "contacts2")).select(F.explode("entries").alias("hash", "name"))
    return rows.select("hash", F.trim(F.substring_index("name", ";", 1)).alias("name")).distinct()


def sidecar_faces(sections: DataFrame) -> DataFrame:
    """(ini, file, hash, box) of the faces that sidecars name; box as fractions."""
    items = sections.where("entries['faces'] is not null").select("ini", F.col("section").alias("file"), F.explode(F.split(F.col("entries")["faces"], ";")).alias("item"))
    found = items.select("ini", "file", F.regexp_extract("item", r"rect64\(([0-9a-fA-F]{1,16})\)", 1).alias("r"), F.trim(F.substring_index("item", ",", -1)).alias("hash"))
    return found.where("r <> ''").select("ini", "file", "hash", C.rect64("r").alias("box"))


def sidecar_edits(sections: DataFrame) -> DataFrame:
    """(ini, file, rotate, crop, filters) of edited files."""
    e = F.col("entries")
    crop = F.coalesce(F.nullif(F.regexp_extract(e["crop"], r"rect64\(([0-9a-fA-F]{1,16})\)", 1), F.lit("")), e["crop64"])
    rotate = F.regexp_extract(e["rotate"], r"([0-3])", 1).try_cast("int")
    rows = sections.select("ini", F.col("section").alias("file"), rotate.alias("rotate"), F.when(crop.isNotNull(), C.rect64(crop)).alias("crop"), C.filter_steps(e["filters"]).alias("filters"))
    return rows.where("rotate is not null or crop is not null or size(filters) > 0")


def sidecar_stats(sections: DataFrame) -> DataFrame:
    """(n_contacts, n_photos, n_edits) before an import."""
    e = F.col("entries")
    contacts_ = sidecar_contacts(sections).agg(F.countDistinct("name").alias("n_contacts"))
    rest = sections.where(~F.lower("section").isin("contacts", "contacts2", "picasa", "encoding")).agg(F.count_if(e["faces"].isNotNull()).alias("n_photos"), F.count_if(e["filters"].isNotNull() | e["rotate"].isNotNull() | e["crop"].isNotNull()).alias("n_edits"))
    return contacts_.join(F.broadcast(rest))  # one row each


def metadata_date(original, digitized, changed) -> Column:
    """Date of a photo by precedence, from metadata text 'yyyy:MM:dd HH:mm:ss'."""
    parse = lambda c: F.try_to_timestamp(C.col(c), F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz")
    return F.coalesce(parse(original), parse(digitized), parse(changed))


def merged_tags(first, second) -> Column:
    """Metadata maps in one; where both have a tag the first counts."""
    a, b = C.col(first), C.col(second)
    return F.map_concat(F.map_filter(b, lambda k, v: ~F.map_contains_key(a, k)), a)
