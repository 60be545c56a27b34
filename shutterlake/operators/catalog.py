"""Catalog of photos: search, views, counters, albums, and changes as new DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shutterlake.functions import columns as C

#: Columns that belong to the user; a scan never changes them.
USER_COLUMNS = ("is_favorite", "tags", "rating", "duplicate_group_id", "id")


# --- search and views -----------------------------------------------------


@dataclass(frozen=True)
class Search:
    """What to look for; every part that is set must hold."""

    date_from: str | None = None
    date_to: str | None = None
    camera: str | None = None
    directory: str | None = None
    min_rating: int = 0
    tags: tuple[str, ...] = ()
    favorites_only: bool = False
    media_type: str | None = None

    def predicates(self) -> list[Column]:
        taken, out = F.coalesce("date_taken", "mtime_ts"), []
        if self.date_from:
            out.append(taken >= F.lit(self.date_from).cast("timestamp_ntz"))
        if self.date_to:  # the whole last day
            out.append(taken < F.lit(self.date_to).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
        if self.camera:  # a photo without a make has no camera name
            out.append(F.contains(F.lower(F.concat("camera_make", F.lit(" "), "camera_model")), F.lit(self.camera.lower())))
        if self.directory:
            out.append(C.under("directory", self.directory))
        if self.min_rating:
            out.append(F.col("rating") >= self.min_rating)
        if self.favorites_only:
            out.append(F.col("is_favorite"))
        if self.media_type:
            out.append(F.col("media_type") == self.media_type)
        return out + [C.has_tag("tags", t) for t in self.tags]


def search(photos: DataFrame, criteria: Search) -> DataFrame:
    return photos.filter(reduce(Column.__and__, criteria.predicates(), F.lit(True)))


def of_person(photos: DataFrame, faces: DataFrame, person_id: int) -> DataFrame:
    """Photos with a face of the person that is not ignored."""
    return photos.join(faces.where((F.col("person_id") == person_id) & ~F.col("ignored")).select(F.col("photo_id").alias("id")), "id", "left_semi")


def text_search(photos: DataFrame, text: str) -> DataFrame:
    names = ("filename", "camera_make", "camera_model")
    return photos.filter(reduce(Column.__or__, (F.contains(F.lower(F.coalesce(n, F.lit(""))), F.lit(text.lower())) for n in names)))


def in_folder(photos: DataFrame, folder: str, recursive: bool = False) -> DataFrame:
    return photos.filter(C.under("directory", folder) if recursive else F.col("directory") == folder)


def min_rating(photos: DataFrame, stars: int) -> DataFrame:
    return photos.filter(F.col("rating") >= max(1, stars))


def by_tag(photos: DataFrame, tag: str) -> DataFrame:
    return photos.filter(C.has_tag("tags", tag))


def newest(photos: DataFrame, n: int) -> DataFrame:
    return photos.withColumn("effective_date", F.coalesce("date_taken", "mtime_ts")).orderBy(F.col("effective_date").desc_nulls_last(), "id").limit(n)


def page(photos: DataFrame, n: int, skip: int, *order) -> DataFrame:
    return photos.orderBy(*order).offset(skip).limit(n)


def by_keys(photos: DataFrame, keys: DataFrame, on: str = "path") -> DataFrame:
    return photos.join(keys.select(on).distinct(), on, "left_semi")


def known_mtimes(photos: DataFrame, folder: str) -> DataFrame:
    return in_folder(photos, folder, True).select("path", "mtime_ts")


def changed_files(files: DataFrame, photos: DataFrame) -> DataFrame:
    """Files that are new, or whose time differs by a second or more."""
    known = photos.select(F.col("path").alias("__p"), F.col("mtime_ts").alias("__m"))
    near = F.abs(F.unix_micros(files["mtime_ts"].cast("timestamp")) - F.unix_micros(F.col("__m").cast("timestamp"))) < 1_000_000
    return files.join(known, (files["path"] == F.col("__p")) & near, "left_anti")


# --- counters -------------------------------------------------------------


def stats(photos: DataFrame) -> DataFrame:
    return photos.agg(F.count("*").alias("n_photos"), F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), F.countDistinct("directory").alias("n_folders"))


def recursive_counts(photos: DataFrame, folders: DataFrame) -> DataFrame:
    """(directory, n) for each asked folder, with everything below; counted per folder first."""
    own = photos.groupBy("directory").agg(F.count("*").alias("n"))
    rolled = own.select(F.explode(C.ancestors("directory")).alias("directory"), "n").groupBy("directory").agg(F.sum("n").alias("n"))
    return folders.join(rolled, "directory", "left").select("directory", F.coalesce("n", F.lit(0)).alias("n"))


def all_tags(photos: DataFrame) -> DataFrame:
    return photos.select(F.explode("tags").alias("tag")).distinct()


def tag_states(photos: DataFrame) -> DataFrame:
    """(tag, state) of a selection: all or some of its photos have the tag."""
    tagged = photos.select("id", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    size = photos.agg(F.count("*").alias("size"))
    return tagged.join(F.broadcast(size)).select("tag", F.when(F.col("n") == F.col("size"), "all").otherwise("some").alias("state"))  # size: one row


def cameras(photos: DataFrame) -> DataFrame:
    label = F.trim(F.concat_ws(" ", "camera_make", "camera_model"))
    return photos.select(label.alias("camera")).where("camera <> ''").distinct()


# --- albums ---------------------------------------------------------------


def album_counts(albums: DataFrame, members: DataFrame) -> DataFrame:
    n = members.groupBy("album_id").agg(F.count("*").alias("n"))
    return albums.join(n, albums.id == n.album_id, "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n_photos"))


def album_view(photos: DataFrame, members: DataFrame, album_id: int) -> DataFrame:
    return photos.join(members.where(F.col("album_id") == album_id).select(F.col("photo_id").alias("id")), "id")


def add_to_album(members: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members afterwards, the rows that were added)."""
    added = new.distinct().join(members, ["album_id", "photo_id"], "left_anti")
    return members.unionByName(added), added


def remove_from_album(members: DataFrame, gone: DataFrame) -> DataFrame:
    return members.join(gone, ["album_id", "photo_id"], "left_anti")


def purge_orphans(members: DataFrame, photos: DataFrame) -> DataFrame:
    return members.join(photos.select(F.col("id").alias("photo_id")), "photo_id", "left_semi").select(*members.columns)


def create_album(albums: DataFrame, name: str) -> DataFrame:
    """Albums with one more, whose id is the next."""
    new = albums.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).cast(albums.schema["id"].dataType).alias("id")).withColumn("name", F.lit(name))
    return albums.select("id", "name").unionByName(new)


#: Persons have ids and names as albums do.
create_person = create_album


def rename_person(persons: DataFrame, person_id: int, name: str) -> DataFrame:
    return persons.withColumn("name", F.when(F.col("id") == person_id, name).otherwise(F.col("name")))


def delete_person(persons: DataFrame, person_id: int) -> DataFrame:
    return persons.where(F.col("id") != person_id)


def named_like(persons: DataFrame, text: str) -> DataFrame:
    """Persons whose name holds a text, whatever its case."""
    return persons.where(F.contains(F.lower("name"), F.lit(text.lower())))


def delete_album(albums: DataFrame, members: DataFrame, album_id: int) -> tuple[DataFrame, DataFrame]:
    return albums.where(F.col("id") != album_id), members.where(F.col("album_id") != album_id)


# --- changes --------------------------------------------------------------


def upsert(photos: DataFrame, scanned: DataFrame) -> DataFrame:
    """Photos after a scan: scanned columns are new, user columns stay; one shuffle on path."""
    old, new = photos.alias("old"), scanned.alias("new")
    joined = old.join(new, F.col("old.path") == F.col("new.path"), "full_outer")

    def pick(c: str) -> Column:
        if c not in scanned.columns:
            return F.col(f"old.{c}")
        if c in USER_COLUMNS:
            return F.coalesce(f"old.{c}", f"new.{c}")
        return F.when(F.col("new.path").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}"))

    return joined.select(*(pick(c).alias(c) for c in photos.columns))


def rename_folder(photos: DataFrame, old: str, new: str) -> DataFrame:
    return photos.withColumns({"path": C.moved("path", old, new), "directory": C.moved("directory", old, new)})


def rename_photo(photos: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """(photos with the new path, one row that says if any was renamed)."""
    hit = F.col("path") == old
    folder, name = new.rsplit("/", 1)
    renamed = photos.withColumns({"path": F.when(hit, new).otherwise(F.col("path")), "directory": F.when(hit, folder).otherwise(F.col("directory")), "filename": F.when(hit, name).otherwise(F.col("filename"))})
    return renamed, photos.agg((F.count_if(hit) > 0).alias("changed"))


def set_rating(photos: DataFrame, ids: DataFrame, stars: int) -> DataFrame:
    return _where_id(photos, ids, "rating", F.greatest(F.lit(0), F.least(F.lit(5), F.lit(stars))).cast("long"))


def set_favorite(photos: DataFrame, ids: DataFrame, value: bool) -> DataFrame:
    return _where_id(photos, ids, "is_favorite", F.lit(value))


def set_tags(photos: DataFrame, ids: DataFrame, tags: list[str]) -> DataFrame:
    return _where_id(photos, ids, "tags", C.normal_tags(F.array(*map(F.lit, tags)).cast("array<string>")))


def tag(photos: DataFrame, ids: DataFrame, new: list[str]) -> DataFrame:
    return _where_id(photos, ids, "tags", C.add_tags("tags", new))


def untag(photos: DataFrame, ids: DataFrame, gone: str) -> DataFrame:
    return _where_id(photos, ids, "tags", F.filter("tags", lambda t: t != gone))


def _where_id(photos: DataFrame, ids: DataFrame, column: str, value: Column) -> DataFrame:
    marked = photos.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return marked.withColumn(column, F.when(F.col("__hit"), value).otherwise(F.col(column))).select(*photos.columns)


def delete_photos(photos: DataFrame, members: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Photos without those of ids, lone duplicates released; album rows without them."""
    left = photos.join(ids, "id", "left_anti").select(*photos.columns)
    return dissolve_singletons(left), members.join(ids.select(F.col("id").alias("photo_id")), "photo_id", "left_anti").select(*members.columns)


def without_assets(photos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(photos kept, paths purged)."""
    return photos.where(~C.in_assets("path")), photos.where(C.in_assets("path")).select("path")


def normalise_paths(photos: DataFrame) -> DataFrame:
    """Backslashes and repeated separators become one '/'; of equal paths the lowest id stays."""
    tidy = F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "/+", "/")
    first = F.row_number().over(Window.partitionBy("path").orderBy("id"))
    return photos.withColumn("path", tidy).withColumn("__n", first).where("__n = 1").drop("__n")


def backfill_media_type(photos: DataFrame) -> DataFrame:
    return photos.withColumn("media_type", F.when(C.is_video("path"), "video").otherwise(F.coalesce("media_type", F.lit("image"))))


# --- duplicate groups -----------------------------------------------------


def dissolve_singletons(photos: DataFrame) -> DataFrame:
    """Groups of fewer than two photos are no groups. Photos outside groups take no part in the shuffle by group."""
    sizes = photos.where("duplicate_group_id is not null").groupBy("duplicate_group_id").agg(F.count("*").alias("__n")).where("__n > 1").select("duplicate_group_id", F.lit(True).alias("__ok"))
    return photos.join(sizes, "duplicate_group_id", "left").withColumn("duplicate_group_id", F.when(F.col("__ok"), F.col("duplicate_group_id"))).select(*photos.columns)


def group_members(photos: DataFrame) -> DataFrame:
    grouped = photos.where("duplicate_group_id is not null")
    return grouped.groupBy("duplicate_group_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("members")).where("n > 1")


def conflicting_groups(photos: DataFrame) -> DataFrame:
    """Groups that hold photos of more than one known date."""
    return photos.where("duplicate_group_id is not null").groupBy("duplicate_group_id").agg(F.countDistinct("date_taken").alias("n_dates")).where("n_dates > 1")


def assign_groups(photos: DataFrame, assignments: DataFrame) -> DataFrame:
    """assignments: (id, gid); a null gid takes a photo out of its group."""
    marked = photos.join(assignments.select("id", F.col("gid"), F.lit(True).alias("__hit")), "id", "left")
    return dissolve_singletons(marked.withColumn("duplicate_group_id", F.when(F.col("__hit"), F.col("gid")).otherwise(F.col("duplicate_group_id"))).select(*photos.columns))


def count_groups(photos: DataFrame) -> DataFrame:
    return photos.agg(F.countDistinct("duplicate_group_id").alias("n_groups"), F.count("duplicate_group_id").alias("n_photos"))


def group_assignments(photos: DataFrame) -> DataFrame:
    return photos.where("duplicate_group_id is not null").select("path", "duplicate_group_id")


def members_of_group(photos: DataFrame, group_id: int) -> DataFrame:
    return photos.where(F.col("duplicate_group_id") == group_id).orderBy(F.coalesce("date_taken", "mtime_ts"), "filename")


def known_dates(photos: DataFrame, taken: str = "date_taken") -> DataFrame:
    """(path, taken): dates from their text; null where it is none."""
    return photos.select("path", F.try_to_timestamp(F.col(taken)).cast("timestamp_ntz").alias("taken"))


def ignore_group(photos: DataFrame, group_id: int) -> DataFrame:
    return photos.withColumn("duplicate_group_id", F.when(F.col("duplicate_group_id") != group_id, F.col("duplicate_group_id")))


def apply_detection(photos: DataFrame, found: DataFrame, seed: DataFrame, ignored: DataFrame) -> DataFrame:
    """Photos after a detection pass: found (path, gid) without ignored paths is set, and paths of the seed that it no longer has leave their groups."""
    kept = found.join(ignored.select("path"), "path", "left_anti")
    stale = seed.select("path").distinct().join(kept, "path", "left_anti").select("path", F.lit(None).cast("long").alias("gid"))
    ids = photos.select("id", "path").join(kept.select("path", "gid").unionByName(stale), "path").select("id", "gid")
    return assign_groups(photos, ids)


def folder_order(folders: DataFrame, by_time: bool = False, descending: bool = False) -> DataFrame:
    """Folders (path, mtime) by the last part of their path, or by time."""
    key = F.coalesce("mtime", F.lit(0.0)) if by_time else F.lower(F.coalesce(F.nullif(F.element_at(F.split("path", "/"), -1), F.lit("")), F.col("path")))
    return folders.orderBy(key.desc() if descending else key.asc(), "path")


def last_used(cache: DataFrame, keep: int) -> DataFrame:
    """The rows (key, used_at) of a cache that stay: those used last."""
    return cache.orderBy(F.col("used_at").desc(), "key").limit(keep)


def sorted_view(photos: DataFrame, by_name: bool = False, descending: bool = False) -> DataFrame:
    """A view in order of name, whatever the case, or of date; photos without a date come first."""
    key = F.lower("filename") if by_name else F.coalesce("date_taken", "mtime_ts")
    return photos.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "id")


def moved_cache(cache: DataFrame, old: str, new: str) -> DataFrame:
    """Cached rows (key, path, ...) after a folder moved; keys follow from paths."""
    return cache.withColumn("path", C.moved("path", old, new)).withColumn("key", C.cache_key("path"))


def purged_paths(outcomes: DataFrame) -> DataFrame:
    """Paths that may go from the catalog: files that are in the trash now, or were missing already. outcomes: (path, trashed, missing)."""
    return outcomes.where(F.col("trashed") | F.col("missing")).select("path")


def of_current_generation(results: DataFrame, generations: DataFrame) -> DataFrame:
    """Scan results of folders whose scan was not started anew meanwhile. generations: (directory, generation)."""
    return results.join(generations.select("directory", "generation"), ["directory", "generation"], "left_semi")


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two listings: appeared or disappeared."""
    b, a = before.select("path", F.lit(True).alias("__b")), after.select("path", F.lit(True).alias("__a"))
    return b.join(a, "path", "full_outer").where("__a is null or __b is null").select("path", F.when(F.col("__b").isNull(), "appeared").otherwise("disappeared").alias("change"))
