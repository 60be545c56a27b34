"""Queries of changes to the catalog, its caches, edit histories and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.functions import columns as C
from shutterlake.operators import catalog as K, history as H, indexing as I
from shutterlake.plans.base import query
from shutterlake.sources import files as S, snapshots as N

# --- photos ---------------------------------------------------------------

query("favorites_set", ("photos",), "SELECT id, CASE WHEN rating=5 THEN TRUE ELSE is_favorite END AS is_favorite FROM photos")(lambda p: K.set_favorite(p, p.where("rating = 5"), True).select("id", "is_favorite"))
query("tags_replaced", ("photos",), "SELECT id, CASE WHEN rating=5 THEN 'mer,ski' ELSE array_to_string(tags, ',') END AS tags FROM photos")(lambda p: K.set_tags(p, p.where("rating = 5"), [" mer", "ski ", "mer", "a,b", ""]).select("id", F.array_join("tags", ",").alias("tags")))
query("photo_renamed", ("photos",), "SELECT id, CASE WHEN id=7 THEN '/new/place/x.jpg' ELSE path END AS path, CASE WHEN id=7 THEN 'x.jpg' ELSE filename END AS filename, CASE WHEN id=7 THEN '/new/place' ELSE directory END AS directory FROM photos")(
    lambda p: K.rename_photo(p, p.where("id = 7").first().path, "/new/place/x.jpg")[0].select("id", "path", "filename", "directory")
)
query("photo_rename_changed", ("photos",), "SELECT FALSE AS changed")(lambda p: K.rename_photo(p, "/no/such.jpg", "/new/x.jpg")[1])
_ASSETS = "CASE WHEN id%9=0 THEN replace(path, '/IMG_', '/film_assets/IMG_') WHEN id%9=1 THEN replace(path, 'IMG_', 'x_assets_') ELSE path END"


def _with_assets(p):
    i = F.col("id") % 9
    return p.withColumn("path", F.when(i == 0, F.replace("path", F.lit("/IMG_"), F.lit("/film_assets/IMG_"))).when(i == 1, F.replace("path", F.lit("IMG_"), F.lit("x_assets_"))).otherwise(F.col("path")))


query("asset_folders_purged", ("photos",), f"SELECT {_ASSETS} AS path FROM photos WHERE id%9=0")(lambda p: K.without_assets(_with_assets(p))[1])
query("asset_folders_kept", ("photos",), f"SELECT id, {_ASSETS} AS path FROM photos WHERE id%9<>0")(lambda p: K.without_assets(_with_assets(p))[0].select("id", "path"))
query("paths_normalised", ("photos",), "SELECT id, path FROM photos WHERE id%6<>0 UNION ALL SELECT id+500000000, '/twice'||path FROM photos WHERE id%6=0")(
    lambda p: K.normalise_paths(
        p.where("id % 6 <> 0").withColumn("path", F.replace("path", F.lit("/"), F.when(F.col("id") % 2 == 0, "\\").otherwise("//"))).select("id", "path")
        .unionByName(p.where("id % 6 <> 0").select((F.col("id") + 900_000_000).alias("id"), "path"))
        .unionByName(p.where("id % 6 = 0").select((F.col("id") + 500_000_000).alias("id"), F.concat(F.lit("//twice"), "path").alias("path")))
    )
)
query("photos_after_delete", ("photos", "album_photos"), "SELECT id, CASE WHEN count(*) OVER (PARTITION BY duplicate_group_id) > 1 THEN duplicate_group_id END AS duplicate_group_id FROM photos WHERE id%6<>0")(lambda p, m: K.delete_photos(p, m, p.where("id % 6 = 0").select("id"))[0].select("id", "duplicate_group_id"))
query("chronological_order", ("photos",), "SELECT id FROM photos ORDER BY coalesce(date_taken, mtime_ts), id LIMIT 300 OFFSET 300")(lambda p: K.page(p, 300, 300, F.coalesce("date_taken", "mtime_ts"), "id").select("id"))
query("folder_order_names", ("photos",), "SELECT DISTINCT directory AS path FROM photos ORDER BY lower(split_part(directory, '/', 5)) DESC, directory LIMIT 10")(lambda p: K.folder_order(p.select(F.col("directory").alias("path"), F.lit(0.0).alias("mtime")).distinct(), descending=True).limit(10).select("path"))
query("folder_order_times", ("photos",), "SELECT directory AS path FROM photos GROUP BY 1 ORDER BY max(epoch(mtime_ts)), 1 LIMIT 10")(
    lambda p: K.folder_order(p.groupBy(F.col("directory").alias("path")).agg(F.max(F.unix_timestamp(F.col("mtime_ts").cast("timestamp")).cast("double")).alias("mtime")), by_time=True).limit(10).select("path")
)
query("cache_last_used", ("photos",), "SELECT path AS key FROM photos ORDER BY mtime_ts DESC, path LIMIT 300")(lambda p: K.last_used(p.select(F.col("path").alias("key"), F.col("mtime_ts").alias("used_at")), 300).select("key"))
query("vanished_files", ("photos",), "SELECT path FROM photos WHERE id%8=0")(lambda p: p.join(p.where("id % 8 <> 0").select("path"), "path", "left_anti").select("path"))

# --- albums and persons ---------------------------------------------------

query("album_created", ("albums",), "SELECT id, name FROM albums UNION ALL SELECT max(id)+1, 'Summer' FROM albums")(lambda a: K.create_album(a, "Summer"))
query("album_deleted", ("albums", "album_photos"), "SELECT album_id, photo_id FROM album_photos WHERE album_id<>3")(lambda a, m: K.delete_album(a, m, 3)[1])
query("albums_after_delete", ("albums", "album_photos"), "SELECT id, name FROM albums WHERE id<>3")(lambda a, m: K.delete_album(a, m, 3)[0])
query("album_photos_removed", ("album_photos",), "SELECT album_id, photo_id FROM album_photos WHERE NOT (album_id=2 AND photo_id%2=0)")(lambda m: K.remove_from_album(m, m.where("album_id = 2 AND photo_id % 2 = 0")).select("album_id", "photo_id"))
query("album_added_count", ("album_photos",), "SELECT count(*) AS n FROM (SELECT photo_id FROM album_photos WHERE album_id=2 EXCEPT SELECT photo_id FROM album_photos WHERE album_id=1)")(lambda m: K.add_to_album(m, m.where("album_id = 2").select(F.lit(1).cast("long").alias("album_id"), "photo_id"))[1].agg(F.count("*").alias("n")))
query("person_created", ("persons",), "SELECT id, name FROM persons UNION ALL SELECT max(id)+1, 'Zoë' FROM persons")(lambda p: K.create_person(p, "Zoë"))
query("person_renamed", ("persons",), "SELECT id, CASE WHEN id=5 THEN 'Max' ELSE name END AS name FROM persons")(lambda p: K.rename_person(p, 5, "Max"))
query("person_deleted", ("persons",), "SELECT id, name FROM persons WHERE id<>5")(lambda p: K.delete_person(p, 5))
query("persons_named_like", ("persons",), "SELECT id, name FROM persons WHERE name ILIKE '%00001%'")(lambda p: K.named_like(p, "00001"))

# --- duplicate groups -----------------------------------------------------

query("duplicate_group_count", ("photos",), "SELECT count(DISTINCT duplicate_group_id) AS n_groups, count(duplicate_group_id) AS n_photos FROM photos")(K.count_groups)
query("duplicate_assignments", ("photos",), "SELECT path, duplicate_group_id FROM photos WHERE duplicate_group_id IS NOT NULL")(K.group_assignments)
query("duplicate_group_view", ("photos",), "SELECT id, path FROM photos WHERE duplicate_group_id=3")(lambda p: K.members_of_group(p, 3).select("id", "path"))
query("duplicate_dates", ("photos",), "SELECT path, CASE WHEN id%4<>0 THEN date_trunc('second', date_taken) END AS taken FROM photos")(
    lambda p: K.known_dates(p.withColumn("date_taken", F.when(F.col("id") % 4 == 0, "some day").otherwise(F.date_format("date_taken", "yyyy-MM-dd'T'HH:mm:ss"))))
)
query("duplicate_group_ignored", ("photos",), "SELECT id, CASE WHEN duplicate_group_id<>3 THEN duplicate_group_id END AS duplicate_group_id FROM photos")(lambda p: K.ignore_group(p, 3).select("id", "duplicate_group_id"))
query("duplicate_detection_applied", ("photos",), """WITH n AS (SELECT id, CASE WHEN id%21=0 AND id%5<>0 THEN id//210 WHEN duplicate_group_id IS NOT NULL AND id%2=0 THEN NULL ELSE duplicate_group_id END AS g FROM photos)
 SELECT id, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 THEN CAST(g AS BIGINT) END AS duplicate_group_id FROM n""")(
    lambda p: K.apply_detection(p, p.where("id % 21 = 0").select("path", F.floor(F.col("id") / 210).cast("long").alias("gid")), p.where("duplicate_group_id is not null and id % 2 = 0"), p.where("id % 5 = 0")).select("id", "duplicate_group_id")
)
query("area_window_needed", ("photos",), """WITH a AS (SELECT id, width*height AS area, id%50=0 AS fresh FROM photos WHERE duplicate_group_id IS NOT NULL)
 SELECT DISTINCT o.id FROM a o JOIN a n ON n.fresh AND o.id<>n.id WHERE greatest(o.area, n.area) <= 1.2*least(o.area, n.area)""")(
    lambda p: _needed(p.where("duplicate_group_id is not null").select("id", (F.col("width") * F.col("height")).alias("area"), (F.col("id") % 50 == 0).alias("fresh")))
)


def _needed(areas):
    from shutterlake.operators import blocks

    return blocks.near_any(areas.where("fresh"), areas, 1.2)


# --- caches ---------------------------------------------------------------

_CACHE = "SELECT path, 'old' AS value FROM photos WHERE id%2=0"


def _cache(p):
    return p.where("id % 2 = 0").select("path", F.lit("old").alias("value"))


query("cache_upsert", ("photos",), f"SELECT path, 'new' AS value FROM photos WHERE id%3=0 UNION ALL SELECT path, 'old' FROM photos WHERE id%2=0 AND id%3<>0")(lambda p: N.newest(_cache(p), p.where("id % 3 = 0").select("path", F.lit("new").alias("value")), "path"))
query("cache_removed", ("photos",), f"{_CACHE} AND id%10<>0")(lambda p: N.without(_cache(p), p.where("id % 10 = 0"), "path"))
query("cache_purged", ("photos",), f"SELECT 'features' AS name, path FROM photos WHERE id%3=0 AND rating>0 UNION ALL SELECT 'prints', path FROM photos WHERE id%2=0 AND rating>0")(
    lambda p: _named(N.keep_known({"prints": _cache(p), "features": p.where("id % 3 = 0").select("path", F.lit(1).alias("value"))}, p.where("rating > 0")))
)
query("cache_purge_counts", ("photos",), "SELECT 'features' AS name, count(*) AS n FROM photos WHERE id%3=0 AND rating=0 UNION ALL SELECT 'prints', count(*) FROM photos WHERE id%2=0 AND rating=0")(
    lambda p: N.purge_counts({"prints": _cache(p), "features": p.where("id % 3 = 0").select("path")}, p.where("rating > 0"))
)
query("cached_paths", ("photos",), "SELECT path FROM photos WHERE id%2=0 OR id%3=0")(lambda p: N.all_keys([_cache(p), p.where("id % 3 = 0")], "path"))


def _named(tables):
    parts = [t.select(F.lit(n).alias("name"), "path") for n, t in sorted(tables.items())]
    return parts[0].unionByName(parts[1])


# --- edits and journals ---------------------------------------------------


def _edits(h):
    current = h.where("id % 3 = 0").select("photo", "state_json").dropDuplicates(["photo"]).withColumn("state_json", F.lit("now"))
    return current, h.select("photo", "id", "operation", "state_json", "created_at")


query("edit_saved_current", ("edit_history",), "SELECT DISTINCT photo, CASE WHEN photo%4=0 THEN 'saved' ELSE 'now' END AS state_json FROM edit_history WHERE photo%4=0 OR (photo%4 IN (2, 3) AND photo IN (SELECT photo FROM edit_history WHERE id%3=0))")(lambda h: H.save_edit(*_edits(h), _new_edits(h))[0])
query("edit_saved_history", ("edit_history",), """WITH n AS (SELECT id, photo FROM edit_history UNION ALL SELECT 1000000000+photo, photo FROM (SELECT DISTINCT photo FROM edit_history WHERE photo%4<2))
 SELECT id, photo FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY id DESC) AS r FROM n) WHERE r<=50""")(lambda h: H.save_edit(*_edits(h), _new_edits(h))[1].select("id", "photo"))


def _new_edits(h):
    """One edit of each photo with photo % 4 < 2; those of photo % 4 = 1 change nothing."""
    return h.select("photo").distinct().where("photo % 4 < 2").select(
        "photo", (F.col("photo") % 4 == 0).alias("modified"), (F.col("photo") + 1_000_000_000).alias("id"), F.lit("save").alias("operation"), F.lit("saved").alias("state_json"), F.lit(None).cast("timestamp_ntz").alias("created_at")
    )


query("edit_deleted", ("edit_history",), "SELECT id, photo FROM edit_history WHERE photo%5<>0")(lambda h: H.delete_edits(*_edits(h), h.where("photo % 5 = 0"))[1].select("id", "photo"))
query("edit_renamed", ("edit_history",), "SELECT id, CASE WHEN photo=7 THEN -7 ELSE photo END AS photo FROM edit_history")(lambda h: H.rename_edits(*_edits(h), 7, -7)[1].select("id", "photo"))
query("edit_history_pushed", ("edit_history",), """WITH n AS (SELECT id, photo FROM edit_history UNION ALL SELECT 2000000000+photo, photo FROM (SELECT DISTINCT photo FROM edit_history WHERE photo%4<2))
 SELECT id, photo FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY id DESC) AS r FROM n) WHERE r<=10""")(lambda h: H.push_history(_edits(h)[1], _new_edits(h).withColumn("id", F.col("photo") + 2_000_000_000), 10).select("id", "photo"))
query("journal_rotated", ("journal",), "SELECT id FROM journal ORDER BY ts DESC, id DESC LIMIT 400")(lambda j: S.rotated(j.withColumn("ts", F.struct("ts", "id")), 800, 400).select("id"))
query("thread_order", ("journal",), "SELECT thread, count(*) AS n FROM journal GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")(lambda j: j.groupBy("thread").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "thread").limit(3))

# --- indexing -------------------------------------------------------------


def _errors(p):
    return p.where("id % 5 = 0").select("path", F.lit("crash").alias("error_type"), F.lit(1.0).alias("last_attempt"), (F.col("id") % 10 == 0).alias("excluded"))


_ERRORS = "SELECT path, id, 'crash' AS error_type, 1.0 AS last_attempt, id%10=0 AS excluded FROM photos WHERE id%5=0"
query("index_errors_listed", ("photos",), "SELECT path FROM photos WHERE id%5=0 AND id%10<>0")(lambda p: I.errors_of(_errors(p), excluded=False).select("path"))
query("index_errors_marked", ("photos",), """SELECT path, CASE WHEN id%15=0 OR id%7=0 THEN 'timeout' ELSE 'crash' END AS error_type, id%10=0 AS excluded FROM photos WHERE id%5=0 OR id%7=0""".replace("id%15=0 OR ", "").replace("id%10=0 AS", "(id%10=0) AS"))(
    lambda p: I.mark_errors(_errors(p), p.where("id % 7 = 0").select("path", F.lit("timeout").alias("error_type"), F.lit(2.0).alias("last_attempt"), F.lit(False).alias("excluded"))).select("path", "error_type", "excluded")
)
query("index_exclusions_set", ("photos",), "SELECT path, CASE WHEN id%5=0 THEN 'crash' ELSE 'excluded' END AS error_type, id%7=0 OR id%10=0 AS excluded FROM photos WHERE id%5=0 OR id%7=0")(lambda p: I.set_excluded(_errors(p), p.where("id % 7 = 0"), True, 3.0).select("path", "error_type", "excluded"))
query("index_exclusions_lifted", ("photos",), "SELECT path, id%10=0 AND id%7<>0 AS excluded FROM photos WHERE id%5=0")(lambda p: I.set_excluded(_errors(p), p.where("id % 7 = 0"), False, 3.0).select("path", "excluded"))
query("export_names", ("photos",), """WITH p AS (SELECT id, CASE WHEN media_type='video' THEN 'v' ELSE 'IMG_'||(id%1000) END AS stem FROM photos), t AS (SELECT *, stem||'.jpg' IN (SELECT 'IMG_'||(id%1000)||'.jpg' FROM photos WHERE id<100) AS taken, row_number() OVER (PARTITION BY stem ORDER BY id) AS r FROM p)
 SELECT id, CASE WHEN r = 1 AND NOT taken THEN stem||'.jpg' ELSE stem||'_'||(CASE WHEN taken THEN r ELSE r-1 END)||'.jpg' END AS name FROM t""")(
    lambda p: I.export_names(p.select("id", F.concat(F.when(F.col("media_type") == "video", "v").otherwise(F.concat(F.lit("IMG_"), (F.col("id") % 1000).cast("string"))), F.lit(".jpg")).alias("filename")), p.where("id < 100").select(F.concat(F.lit("IMG_"), (F.col("id") % 1000).cast("string"), F.lit(".jpg")).alias("name")))
)
query("duplicate_report_rows", ("photos",), """SELECT printf('<tr><td>%d</td><td>%d</td><td><ul>%s</ul></td></tr>', duplicate_group_id, count(*), string_agg(printf('<li>%s (%d x %d)</li>', path, width, height), '' ORDER BY path)) AS html FROM photos WHERE duplicate_group_id IS NOT NULL GROUP BY duplicate_group_id HAVING count(*)>1""")(I.duplicate_report)
query("dvd_folders", ("photos",), "SELECT DISTINCT directory AS folder FROM photos WHERE id%30=0")(lambda p: S.dvd_folders(p.select(F.concat("directory", F.when(F.col("id") % 30 == 0, "/Video_Ts/").otherwise("/VIDEO/"), "filename").alias("path"))))
query("video_extensions", ("photos",), "SELECT id, id%3<>1 AS video FROM photos")(lambda p: p.select("id", C.is_video(F.concat("path", F.when(F.col("id") % 3 == 0, ".VOB").when(F.col("id") % 3 == 1, ".tsx").otherwise(".mkv"))).alias("video")))
query("names_descending", ("photos",), "SELECT id FROM photos ORDER BY lower(filename) DESC, id LIMIT 100")(lambda p: K.sorted_view(p, by_name=True, descending=True).limit(100).select("id"))
query("dates_descending", ("photos",), "SELECT id FROM photos ORDER BY coalesce(date_taken, mtime_ts) DESC, id LIMIT 100")(lambda p: K.sorted_view(p, descending=True).limit(100).select("id"))
query("thumbnails_moved", ("photos",), "SELECT id, CASE WHEN starts_with(path, '/lib/ASIA/') THEN md5('/arch'||substr(path, 10)) ELSE md5(path) END AS key FROM photos")(lambda p: K.moved_cache(p.select("id", "path"), "/lib/ASIA", "/arch").select("id", "key"))
query("trash_purged", ("photos",), "SELECT path FROM photos WHERE id%3=0 OR id%7=0")(lambda p: K.purged_paths(p.select("path", (F.col("id") % 3 == 0).alias("trashed"), (F.col("id") % 7 == 0).alias("missing"))))
query("stale_scans_dropped", ("photos",), "SELECT id FROM photos WHERE NOT (contains(directory, 'ASIA') AND id%2=0) AND NOT (NOT contains(directory, 'ASIA') AND id%2=1)")(
    lambda p: K.of_current_generation(p.select("id", "directory", (F.col("id") % 2).alias("generation")), p.select("directory", F.when(F.contains(F.col("directory"), F.lit("ASIA")), 1).otherwise(0).cast("long").alias("generation")).distinct()).select("id")
)
query("index_outcomes", ("photos",), "SELECT path, 3 AS face_count FROM photos WHERE id%4=1")(lambda p: I.index_outcomes(_outcomes(p), _errors(p))[0].select("path", "face_count"))
query("index_outcome_errors", ("photos",), "SELECT path, CASE WHEN id%4=3 THEN 'timeout' ELSE 'crash' END AS error_type FROM photos WHERE id%4=3 OR (id%5=0 AND id%4<>1)")(lambda p: I.index_outcomes(_outcomes(p), _errors(p))[1].select("path", "error_type"))


def _outcomes(p):
    """Photos of an odd id were tried; every other one of them failed."""
    return p.where("id % 2 = 1").select("path", F.when(F.col("id") % 4 == 3, "timeout").alias("error_type"), F.lit(3).alias("n_faces"), F.lit(0).alias("rotation"), F.lit(9.0).alias("at"))
