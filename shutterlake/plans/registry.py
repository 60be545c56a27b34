"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shutterlake.functions import columns as C
from shutterlake.operators import catalog as K, clustering as G, faces as P, history as H
from shutterlake.plans.base import ORACLE_SQL, QUERIES, query as _query
from shutterlake.sources import adapters as A

FLAGSHIP = "photos_search_advanced"
_IOU = "(CASE WHEN {a}.w*{a}.h+{b}.w*{b}.h-{o}>0 THEN CAST({o} AS DOUBLE)/({a}.w*{a}.h+{b}.w*{b}.h-{o}) ELSE 0 END)"
_OVERLAP = "(greatest(least({a}.x+{a}.w,{b}.x+{b}.w)-greatest({a}.x,{b}.x),0)*greatest(least({a}.y+{a}.h,{b}.y+{b}.h)-greatest({a}.y,{b}.y),0))"


def _iou(a: str, b: str) -> str:
    return _IOU.format(a=a, b=b, o=_OVERLAP.format(a=a, b=b))


CRITERIA = K.Search(date_from="1994-01-01", date_to="1996-12-31", camera="canon m", directory="/lib/EUROPE", min_rating=2, tags=("vacances",))

# --- search and views -----------------------------------------------------

_query(FLAGSHIP, ("photos",), """SELECT id, path, rating, coalesce(date_taken, mtime_ts) AS effective_date FROM photos WHERE coalesce(date_taken, mtime_ts) >= TIMESTAMP '1994-01-01'
 AND coalesce(date_taken, mtime_ts) < TIMESTAMP '1997-01-01' AND contains(lower(camera_make||' '||camera_model), 'canon m') AND (directory='/lib/EUROPE' OR starts_with(directory, '/lib/EUROPE/'))
 AND rating>=2 AND list_contains(tags, 'vacances')""")(lambda p: K.search(p, CRITERIA).select("id", "path", "rating", F.coalesce("date_taken", "mtime_ts").alias("effective_date")))
_query("photos_text_search", ("photos",), "SELECT id, filename FROM photos WHERE contains(lower(filename), 'nik') OR contains(lower(coalesce(camera_make,'')), 'nik') OR contains(lower(camera_model), 'nik')")(lambda p: K.text_search(p, "Nik").select("id", "filename"))
_query("photos_by_tag", ("photos",), "SELECT id FROM photos WHERE list_contains(tags, 'vacances')")(lambda p: K.by_tag(p, "VACANCES").select("id"))
_query("photos_in_folder", ("photos",), "SELECT id, path FROM photos WHERE split_part(path, '/', 4)='NATION_10' AND split_part(path, '/', 5)='BUILDING'")(lambda p: K.in_folder(p, "/lib/AFRICA/NATION_10/BUILDING").select("id", "path"))
_query("photos_in_folder_recursive", ("photos",), "SELECT id, path FROM photos WHERE directory='/lib/ASIA' OR starts_with(directory,'/lib/ASIA/')")(lambda p: K.in_folder(p, "/lib/ASIA", True).select("id", "path"))
_query("photos_min_rating", ("photos",), "SELECT id, rating FROM photos WHERE rating>=4")(lambda p: K.min_rating(p, 4).select("id", "rating"))
_query("photos_of_album", ("photos", "album_photos"), "SELECT p.id, p.path FROM photos p JOIN album_photos a ON a.photo_id=p.id WHERE album_id=2")(lambda p, m: K.album_view(p, m, 2).select("id", "path"))
_query("favorites", ("photos",), "SELECT id FROM photos WHERE is_favorite")(lambda p: p.where("is_favorite").select("id"))
_query("videos", ("photos",), "SELECT id FROM photos WHERE media_type='video'")(lambda p: p.where("media_type = 'video'").select("id"))
_query("photo_by_path", ("photos",), "SELECT id, path FROM photos WHERE filename='IMG_7.jpg'")(lambda p: p.where("filename = 'IMG_7.jpg'").select("id", "path"))
_query("photos_by_keys", ("photos",), "SELECT id, path FROM photos WHERE id%500=0")(lambda p: K.by_keys(p, p.where("id % 500 = 0")).select("id", "path"))
_query("person_photo_semijoin", ("photos", "faces"), "SELECT id FROM photos WHERE rating>=3 AND id IN (SELECT photo_id FROM faces WHERE person_id=4 AND NOT ignored)")(lambda p, f: K.of_person(K.min_rating(p, 3), f, 4).select("id"))
_query("effective_date_sort_topk", ("photos",), "SELECT id, coalesce(date_taken,mtime_ts) AS effective_date FROM photos ORDER BY 2 DESC, 1 LIMIT 50")(lambda p: K.newest(p, 50).select("id", "effective_date"))
_query("filename_sort_page", ("photos",), "SELECT id, filename FROM photos ORDER BY lower(filename), id LIMIT 200 OFFSET 400")(lambda p: K.page(p, 200, 400, F.lower("filename"), "id").select("id", "filename"))
_query("known_mtimes", ("photos",), "SELECT path, mtime_ts FROM photos WHERE directory='/lib/AFRICA' OR starts_with(directory,'/lib/AFRICA/')")(lambda p: K.known_mtimes(p, "/lib/AFRICA"))


@_query("known_mtimes_antijoin", ("photos",), "SELECT path FROM photos WHERE id%5=0")
def _(p):
    files = p.select("path", F.when(F.col("id") % 5 == 0, F.col("mtime_ts") + F.expr("INTERVAL 5 SECONDS")).otherwise(F.col("mtime_ts") + F.expr("INTERVAL 500 MILLISECONDS")).alias("mtime_ts"))
    return K.changed_files(files, p).select("path")


_query("paths_to_index", ("photos", "faces"), "SELECT path FROM photos WHERE media_type<>'video' AND id%13<>0 AND id NOT IN (SELECT photo_id FROM faces WHERE person_id=1)")(
    lambda p, f: P.to_index(p, p.join(f.where("person_id = 1").select(F.col("photo_id").alias("id")), "id", "left_semi").select("path"), p.where("id % 13 = 0").select("path")).select("path")
)

# --- counters -------------------------------------------------------------

_query("library_stats", ("photos",), "SELECT count(*) AS n_photos, CAST(sum(file_size) AS BIGINT) AS total_size, count(DISTINCT directory) AS n_folders FROM photos")(K.stats)
_query("recursive_folder_counts", ("photos",), """SELECT f AS directory, (SELECT count(*) FROM photos WHERE directory=f OR starts_with(directory, f||'/')) AS n
 FROM (SELECT unnest(['/lib','/lib/ASIA','/lib/EUROPE/FRANCE','/lib/EUROPE/FRANCE/MACHINERY','/nowhere']) AS f)""")(
    lambda p: K.recursive_counts(p, p.sparkSession.createDataFrame([(d,) for d in ("/lib", "/lib/ASIA", "/lib/EUROPE/FRANCE", "/lib/EUROPE/FRANCE/MACHINERY", "/nowhere")], "directory string"))
)
_query("all_tags", ("photos",), "SELECT DISTINCT unnest(tags) AS tag FROM photos")(K.all_tags)
_query("tag_states", ("photos",), "SELECT tag, CASE WHEN count(*)=(SELECT count(*) FROM photos WHERE is_favorite) THEN 'all' ELSE 'some' END AS state FROM (SELECT id, unnest(list_distinct(tags)) AS tag FROM photos WHERE is_favorite) GROUP BY tag")(lambda p: K.tag_states(p.where("is_favorite")))
_query("distinct_cameras", ("photos",), "SELECT DISTINCT trim(concat_ws(' ', camera_make, camera_model)) AS camera FROM photos")(K.cameras)
_query("albums_with_counts", ("albums", "album_photos"), "SELECT id, name, (SELECT count(*) FROM album_photos WHERE album_id=albums.id) AS n_photos FROM albums")(K.album_counts)
_query("clusters_by_size", ("faces",), "SELECT cluster_id, count(*) AS n FROM faces GROUP BY 1")(P.clusters_by_size)
_query("unnamed_clusters", ("faces",), "SELECT cluster_id, count(*) AS n FROM faces WHERE person_id IS NULL AND NOT ignored AND NOT pinned GROUP BY 1")(P.unnamed_clusters)
_query("cluster_persons", ("faces",), "SELECT cluster_id, min(person_id) AS person_id FROM faces WHERE person_id IS NOT NULL GROUP BY 1")(P.cluster_persons)
_query("dominant_person", ("faces",), "SELECT cluster_id, person_id, n FROM (SELECT cluster_id, person_id, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, person_id) AS r FROM faces WHERE person_id IS NOT NULL GROUP BY 1,2) WHERE r=1")(P.dominant_person)
_query("pending_counts", ("faces",), "SELECT suggestion_person_id AS person_id, count(DISTINCT cluster_id) AS n_pending FROM faces WHERE suggestion_person_id IS NOT NULL AND person_id IS NULL AND NOT ignored GROUP BY 1")(P.pending_counts)
_query("suggested_clusters", ("faces",), "SELECT cluster_id, count(*) AS n, max(suggestion_score) AS score FROM faces WHERE suggestion_person_id=3 AND person_id IS NULL AND NOT ignored GROUP BY 1")(lambda f: P.suggested_clusters(f, 3))
_query("clusters_for_person", ("faces",), "SELECT cluster_id, count(*) AS n_faces, count(DISTINCT photo_id) AS n_photos FROM faces WHERE person_id=5 AND NOT ignored GROUP BY 1")(lambda f: P.clusters_for_person(f, 5))
_query("person_photo_counts", ("faces",), "SELECT person_id, count(DISTINCT photo_id) AS n_photos FROM faces WHERE person_id IS NOT NULL AND NOT ignored GROUP BY 1")(P.person_photo_counts)
_query("photos_of_person", ("faces",), "SELECT DISTINCT photo_id FROM faces WHERE person_id=2 AND NOT ignored")(lambda f: P.photos_of_person(f, 2))
_query("photos_of_cluster", ("faces",), "SELECT DISTINCT photo_id FROM faces WHERE cluster_id=17 AND NOT ignored")(lambda f: P.photos_of_cluster(f, 17))
_query("face_stats", ("faces",), "SELECT count(*) AS n_faces, count(DISTINCT photo_id) AS n_photos, count(DISTINCT cluster_id) AS n_clusters, count(person_id) AS n_identified FROM faces")(P.face_stats)
_query("recognition_counters", ("faces",), """SELECT count(*) AS total, count(person_id) AS identified, count(*) FILTER (person_id IS NULL AND NOT ignored) AS unidentified, count(*) FILTER (ignored) AS ignored, count(*) FILTER (pinned) AS pinned,
 count(*) FILTER (suggestion_person_id IS NOT NULL AND person_id IS NULL) AS suggested, count(*) FILTER (cluster_id>=10000000) AS synthetic, count(*) FILTER (cluster_id<0) AS isolated, count(*) FILTER (cluster_id IS NULL) AS unclustered, count(DISTINCT person_id) AS n_persons FROM faces""")(P.recognition_counters)
_COVER = "SELECT person_id, id AS cover_face FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY is_cover DESC, w*h DESC, id) AS r FROM faces WHERE person_id IS NOT NULL AND NOT ignored) WHERE r=1"
_query("enriched_persons", ("faces",), f"""SELECT c.person_id, n_photos, cover_face, coalesce(n_pending, 0) AS n_pending FROM (SELECT person_id, count(DISTINCT photo_id) AS n_photos FROM faces WHERE person_id IS NOT NULL AND NOT ignored GROUP BY 1) c
 LEFT JOIN ({_COVER}) k ON k.person_id=c.person_id LEFT JOIN (SELECT suggestion_person_id AS person_id, count(DISTINCT cluster_id) AS n_pending FROM faces WHERE suggestion_person_id IS NOT NULL AND person_id IS NULL AND NOT ignored GROUP BY 1) q ON q.person_id=c.person_id""")(P.enriched_persons)

# --- windows --------------------------------------------------------------

_query("cover_face_per_person", ("faces",), _COVER)(lambda f: P.cover_faces(f).select("person_id", F.col("id").alias("cover_face")))
_query("representative_face_per_cluster", ("faces",), "SELECT cluster_id, id FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY is_cover DESC, w*h DESC, id) AS r FROM faces WHERE NOT ignored) WHERE r=1")(lambda f: P.representative_faces(f).select("cluster_id", "id"))
_query("set_cover_face", ("faces",), "SELECT id, is_cover FROM (SELECT id, CASE WHEN cluster_id=(SELECT cluster_id FROM faces WHERE id=11) THEN id=11 ELSE is_cover END AS is_cover FROM faces)")(lambda f: P.set_cover(f, 11).select("id", "is_cover"))
_DEDUP = "SELECT id, CASE WHEN person_id IS NOT NULL AND NOT ignored THEN row_number() OVER (PARTITION BY photo_id, person_id, ignored ORDER BY w*h DESC, id) > 1 ELSE ignored END AS ignored FROM {0}"
_query("face_dedup_row_number", ("faces",), _DEDUP.format("faces"))(lambda f: P.dedup_faces(f).select("id", "ignored"))
_query("restore_orphaned_ignored", ("faces",), """SELECT id, CASE WHEN person_id IS NOT NULL AND bool_and(ignored) OVER (PARTITION BY photo_id, person_id) AND row_number() OVER (PARTITION BY photo_id, person_id ORDER BY w*h DESC, id)=1 THEN FALSE ELSE ignored END AS ignored FROM faces""")(lambda f: P.restore_orphans(f).select("id", "ignored"))
_query("auto_ignore_thresholds", ("faces", "photos"), """WITH s AS (SELECT f.id, f.photo_id, f.det_score, least(f.w, f.h) AS side, least(p.width, p.height) AS short FROM faces f LEFT JOIN (SELECT * FROM photos WHERE id%10<>3) p ON p.id=f.photo_id),
 b AS (SELECT *, CASE WHEN short IS NULL THEN 121 ELSE greatest(22, floor(short*0.03)) END AS base FROM s), q AS (SELECT *, CASE WHEN short IS NULL THEN 121 ELSE greatest(base*2, floor(short*0.20)) END AS front FROM b),
 t AS (SELECT *, min(side) FILTER (side >= front) OVER (PARTITION BY photo_id) AS least_front FROM q)
 SELECT id, side < (CASE WHEN least_front IS NOT NULL THEN least_front*0.25 ELSE base END) OR det_score < 0.65 AS auto_ignored FROM t""")(lambda f, p: P.auto_ignore(f, p.where("id % 10 <> 3").select(F.col("id").alias("photo_id"), "width", "height")).select("id", "auto_ignored"))
_query("edit_history_cap50", ("edit_history",), "SELECT id, photo FROM (SELECT *, row_number() OVER (PARTITION BY photo ORDER BY id DESC) AS r FROM edit_history) WHERE r<=50")(lambda h: H.capped(h).select("id", "photo"))
_query("edit_history_latest20", ("edit_history",), "SELECT id, operation FROM edit_history WHERE photo=7 ORDER BY id DESC LIMIT 20")(lambda h: H.latest(h, 7).select("id", "operation"))
_query("journal_thread_report", ("journal",), """SELECT *, CASE WHEN coalesce(max_ms,0)>=2000 OR errors>0 THEN 'critical' WHEN coalesce(max_ms,0)>=500 THEN 'slow' ELSE 'ok' END AS severity FROM
 (SELECT thread, count(*) FILTER (event='END') AS runs, round(avg(elapsed_ms) FILTER (event='END'), 6) AS avg_ms, max(elapsed_ms) FILTER (event='END') AS max_ms, count(*) FILTER (event='ERROR') AS errors, arg_max(event, (ts, id)) AS last_event FROM journal GROUP BY thread)""")(H.thread_report)
_query("journal_step_deltas", ("journal",), """SELECT thread, count(*) AS n, round(avg(gap), 3) AS mean_ms, round(max(gap), 3) AS max_ms FROM (SELECT thread, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY thread ORDER BY ts, id)))/1000.0 AS gap FROM journal WHERE event='STEP') WHERE gap IS NOT NULL GROUP BY 1""")(H.step_deltas)
_query("journal_slowest5", ("journal",), "SELECT thread, CAST(place AS INTEGER) AS place, id, elapsed_ms FROM (SELECT *, row_number() OVER (PARTITION BY thread ORDER BY elapsed_ms DESC, id) AS place FROM journal WHERE event='END') WHERE place<=5")(H.slowest)
_query("journal_first_errors", ("journal",), "SELECT id, thread FROM journal WHERE event='ERROR' ORDER BY ts, id LIMIT 5")(lambda j: H.first_errors(j).select("id", "thread"))
_query("journal_tail", ("journal",), "SELECT id FROM journal ORDER BY ts DESC, id DESC LIMIT 100")(lambda j: H.tail(j, 100).select("id"))
_query("debounce_sessions", ("journal",), """WITH g AS (SELECT thread, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY thread ORDER BY ts) + INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS new FROM journal),
 s AS (SELECT thread, ts, sum(new) OVER (PARTITION BY thread ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT thread, min(ts) AS start, count(*) AS n FROM s GROUP BY thread, s""")(lambda j: H.sessions(j, "thread", gap="10 minutes"))

# --- changes --------------------------------------------------------------


@_query("upsert_preserve_user_columns", ("photos",), "SELECT id, path, CASE WHEN id%3=0 THEN file_size+1 ELSE file_size END AS file_size, rating, is_favorite FROM photos UNION ALL SELECT id+100000000, path||'.new', file_size+1, 0, FALSE FROM photos WHERE id%50=0")
def _(p):
    again = p.where("id % 3 = 0").withColumns({"file_size": F.col("file_size") + 1, "rating": F.lit(0).cast("long"), "is_favorite": F.lit(False)})
    new = p.where("id % 50 = 0").withColumns({"id": F.col("id") + 100_000_000, "path": F.concat("path", F.lit(".new")), "file_size": F.col("file_size") + 1, "rating": F.lit(0).cast("long"), "is_favorite": F.lit(False)})
    return K.upsert(p, again.unionByName(new)).select("id", "path", "file_size", "rating", "is_favorite")


_query("rename_prefix", ("photos",), "SELECT id, CASE WHEN starts_with(path, '/lib/ASIA/') THEN '/arch/EAST'||substr(path, 10) ELSE path END AS path FROM photos")(lambda p: K.rename_folder(p, "/lib/ASIA", "/arch/EAST").select("id", "path"))
_query("rating_clamp", ("photos",), "SELECT id, CASE WHEN id%4=0 THEN 5 ELSE rating END AS rating FROM photos")(lambda p: K.set_rating(p, p.where("id % 4 = 0"), 99).select("id", "rating"))
_query("tags_union", ("photos",), "SELECT id, CASE WHEN id%4=0 THEN array_to_string(tags, ',') || (CASE WHEN list_contains(tags,'vacances') THEN '' ELSE ',vacances' END) || ',plage' ELSE array_to_string(tags, ',') END AS tags FROM photos")(lambda p: K.tag(p, p.where("id % 4 = 0"), [" vacances", "plage", "a,b", ""]).select("id", F.array_join("tags", ",").alias("tags")))
_query("tags_remove", ("photos",), "SELECT id, array_to_string(list_filter(tags, lambda t: t<>'vacances' OR id%20<>0), ',') AS tags FROM photos")(lambda p: K.untag(p, p.where("id % 20 = 0"), "vacances").select("id", F.array_join("tags", ",").alias("tags")))
_query("album_add_ignore", ("album_photos",), "SELECT album_id, photo_id FROM album_photos UNION SELECT 1, photo_id FROM album_photos WHERE album_id=2")(lambda m: K.add_to_album(m, m.where("album_id = 2").select(F.lit(1).cast("long").alias("album_id"), "photo_id"))[0])
_query("orphan_album_purge", ("album_photos", "photos"), "SELECT album_id, photo_id FROM album_photos WHERE photo_id IN (SELECT id FROM photos WHERE rating>0)")(lambda m, p: K.purge_orphans(m, p.where("rating > 0")))
_query("dissolve_singletons", ("photos",), "SELECT id, CASE WHEN count(*) OVER (PARTITION BY duplicate_group_id) > 1 THEN duplicate_group_id END AS duplicate_group_id FROM photos WHERE rating>=3")(lambda p: K.dissolve_singletons(p.where("rating >= 3")).select("id", "duplicate_group_id"))
_query("dup_conflicting_dates", ("photos",), "SELECT duplicate_group_id, count(DISTINCT date_taken) AS n_dates FROM photos WHERE duplicate_group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT date_taken)>1")(K.conflicting_groups)
_query("dup_groups_members", ("photos",), "SELECT duplicate_group_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS members FROM photos WHERE duplicate_group_id IS NOT NULL GROUP BY 1 HAVING count(*)>1")(K.group_members)
_query("assign_groups", ("photos",), """WITH a AS (SELECT id, CASE WHEN id%9=0 THEN CASE WHEN id%2=0 THEN id//90 END ELSE duplicate_group_id END AS g FROM photos)
 SELECT id, CASE WHEN g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 THEN CAST(g AS BIGINT) END AS duplicate_group_id FROM a""")(lambda p: K.assign_groups(p, p.where("id % 9 = 0").select("id", F.when(F.col("id") % 2 == 0, F.floor(F.col("id") / 90)).cast("long").alias("gid"))).select("id", "duplicate_group_id"))
_query("delete_photos", ("photos", "album_photos"), "SELECT album_id, photo_id FROM album_photos WHERE photo_id%6<>0")(lambda p, m: K.delete_photos(p, m, p.where("id % 6 = 0").select("id"))[1])
_query("snapshot_diff", ("photos",), "SELECT path, CASE WHEN id%5=0 THEN 'disappeared' ELSE 'appeared' END AS change FROM photos WHERE (id%5=0) <> (id%7=0)")(lambda p: K.snapshot_diff(p.where("id % 7 <> 0"), p.where("id % 5 <> 0")))
_query("synthetic_clusters", ("faces",), "SELECT id, CASE WHEN person_id IS NOT NULL THEN 10000000+person_id WHEN id%3=0 THEN NULL ELSE cluster_id END AS cluster_id FROM faces")(lambda f: P.synthetic_clusters(f.withColumn("cluster_id", F.when(F.col("id") % 3 != 0, F.col("cluster_id")))).select("id", "cluster_id"))
_query("propagate_person", ("faces",), "SELECT id, coalesce(person_id, min(person_id) OVER (PARTITION BY cluster_id)) AS person_id FROM faces")(lambda f: P.propagate_person(f).select("id", "person_id"))
_query("merge_persons", ("faces",), """WITH m AS (SELECT * REPLACE (CASE WHEN person_id=3 THEN 4 ELSE person_id END AS person_id), photo_id IN (SELECT photo_id FROM faces WHERE person_id=3) AS hit FROM faces)
 SELECT id, person_id, CASE WHEN hit AND person_id IS NOT NULL AND NOT ignored THEN row_number() OVER (PARTITION BY photo_id, person_id, ignored ORDER BY w*h DESC, id) > 1 ELSE ignored END AS ignored FROM m""")(lambda f: P.merge_persons(f, 3, 4).select("id", "person_id", "ignored"))
_query("merge_clusters", ("faces",), "SELECT id, CASE WHEN cluster_id=8 THEN 9 ELSE cluster_id END AS cluster_id FROM faces")(lambda f: P.merge_clusters(f, 8, 9).select("id", "cluster_id"))
_query("isolate_faces_sequence", ("faces",), "SELECT f.id, coalesce(-n.n, cluster_id) AS cluster_id FROM faces f LEFT JOIN (SELECT id, row_number() OVER (ORDER BY id) AS n FROM (SELECT DISTINCT id FROM faces WHERE id%1000=1)) n USING (id)")(lambda f: P.isolate(f, f.where("id % 1000 = 1")).select("id", "cluster_id"))
_query("unassign_person", ("faces",), "SELECT id, nullif(person_id, 6) AS person_id FROM faces")(lambda f: P.unassign_person(f, 6).select("id", "person_id"))
_query("accept_suggestion", ("faces",), """WITH m AS (SELECT * REPLACE (CASE WHEN cluster_id=20 THEN (SELECT min(suggestion_person_id) FROM faces WHERE cluster_id=20) ELSE person_id END AS person_id, CASE WHEN cluster_id=20 THEN NULL ELSE suggestion_person_id END AS suggestion_person_id), photo_id IN (SELECT photo_id FROM faces WHERE cluster_id=20) AS hit FROM faces)
 SELECT id, person_id, suggestion_person_id, CASE WHEN hit AND person_id IS NOT NULL AND NOT ignored THEN row_number() OVER (PARTITION BY photo_id, person_id, ignored ORDER BY w*h DESC, id) > 1 ELSE ignored END AS ignored FROM m""")(lambda f: P.accept_suggestion(f, 20).select("id", "person_id", "suggestion_person_id", "ignored"))
_query("ignore_cluster", ("faces",), "SELECT id, ignored OR cluster_id=30 AS ignored FROM faces")(lambda f: P.ignore_cluster(f, 30).select("id", "ignored"))
_query("orphan_persons", ("faces",), "SELECT id, CASE WHEN person_id<5 THEN person_id END AS person_id FROM faces")(lambda f: P.orphan_persons(f, f.sparkSession.range(5)).select("id", "person_id"))
_query("date_sync_actions", ("photos",), "SELECT id, CASE WHEN date_taken IS NULL THEN 'no_date' WHEN year(date_taken) NOT BETWEEN 1990 AND 1998 THEN 'incoherent' WHEN abs(epoch_us(mtime_ts)+(id%3)*1000000-epoch_us(date_taken))<=1000000 THEN 'in_sync' ELSE 'set_file_date' END AS action FROM photos")(
    lambda p: H.date_actions(p.withColumn("mtime_ts", F.timestamp_micros(F.unix_micros(F.col("mtime_ts").cast("timestamp")) + (F.col("id") % 3) * 1_000_000).cast("timestamp_ntz")), 1997, 1).select("id", "action")
)

# --- vectors and duplicates -----------------------------------------------

_DOT = "list_inner_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def _cos(a: str, b: str) -> str:
    return f"({_DOT.format(a, b)}/sqrt({_DOT.format(a, a)}*{_DOT.format(b, b)}))"


def _centroid_sql(*keys: str) -> str:
    k = ", ".join(keys)
    return f"SELECT {k}, max(n) AS n, list(m ORDER BY pos) AS centroid FROM (SELECT {k}, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS m, count(*) AS n FROM face_vectors, range(1, 65) r(pos) WHERE {' AND '.join(x + ' IS NOT NULL' for x in keys)} GROUP BY {k}, pos) GROUP BY {k}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("centroid", F.transform("centroid", lambda x: F.round(x, 6)))


for _name, _keys in (("person_centroids", ("person_id",)), ("cluster_centroids", ("cluster_id",)), ("cluster_person_centroids", ("person_id", "cluster_id"))):
    _query(_name, ("face_vectors",), f"SELECT {', '.join(_keys)}, n, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM ({_centroid_sql(*_keys)})")(lambda v, k=_keys: _rounded(P.centroids(v, *k)))
_TOP = f"""SELECT c.cluster_id, p.person_id, {_cos('c.centroid', 'p.centroid')} AS s FROM ({_centroid_sql('cluster_id')}) c, ({_centroid_sql('person_id')}) p"""
_BEST = "SELECT cluster_id, person_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY s DESC, person_id) AS r FROM ({0})) WHERE r=1"


def _top1(v, exclude=None):
    left = P.centroids(v, "cluster_id")
    if exclude:
        left = left.withColumn(exclude, F.col("cluster_id") % 10)
    return P.best_person(left, P.centroids(v, "person_id"), exclude)


_query("cosine_top1", ("face_vectors",), _BEST.format(_TOP))(lambda v: _top1(v).withColumn("score", F.round("score", 6)))
_query("cosine_top1_exclude", ("face_vectors",), _BEST.format(_TOP + " WHERE p.person_id <> c.cluster_id%10"))(lambda v: _top1(v, "banned").withColumn("score", F.round("score", 6)))
_query("suggestion_tiers", ("face_vectors",), f"SELECT cluster_id, person_id, CASE WHEN score>=0.25 THEN 'assign' WHEN score>=0.15 THEN 'suggest' ELSE 'none' END AS tier FROM ({_BEST.format(_TOP)})")(lambda v: _top1(v).select("cluster_id", "person_id", P.tier("score", P.Tiers(0.15, 0.25)).alias("tier")))
_PAIRS = f"SELECT a.face_id AS a, b.face_id AS b, {_cos('a.embedding', 'b.embedding')} AS score FROM face_vectors a JOIN face_vectors b ON a.face_id<b.face_id WHERE {_cos('a.embedding', 'b.embedding')} >= 0.35"
_query("cosine_pairs", ("face_vectors",), f"SELECT a, b, round(score, 6) AS score FROM ({_PAIRS})")(lambda v: G.blocks.cosine_pairs(v, 0.35, "face_id", "embedding").withColumn("score", F.round("score", 6)))


def _components_sql(pairs: str, nodes: str, key: str) -> str:
    return f"""WITH RECURSIVE e AS (SELECT a, b FROM ({pairs}) UNION SELECT b, a FROM ({pairs})), walk(id, seen) AS (SELECT {key}, {key} FROM {nodes} UNION SELECT w.id, e.b FROM walk w JOIN e ON e.a=w.seen)
 SELECT id, min(seen) AS group_id FROM walk GROUP BY id"""


QUERIES["cosine_group_components"] = lambda spark, sf: G.cosine_groups(A.face_vectors(spark, sf), 0.35, "face_id", "embedding")
ORACLE_SQL["cosine_group_components"] = _components_sql(_PAIRS, "face_vectors", "face_id").replace("WITH RECURSIVE ", f"WITH RECURSIVE face_vectors AS ({A.SQL_VIEWS['face_vectors']}), ", 1)
_query("group_avg_similarity", ("face_vectors",), f"SELECT a.person_id, CAST(1+sqrt(1+8*count(*)) AS BIGINT)//2 AS n, round(avg({_cos('a.embedding', 'b.embedding')}), 6) AS similarity FROM face_vectors a JOIN face_vectors b ON a.person_id=b.person_id AND a.face_id<b.face_id GROUP BY 1")(lambda v: P.group_similarity(v, "person_id").withColumn("similarity", F.round("similarity", 6)))
_HAMMING = "SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.bits, b.bits)) AS INTEGER) AS distance FROM fingerprints a JOIN fingerprints b ON a.id<b.id WHERE bit_count(xor(a.bits, b.bits))<=19"
_query("hamming_pairs", ("fingerprints",), _HAMMING)(lambda f: G.duplicate_pairs(f, 19, None))
_query("hamming_pairs_date_veto", ("fingerprints",), _HAMMING + " AND (a.day IS NULL OR b.day IS NULL OR a.day=b.day)")(lambda f: G.duplicate_pairs(f, 19))
_query("incremental_hamming_new_vs_all", ("fingerprints",), _HAMMING + " AND (a.id%10=0 OR b.id%10=0)")(lambda f: G.duplicate_pairs(f.withColumn("new", F.col("id") % 10 == 0), 19, None, "new"))
QUERIES["hamming_components"] = lambda spark, sf: G.print_groups(A.fingerprints(spark, sf), 17)
_H17 = _HAMMING.replace("<=19", "<=17") + " AND (a.day IS NULL OR b.day IS NULL OR a.day=b.day)"
ORACLE_SQL["hamming_components"] = "SELECT id, group_id FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM (" + _components_sql(_H17, "fingerprints", "id").replace("WITH RECURSIVE ", f"WITH RECURSIVE fingerprints AS ({A.SQL_VIEWS['fingerprints']}), ", 1) + ")) WHERE n>1"
_query("area_band_join", ("photos",), "SELECT a.duplicate_group_id, a.id AS a, b.id AS b FROM photos a JOIN photos b ON a.duplicate_group_id=b.duplicate_group_id AND a.id<b.id WHERE greatest(a.width*a.height, b.width*b.height)<=2.0*least(a.width*a.height, b.width*b.height)")(
    lambda p: G.blocks.ratio_pairs(p.where("duplicate_group_id is not null").withColumn("area", F.col("width") * F.col("height")), 2.0, group=["duplicate_group_id"])
)

# --- boxes ----------------------------------------------------------------

_query("iou_pairs", ("faces",), f"SELECT a.photo_id, a.id AS a, b.id AS b, round({_iou('a', 'b')}, 6) AS iou FROM faces a JOIN faces b ON a.photo_id=b.photo_id AND a.id<b.id WHERE {_iou('a', 'b')}>0.1")(lambda f: P.box_pairs(f, f, 0.1).where("a < b").withColumn("iou", F.round("iou", 6)))
_query("orientation_remap", ("faces",), """SELECT id, CASE id%8+1 WHEN 2 THEN 4000-x-w WHEN 3 THEN 4000-x-w WHEN 5 THEN y WHEN 6 THEN 3000-y-h WHEN 7 THEN 3000-y-h WHEN 8 THEN y ELSE x END AS bx,
 CASE id%8+1 WHEN 3 THEN 3000-y-h WHEN 4 THEN 3000-y-h WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 4000-x-w WHEN 8 THEN 4000-x-w ELSE y END AS by, CASE WHEN id%8>=4 THEN h ELSE w END AS bw FROM faces""")(
    lambda f: f.select("id", C.oriented("x", "y", "w", "h", F.lit(4000), F.lit(3000), F.col("id") % 8 + 1).alias("b")).select("id", F.col("b.x").alias("bx"), F.col("b.y").alias("by"), F.col("b.w").alias("bw"))
)
_query("rect64_decode", ("faces",), "SELECT id, round(x/65535.0, 9) AS l, round(y/65535.0, 9) AS t, round((x+w)/65535.0, 9) AS r FROM faces")(
    lambda f: f.select("id", C.rect64(F.format_string("%04x%04x%04x%04x", "x", "y", F.col("x") + F.col("w"), F.col("y") + F.col("h"))).alias("r")).select("id", F.round("r.left", 9).alias("l"), F.round("r.top", 9).alias("t"), F.round("r.right", 9).alias("r"))
)
_query("straighten_scale", ("photos",), "SELECT id, round(least(width/(width*cos(radians(id%30))+height*sin(radians(id%30))), height/(width*sin(radians(id%30))+height*cos(radians(id%30)))), 6) AS scale FROM photos")(lambda p: p.select("id", F.round(C.inscribed_scale("width", "height", F.col("id") % 30), 6).alias("scale")))

# --- scalar functions -----------------------------------------------------

_query("size_format", ("photos",), "SELECT id, CASE WHEN file_size*97<1024 THEN (file_size*97)||' B' WHEN file_size*97<1048576 THEN (file_size*97//1024)||' KB' WHEN file_size*97<1073741824 THEN (file_size*97//1048576)||' MB' ELSE (file_size*97//1073741824)||' GB' END AS size FROM photos")(lambda p: p.select("id", C.size_text(F.col("file_size") * 97).alias("size")))
_query("exposure_format", ("photos",), "SELECT id, CASE WHEN id%5=0 THEN format('{:.1f} s', (2+id%30)/2.0) ELSE '1/'||(2+id%4000)||' s' END AS exposure FROM photos")(lambda p: p.select("id", C.exposure_text(F.when(F.col("id") % 5 == 0, (2 + F.col("id") % 30) / 2.0).otherwise(1.0 / (2 + F.col("id") % 4000))).alias("exposure")))
_query("md5_cache_key", ("photos",), "SELECT id, md5(path) AS key FROM photos")(lambda p: p.select("id", C.cache_key("path").alias("key")))
_query("filter_chain_parse", ("photos",), "SELECT id, 'crop,tilt' AS names, CAST(id%9 AS VARCHAR) AS tilt FROM photos")(
    lambda p: p.select("id", C.filter_steps(F.concat(F.lit("tilt=1,0;crop=1,"), F.lpad(F.hex("id"), 16, "0"), F.lit(";junk;=3;tilt=1,"), (F.col("id") % 9).cast("string"), F.lit(";"))).alias("m")).select("id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("names"), F.get(F.element_at("m", "tilt"), F.lit(1)).alias("tilt"))
)
_query("media_type_backfill", ("photos",), "SELECT id, media_type FROM photos")(lambda p: K.backfill_media_type(p.withColumn("media_type", F.lit(None).cast("string"))).select("id", "media_type"))

from shutterlake.plans import catalog_queries, face_queries, format_queries  # noqa: E402, F401  they register themselves
