"""Queries of faces: reads, state changes, annotations, suggestions and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from shutterlake.operators import annotations as N, clustering as G, faces as P, indexing as I
from shutterlake.plans.base import query

_IOU = "(CASE WHEN {a}.w*{a}.h+{b}.w*{b}.h-{o}>0 THEN CAST({o} AS DOUBLE)/({a}.w*{a}.h+{b}.w*{b}.h-{o}) ELSE 0 END)"
_OVERLAP = "(greatest(least({a}.x+{a}.w,{b}.x+{b}.w)-greatest({a}.x,{b}.x),0)*greatest(least({a}.y+{a}.h,{b}.y+{b}.h)-greatest({a}.y,{b}.y),0))"
_DEDUP = "CASE WHEN {hit} AND person_id IS NOT NULL AND NOT ignored THEN row_number() OVER (PARTITION BY photo_id, person_id, ignored ORDER BY w*h DESC, id) > 1 ELSE ignored END AS ignored"


def _iou(a: str, b: str) -> str:
    return _IOU.format(a=a, b=b, o=_OVERLAP.format(a=a, b=b))


def _centre(a: str, b: str) -> str:
    return f"({b}.x+{b}.w//2 BETWEEN {a}.x AND {a}.x+{a}.w AND {b}.y+{b}.h//2 BETWEEN {a}.y AND {a}.y+{a}.h)"


_EITHER = f"({_centre('a', 'f')} OR {_centre('f', 'a')})"
_PLACE = f"({_EITHER} OR {_iou('a', 'f')}>0.30)"
_SCORE = f"CASE WHEN {_EITHER} THEN 1+{_iou('a', 'f')} ELSE {_iou('a', 'f')} END"
_SCORED = f"SELECT a.photo_id, a.id AS annotation, f.id AS face, {_SCORE} AS score FROM {{a}} a JOIN {{f}} f ON a.photo_id=f.photo_id WHERE {_EITHER} OR {_iou('a', 'f')}>=0.30"

# --- reads ----------------------------------------------------------------

_ROTATED = "SELECT f.*, CASE WHEN has_embedding THEN coalesce(CASE WHEN photo_id%3=0 THEN CAST(photo_id%4*90 AS INTEGER) END, 0) ELSE 0 END AS detected_rotation FROM faces f"


def _indexed(f):
    return f.where("photo_id % 3 = 0").select("photo_id", (F.col("photo_id") % 4 * 90).cast("int").alias("rotation")).distinct()


query("faces_with_rotation", ("single_faces",), f"SELECT id, detected_rotation FROM ({_ROTATED})")(lambda f: P.with_rotation(f, _indexed(f)).select("id", "detected_rotation"))
query("faces_of_photo", ("single_faces",), f"SELECT id, person_id, ignored, detected_rotation FROM ({_ROTATED}) WHERE photo_id=3")(lambda f: P.with_rotation(f.where("photo_id = 3"), _indexed(f)).select("id", "person_id", "ignored", "detected_rotation"))
query("faces_of_cluster", ("single_faces",), f"SELECT id, photo_id, detected_rotation FROM ({_ROTATED}) WHERE cluster_id=17")(lambda f: P.with_rotation(f.where("cluster_id = 17"), _indexed(f)).select("id", "photo_id", "detected_rotation"))
query("faces_of_person", ("single_faces",), f"SELECT id, photo_id, detected_rotation FROM ({_ROTATED}) WHERE person_id=4")(lambda f: P.with_rotation(f.where("person_id = 4"), _indexed(f)).select("id", "photo_id", "detected_rotation"))
query("ignored_faces", ("single_faces",), f"SELECT id, photo_id, detected_rotation FROM ({_ROTATED}) WHERE ignored")(lambda f: P.with_rotation(f.where("ignored"), _indexed(f)).select("id", "photo_id", "detected_rotation"))
query("faces_to_cluster", ("single_faces",), "SELECT id FROM faces WHERE has_embedding AND NOT ignored AND NOT pinned AND person_id IS NULL")(lambda f: P.embeddings_to_cluster(f, True).select("id"))
query("unassigned_natural_faces", ("single_faces",), "SELECT id FROM faces WHERE cluster_id BETWEEN 1 AND 9999999 AND person_id IS NULL")(lambda f: P.unassigned_natural(f).select("id"))
query("isolated_unsuggested_faces", ("single_faces",), "SELECT id FROM faces WHERE id%7=0 AND person_id IS NULL AND suggestion_person_id IS NULL")(lambda f: P.unsuggested_isolated(f.withColumn("cluster_id", F.when(F.col("id") % 7 == 0, -F.col("id")).otherwise(F.col("cluster_id")))).select("id"))
query("panel_order", ("single_faces",), "SELECT id FROM faces ORDER BY person_id IS NULL, x, id LIMIT 200")(lambda f: P.panel_order(f).limit(200).select("id"))
query("group_order", ("single_faces",), "SELECT person_id FROM faces WHERE person_id IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT cluster_id) DESC, count(*) DESC, 1 LIMIT 4")(
    lambda f: P.group_order(f.where("person_id is not null").groupBy(F.col("person_id").alias("group_id")).agg(F.countDistinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_faces"))).limit(4).select(F.col("group_id").alias("person_id"))
)
query("regrouped_singletons", ("single_faces",), """WITH b AS (SELECT cluster_id, min(suggestion_person_id) AS person_id, count(*)%4 AS n FROM faces GROUP BY 1)
 SELECT person_id, string_agg(cluster_id, ',' ORDER BY cluster_id) AS clusters FROM b WHERE person_id IS NOT NULL AND n=1 GROUP BY 1 HAVING count(*)>1""")(
    lambda f: _singletons(f.groupBy("cluster_id").agg(F.min("suggestion_person_id").alias("person_id"), (F.count("*") % 4).alias("n")))
)


def _singletons(b):
    found = P.regrouped_singletons(b.where("person_id is not null").select("cluster_id", "person_id"), b.select("cluster_id", "n"))
    return found.select("person_id", F.array_join(F.col("clusters").cast("array<string>"), ",").alias("clusters"))


# --- state changes --------------------------------------------------------

query("faces_ignored", ("single_faces",), "SELECT id, ignored OR x<50 AS ignored, CASE WHEN x>=50 THEN suggestion_person_id END AS suggestion_person_id FROM faces")(lambda f: P.set_ignored(f, f.where("x < 50")).select("id", "ignored", "suggestion_person_id"))
query("faces_unignored", ("single_faces",), "SELECT id, ignored AND x>=300 AS ignored, suggestion_person_id FROM faces")(lambda f: P.set_ignored(f, f.where("x < 300"), False).select("id", "ignored", "suggestion_person_id"))
query("person_assigned_to_faces", ("single_faces",), f"""WITH m AS (SELECT * REPLACE (CASE WHEN x<60 THEN 77 ELSE person_id END AS person_id), photo_id IN (SELECT photo_id FROM faces WHERE x<60) AS hit FROM faces)
 SELECT id, person_id, {_DEDUP.format(hit='hit')} FROM m""")(lambda f: P.assign_person(f, f.where("x < 60"), 77).select("id", "person_id", "ignored"))
query("person_assigned_to_cluster", ("single_faces",), f"""WITH m AS (SELECT * REPLACE (CASE WHEN cluster_id=12 THEN 77 ELSE person_id END AS person_id), photo_id IN (SELECT photo_id FROM faces WHERE cluster_id=12) AS hit FROM faces)
 SELECT id, person_id, {_DEDUP.format(hit='hit')} FROM m""")(lambda f: P.assign_cluster(f, 12, 77).select("id", "person_id", "ignored"))
query("suggestion_cleared", ("single_faces",), "SELECT id, CASE WHEN cluster_id<>20 THEN suggestion_person_id END AS suggestion_person_id, CASE WHEN cluster_id<>20 THEN suggestion_score END AS suggestion_score FROM faces")(lambda f: P.clear_suggestion(f, 20).select("id", "suggestion_person_id", "suggestion_score"))
query("person_unassigned_from_cluster", ("single_faces",), "SELECT id, CASE WHEN cluster_id%10=5 AND cluster_id=25 AND person_id=3 THEN NULL ELSE person_id END AS person_id FROM faces")(lambda f: P.unassign_from_cluster(f, 25, 3).select("id", "person_id"))
query("faces_unassigned", ("single_faces",), "SELECT id, CASE WHEN x>=40 THEN person_id END AS person_id, CASE WHEN x>=40 THEN cluster_id END AS cluster_id, pinned AND x>=40 AS pinned FROM faces")(lambda f: P.unassign_faces(f, f.where("x < 40")).select("id", "person_id", "cluster_id", "pinned"))
query("person_unassigned_from_faces", ("single_faces",), "SELECT id, CASE WHEN x>=40 THEN person_id END AS person_id, cluster_id FROM faces")(lambda f: P.unassign_faces(f, f.where("x < 40"), keep_cluster=True).select("id", "person_id", "cluster_id"))
query("face_isolated_and_assigned", ("single_faces",), f"""WITH n AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM faces WHERE x<5), m AS (SELECT f.* REPLACE (CASE WHEN n IS NOT NULL THEN 77 ELSE person_id END AS person_id, coalesce(-n, cluster_id) AS cluster_id), f.photo_id IN (SELECT photo_id FROM faces WHERE x<5) AS hit FROM faces f LEFT JOIN n USING (id))
 SELECT id, person_id, cluster_id, {_DEDUP.format(hit='hit')} FROM m""")(lambda f: P.isolate_and_assign(f, f.where("x < 5"), 77).select("id", "person_id", "cluster_id", "ignored"))
query("face_isolated_and_suggested", ("single_faces",), """SELECT id, CASE WHEN x<5 THEN NULL ELSE person_id END AS person_id, CASE WHEN x<5 THEN CASE WHEN y>=200 THEN 5 END ELSE suggestion_person_id END AS suggestion_person_id FROM faces""")(
    lambda f: P.isolate_and_suggest(f, f.where("x < 5"), f.select("id", F.lit(5).cast("long").alias("person_id"), F.when(F.col("y") >= 200, 0.6).otherwise(0.5).alias("score")), 0.55).select("id", "person_id", "suggestion_person_id")
)
query("manual_face_added", ("single_faces",), "SELECT id, photo_id, x FROM faces UNION ALL SELECT -1, 3, 10")(lambda f: P.add_face(f, f.sparkSession.createDataFrame([(-1, 3, 10, 10, 50, 50, 4)], "id long, photo_id long, x long, y long, w long, h long, person_id long")).select("id", "photo_id", "x"))
query("faces_deleted", ("single_faces",), "SELECT id FROM faces WHERE photo_id%9<>0")(lambda f: P.delete_faces(f, f.where("photo_id % 9 = 0")).select("id"))
query("face_paths_purged", ("single_faces",), "SELECT id FROM faces WHERE photo_id%6=1")(lambda f: f.join(f.where("photo_id % 6 = 1").select("photo_id").distinct(), "photo_id", "left_semi").select("id"))
query("boxes_remapped", ("single_faces",), "SELECT id, CASE WHEN x%3=1 THEN x+5 ELSE x END AS x, CASE WHEN x%3=1 THEN 2*w ELSE w END AS w FROM faces WHERE x%3<>0")(lambda f: I.remapped(f, f.where("x % 3 = 1").select("id", (F.col("x") + 5).alias("x"), "y", (F.col("w") * 2).alias("w"), "h"), f.where("x % 3 = 0")).select("id", "x", "w"))
query("size_ignored_recalculated", ("single_faces", "photos"), """WITH s AS (SELECT f.id, f.photo_id, f.ignored, f.det_score, f.has_embedding, least(f.w, f.h) AS side, greatest(22, floor(least(p.width, p.height)*0.03)) AS base, floor(least(p.width, p.height)*0.20) AS fifth FROM faces f JOIN photos p ON p.id=f.photo_id),
 t AS (SELECT *, coalesce(min(side) FILTER (side >= greatest(base*2, fifth)) OVER (PARTITION BY photo_id)*0.25, base) AS least_side FROM s) SELECT id, ignored AND NOT (has_embedding AND det_score>=0.65 AND side>=least_side) AS ignored FROM t""")(lambda f, p: P.unignore_by_size(f, p.select(F.col("id").alias("photo_id"), "width", "height")).select("id", "ignored"))
query("detections_filtered", ("single_faces",), """WITH r AS (SELECT *, CASE WHEN id%2=0 THEN 1.0 ELSE 0.4 END AS scale, x+w//4 AS x2, y+h//4 AS y2 FROM faces), b AS (SELECT *, CAST(trunc(x*(1.0/scale)) AS BIGINT) AS bx, CAST(trunc((x2-x)*(1.0/scale)) AS BIGINT) AS bw, CAST(trunc((y2-y)*(1.0/scale)) AS BIGINT) AS bh FROM r)
 SELECT photo_id, bx AS x, bw AS w, bh AS h, det_score FROM b WHERE det_score>=0.7 AND has_embedding AND bw>=20 AND bh>=20""")(
    lambda f: P.detections(f.select("photo_id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.floor(F.col("w") / 4)).alias("x2"), (F.col("y") + F.floor(F.col("h") / 4)).alias("y2"), F.col("det_score").alias("score"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.4).alias("scale"), "has_embedding"), 0.7).select("photo_id", "x", "w", "h", "det_score")
)
query("auto_rotation", ("single_faces",), """WITH d AS (SELECT photo_id, r AS rotation, (photo_id//(r//90+1))%3 AS n FROM (SELECT DISTINCT photo_id FROM faces), (SELECT unnest([0, 90, 180, 270]) AS r))
 SELECT photo_id, CAST(coalesce(max(CASE WHEN rotation=0 AND n>0 THEN 0 END), arg_max(rotation, n*1000-rotation)) AS INTEGER) AS rotation FROM d GROUP BY 1""")(
    lambda f: I.best_rotation(f.select("photo_id").distinct().select("photo_id", F.explode(F.array(*map(F.lit, (0, 90, 180, 270)))).alias("rotation")).withColumn("n_faces", F.floor(F.col("photo_id") / (F.col("rotation") / 90 + 1)) % 3))
)
query("clusters_updated", ("single_faces",), f"""WITH c AS (SELECT * REPLACE (CASE WHEN person_id IS NULL AND NOT pinned THEN NULL ELSE cluster_id END AS cluster_id, CASE WHEN person_id IS NULL AND NOT pinned THEN NULL ELSE suggestion_person_id END AS suggestion_person_id) FROM faces),
 l AS (SELECT * REPLACE (CASE WHEN photo_id%2=0 THEN CASE WHEN x%5=0 THEN NULL ELSE 1000+x END ELSE cluster_id END AS cluster_id) FROM c), d AS (SELECT * REPLACE (CASE WHEN NOT pinned AND cluster_id IS NULL AND has_embedding THEN NULL ELSE person_id END AS person_id) FROM l),
 m AS (SELECT * REPLACE (CASE WHEN cluster_id IS NULL THEN person_id ELSE coalesce(person_id, min(person_id) OVER (PARTITION BY cluster_id)) END AS person_id) FROM d) SELECT id, cluster_id, person_id, suggestion_person_id, {_DEDUP.format(hit='TRUE')} FROM m""")(
    lambda f: P.update_clusters(f, f.where("photo_id % 2 = 0").select("id", F.when(F.col("x") % 5 == 0, -1).otherwise(1000 + F.col("x")).alias("label"))).select("id", "cluster_id", "person_id", "suggestion_person_id", "ignored")
)
query("noise_to_singletons", ("single_faces",), "SELECT id, CASE WHEN x%20=0 THEN (SELECT max(x) FROM faces WHERE x%20<>0)+row_number() OVER (PARTITION BY x%20=0 ORDER BY id) ELSE x END AS label FROM faces")(
    lambda f: P.noise_to_singletons(f.select("id", F.when(F.col("x") % 20 == 0, -1).otherwise(F.col("x")).cast("long").alias("label")))
)
query("groups_numbered", ("single_faces",), "SELECT id, dense_rank() OVER (ORDER BY first) AS place FROM (SELECT id, min(id) OVER (PARTITION BY x) AS first, count(*) OVER (PARTITION BY x) AS n FROM faces) WHERE n>1")(
    lambda f: G.renumbered(f.join(f.groupBy("x").agg(F.min("id").alias("group_id")), "x").select("id", "group_id")).select("id", F.col("group_no").alias("place"))
)

# --- annotations ----------------------------------------------------------

query("center_in_box_match", ("single_annotations", "single_faces"), f"SELECT photo_id, annotation, face, round(score, 6) AS score FROM ({_SCORED.format(a='annotations', f='faces')})")(lambda a, f: P.match_scores(a, f).withColumn("score", F.round("score", 6)))


#: Annotations of a photo in order of id, each with the best face that those before left; sc has the scores.
_TURNS = """an AS (SELECT DISTINCT photo_id, annotation, dense_rank() OVER (PARTITION BY photo_id ORDER BY annotation) AS k FROM sc),
 g AS (SELECT photo_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS annotation, CAST(NULL AS BIGINT) AS face FROM (SELECT DISTINCT photo_id FROM sc)
  UNION ALL SELECT photo_id, k, CASE WHEN face IS NULL THEN used ELSE list_append(used, face) END, annotation, face FROM
   (SELECT g.photo_id, an.k, an.annotation, g.used, arg_max(s.face, (s.score, -s.face)) AS face FROM g JOIN an ON an.photo_id=g.photo_id AND an.k=g.k+1 LEFT JOIN sc s ON s.annotation=an.annotation AND NOT list_contains(g.used, s.face) GROUP BY ALL))"""


def _greedy(a: str, f: str) -> str:
    return f"sc AS ({_SCORED.format(a=a, f=f)}), {_TURNS}"


query("greedy_box_match", ("single_annotations", "single_faces"), f"WITH RECURSIVE {_greedy('annotations', 'faces')} SELECT photo_id, annotation, face FROM g WHERE face IS NOT NULL")(lambda a, f: P.greedy_matches(P.match_scores(a, f)).select("photo_id", "annotation", "face"))
query("consume_annotations", ("single_annotations", "single_faces"), f"SELECT id, consumed OR id IN (SELECT a.id FROM annotations a JOIN faces f ON f.photo_id=a.photo_id AND f.person_id=a.person_id WHERE f.has_embedding AND {_PLACE}) AS consumed FROM annotations")(lambda a, f: N.consumed_by_person(a, f).select("id", "consumed"))
_APPLIED = f"{_greedy('fa', 'ff')}, nm AS (SELECT g.face, g.annotation, a.person_id FROM g JOIN annotations a ON a.id=g.annotation WHERE g.face IS NOT NULL)"
_FREE = "fa AS (SELECT * FROM annotations WHERE NOT consumed), ff AS (SELECT * FROM faces WHERE person_id IS NULL AND NOT ignored)"
query("annotations_name_faces", ("single_annotations", "single_faces"), f"WITH RECURSIVE {_FREE}, {_APPLIED} SELECT f.id, coalesce(nm.person_id, f.person_id) AS person_id FROM faces f LEFT JOIN nm ON nm.face=f.id")(lambda a, f: N.applied(a, f)[0].select("id", "person_id"))
query("annotations_consumed_by_naming", ("single_annotations", "single_faces"), f"WITH RECURSIVE {_FREE}, {_APPLIED} SELECT id, consumed OR id IN (SELECT annotation FROM nm) AS consumed FROM annotations")(lambda a, f: N.applied(a, f)[1].select("id", "consumed"))
_SAVED = f"""WITH RECURSIVE fa AS (SELECT * REPLACE (FALSE AS consumed) FROM annotations WHERE photo_id%2=0), ff AS (SELECT * FROM faces WHERE person_id IS NULL AND NOT ignored AND photo_id%2=0), {_greedy('fa', 'ff')}, nm AS (SELECT g.face, g.annotation, a.person_id FROM g JOIN fa a ON a.id=g.annotation WHERE g.face IS NOT NULL),
 nf AS (SELECT f.* REPLACE (coalesce(nm.person_id, f.person_id) AS person_id) FROM faces f LEFT JOIN nm ON nm.face=f.id),
 an AS (SELECT a.*, a.id IN (SELECT annotation FROM nm) OR EXISTS (SELECT 1 FROM nf WHERE nf.photo_id=a.photo_id AND nf.person_id=a.person_id AND nf.has_embedding) OR EXISTS (SELECT 1 FROM nf f WHERE f.photo_id=a.photo_id AND f.has_embedding AND {_PLACE}) AS done FROM fa a)"""
_SAVED = _SAVED.replace(" an AS (SELECT a.*", " dn AS (SELECT a.*")
query("annotations_saved", ("single_annotations", "single_faces"), f"{_SAVED} SELECT id, consumed FROM annotations WHERE photo_id%2<>0 UNION ALL SELECT id, done FROM dn")(lambda a, f: N.saved(a, f, a.where("photo_id % 2 = 0"))[1].select("id", "consumed"))
query("faces_after_annotations", ("single_annotations", "single_faces"), f"{_SAVED} SELECT id, person_id, has_embedding FROM nf WHERE photo_id NOT IN (SELECT photo_id FROM fa) OR has_embedding OR pinned UNION ALL SELECT -id-1, person_id, FALSE FROM dn WHERE NOT done")(lambda a, f: N.saved(a, f, a.where("photo_id % 2 = 0"))[0].select("id", "person_id", "has_embedding"))
query("annotations_released", ("single_annotations", "single_faces"), "SELECT id, photo_id%5<>0 OR NOT EXISTS (SELECT 1 FROM faces f WHERE f.photo_id=a.photo_id AND f.person_id=a.person_id) AS consumed FROM annotations a")(
    lambda a, f: N.released(a.withColumn("consumed", F.lit(True)), f, P.unassign_faces(f, f.where("photo_id % 5 = 0"), True)).select("id", "consumed")
)
query("annotations_of_merged_persons", ("single_annotations",), "SELECT id, CASE WHEN person_id=3 THEN 4 ELSE person_id END AS person_id FROM annotations")(lambda a: N.merged_persons(a, 3, 4).select("id", "person_id"))
query("annotations_of_known_persons", ("single_annotations",), "SELECT id FROM annotations WHERE person_id<5")(lambda a: N.of_known_persons(a, a.sparkSession.range(5)).select("id"))
query("placeholders_cleaned", ("single_faces",), f"""WITH o AS (SELECT d.id AS dummy, r.id AS realid, d.person_id AS dp, r.person_id AS rp, {_iou('d', 'r')} AS iou FROM faces d JOIN faces r ON d.photo_id=r.photo_id WHERE NOT d.has_embedding AND r.has_embedding AND {_iou('d', 'r')}>0.30),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dummy ORDER BY iou DESC, realid) AS n FROM o WHERE rp IS NULL OR dp IS NULL OR rp=dp) WHERE n=1) SELECT f.id, coalesce(f.person_id, (SELECT min(dp) FROM b WHERE b.realid=f.id)) AS person_id FROM faces f WHERE f.id NOT IN (SELECT dummy FROM b)""")(lambda f: I.without_placeholders(f).select("id", "person_id"))
query("redetected_faces", ("single_faces",), f"""WITH RECURSIVE nf AS (SELECT id+1000000000 AS id, photo_id, x+4 AS x, y+3 AS y, w, h FROM faces WHERE id%2=0), sc AS (SELECT a.photo_id, a.id AS annotation, f.id AS face, {_iou('a', 'f')} AS score FROM nf a JOIN faces f ON a.photo_id=f.photo_id WHERE {_iou('a', 'f')}>0.30),
 {_TURNS} SELECT nf.id, f.person_id FROM nf LEFT JOIN g ON g.annotation=nf.id AND g.face IS NOT NULL LEFT JOIN faces f ON f.id=g.face""")(
    lambda f: I.redetected(f.select("id", "photo_id", "x", "y", "w", "h", "person_id"), f.where("id % 2 = 0").select((F.col("id") + 1_000_000_000).alias("id"), "photo_id", (F.col("x") + 4).alias("x"), (F.col("y") + 3).alias("y"), "w", "h", F.lit(None).cast("long").alias("person_id"))).select("id", "person_id")
)
query("sidecar_persons", ("persons", "single_annotations"), "SELECT a.id, p.id AS person_id, p.name FROM annotations a JOIN persons p ON p.id=a.person_id+1 WHERE a.id%3=0 UNION ALL SELECT id, NULL, 'Unknown '||person_id FROM annotations WHERE id%3=1")(lambda p, a: N.imported_persons(*_sidecar(p, a))[0].select("id", "person_id", "name"))
query("sidecar_persons_created", ("persons", "single_annotations"), "SELECT DISTINCT 'Unknown '||person_id AS name FROM annotations WHERE id%3=1")(lambda p, a: N.imported_persons(*_sidecar(p, a))[1])
query("import_statistics", ("persons", "single_annotations"), "SELECT (SELECT count(DISTINCT person_id) FROM annotations WHERE id%3=1) AS n_created, count(*) AS n_faces, count(DISTINCT photo_id) AS n_photos, (SELECT count(*) FROM persons) AS n_edits FROM annotations WHERE id%3=1 OR (id%3=0 AND person_id+1 IN (SELECT id FROM persons))")(
    lambda p, a: (lambda named, new: N.import_statistics(named, p, new))(*N.imported_persons(*_sidecar(p, a)))
)


def _sidecar(p, a):
    """Faces of sidecars with hashes h<n> of persons and u<n> of names that nobody has; others are not in the contacts."""
    person = F.col("person_id").cast("string")
    faces = a.select("id", F.lit("ini").alias("ini"), F.col("photo_id").cast("string").alias("file"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("h"), person)).when(F.col("id") % 3 == 1, F.concat(F.lit("u"), person)).otherwise("none").alias("hash"))
    known = p.select(F.concat(F.lit("h"), (F.col("id") - 1).cast("string")).alias("hash"), "name")
    unknown = a.select(F.concat(F.lit("u"), person).alias("hash"), F.concat(F.lit("Unknown "), person).alias("name")).distinct()
    return faces, known.unionByName(unknown), p


# --- suggestions ----------------------------------------------------------

_VECTORS = "v AS (SELECT face_id, cluster_id, person_id, CAST(embedding AS DOUBLE[]) AS e FROM face_vectors)"


def _means(name: str, key: str, where: str) -> str:
    return f"{name} AS (SELECT {key}, list(m ORDER BY pos) AS c FROM (SELECT {key}, pos, avg(e[pos]) AS m FROM v, range(1, 65) r(pos) WHERE {where} GROUP BY {key}, pos) GROUP BY {key})"


_COS = "list_inner_product(a.c, b.c)/sqrt(list_inner_product(a.c, a.c)*list_inner_product(b.c, b.c))"
_BEST = "SELECT cluster_id, person_id, score FROM (SELECT a.cluster_id, b.person_id, {cos} AS score, row_number() OVER (PARTITION BY a.cluster_id ORDER BY round({cos}, 12) DESC, b.person_id) AS r FROM cl a JOIN pe b ON {on}) WHERE r=1"
_TIERS = P.Tiers(suggest=0.15, assign=0.30)


def _suggesting(v):
    """Faces and vectors of the embeddings; every third named face's cluster mates carry a suggestion."""
    empty = F.lit(None)
    faces = v.select(F.col("face_id").alias("id"), F.col("face_id").alias("photo_id"), "cluster_id", "person_id", F.lit(False).alias("ignored"), empty.cast("long").alias("suggestion_person_id"), empty.cast("double").alias("suggestion_score"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    return faces, v.select("face_id", "embedding")


query("similar_persons_found", ("face_vectors",), f"WITH {_VECTORS}, {_means('cl', 'cluster_id', 'person_id IS NULL')}, {_means('pe', 'person_id', 'person_id IS NOT NULL')}, b AS ({_BEST.format(cos=_COS, on='TRUE')}) SELECT cluster_id, person_id, round(score, 6) AS score FROM b WHERE score>=0.15")(
    lambda v: P.find_similar(*_suggesting(v), _TIERS)[0].withColumn("score", F.round("score", 6))
)
query("similar_persons_counts", ("face_vectors",), f"WITH {_VECTORS}, {_means('cl', 'cluster_id', 'person_id IS NULL')}, {_means('pe', 'person_id', 'person_id IS NOT NULL')}, b AS ({_BEST.format(cos=_COS, on='TRUE')}) SELECT count(*) FILTER (score>=0.15) AS n_made, count(*) AS n_checked FROM b")(lambda v: P.find_similar(*_suggesting(v), _TIERS)[1])
query("resuggested_without_person", ("face_vectors",), f"""WITH {_VECTORS}, {_means('cl', 'cluster_id', 'cluster_id<10')}, {_means('pe', 'person_id', 'person_id IS NOT NULL AND person_id<>2')}, b AS ({_BEST.format(cos=_COS, on='TRUE')})
 SELECT face_id AS id, CASE WHEN v.person_id IS NULL AND b.score>=0.30 THEN b.person_id ELSE v.person_id END AS person_id, CASE WHEN v.person_id IS NULL AND b.score>=0.15 AND b.score<0.30 THEN b.person_id END AS suggestion_person_id FROM v LEFT JOIN b USING (cluster_id)""")(
    lambda v: (lambda f, e: P.resuggested(f, e, f.where("cluster_id < 10"), 2, _TIERS).select("id", "person_id", "suggestion_person_id"))(*_suggesting(v))
)
query("suggestions_applied", ("face_vectors",), f"""WITH {_VECTORS}, {_means('cl', 'cluster_id', 'TRUE')}, {_means('pe', 'person_id', 'person_id IS NOT NULL')}, b AS ({_BEST.format(cos=_COS, on='TRUE')})
 SELECT face_id AS id, CASE WHEN v.person_id IS NULL AND b.score>=0.40 THEN b.person_id ELSE v.person_id END AS person_id, CASE WHEN v.person_id IS NULL AND b.score>=0.15 AND b.score<0.40 THEN b.person_id END AS suggestion_person_id FROM v JOIN b USING (cluster_id)""")(
    lambda v: P.apply_suggestions(_suggesting(v)[0], P.best_person(P.centroids(v, "cluster_id"), P.centroids(v, "person_id")), P.Tiers(suggest=0.15, assign=0.40)).select("id", "person_id", "suggestion_person_id")
)
query("best_person_of_pairs", ("face_vectors",), f"""WITH {_VECTORS}, {_means('cl', 'cluster_id', 'person_id IS NULL')}, {_means('pc', 'person_id, cluster_id', 'person_id IS NOT NULL')}
 SELECT cluster_id, person_id, round(score, 6) AS score FROM (SELECT a.cluster_id, b.person_id, {_COS} AS score, row_number() OVER (PARTITION BY a.cluster_id ORDER BY round({_COS}, 12) DESC, b.person_id, b.cluster_id) AS r FROM cl a CROSS JOIN pc b) WHERE r=1""")(lambda v: P.best_of_pairs(v).withColumn("score", F.round("score", 6)))
query("best_person_of_selection", ("face_vectors",), f"WITH {_VECTORS}, {_means('cl', 'cluster_id', 'cluster_id<10')}, {_means('pe', 'person_id', 'person_id IS NOT NULL')}, b AS ({_BEST.format(cos=_COS, on='TRUE')}) SELECT person_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, person_id LIMIT 1")(
    lambda v: P.best_of_selection(P.best_person(P.centroids(v, "cluster_id"), P.centroids(v, "person_id")), v.where("cluster_id < 10")).withColumn("score", F.round("score", 6))
)
query("representative_embedding", ("face_vectors",), "SELECT pos AS place, round(avg(CAST(embedding[pos+1] AS DOUBLE)), 9) AS value FROM face_vectors, range(0, 64) r(pos) WHERE cluster_id=7 GROUP BY 1")(
    lambda v: P.centroids(v.where("cluster_id = 7"), "cluster_id").select(F.posexplode("centroid").alias("place", "value")).select(F.col("place").cast("long").alias("place"), F.round("value", 9).alias("value"))
)
query("centroids_updated", ("face_vectors",), "SELECT person_id, count(*) AS n, round(sum(CAST(embedding[1] AS DOUBLE))/count(*), 9) AS first FROM face_vectors WHERE person_id IS NOT NULL AND cluster_id%5<>0 GROUP BY 1")(
    lambda v: P.updated_sums(P.summed(v.where("cluster_id % 5 <> 1"), "person_id"), v.where("cluster_id % 5 = 1"), v.where("cluster_id % 5 = 0"), "person_id").select("person_id", "n", F.round(F.get("total", F.lit(0)) / F.col("n"), 9).alias("first"))
)
query("hamming_pairs_micro_veto", ("fingerprints", "face_vectors"), """SELECT a.id AS a, b.id AS b, bit_count(xor(a.bits, b.bits)) AS distance FROM fingerprints a JOIN fingerprints b ON a.id<b.id JOIN face_vectors va ON va.face_id=a.id JOIN face_vectors vb ON vb.face_id=b.id
 WHERE bit_count(xor(a.bits, b.bits))<=20 AND NOT coalesce(a.day<>b.day, FALSE) AND (SELECT avg(abs(va.embedding[i]-vb.embedding[i])) FROM range(1, 65) r(i)) <= 0.125""")(
    lambda p, v: G.verified_pairs(G.duplicate_pairs(p, 20), v.select(F.col("face_id").alias("id"), F.col("embedding").alias("micro")), 0.125).withColumn("distance", F.col("distance").cast("int"))
)
query("clusters_purified", ("face_vectors",), "SELECT face_id AS id, cluster_id AS label, 0 AS part FROM face_vectors WHERE cluster_id%2=0 UNION ALL SELECT face_id, -1, 0 FROM face_vectors WHERE cluster_id%2=1")(
    lambda v: G.purified(v.select(F.col("face_id").alias("id"), F.when(F.col("cluster_id") % 2 == 0, F.col("cluster_id")).otherwise(-1).cast("long").alias("label"), F.when(F.col("face_id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.1))).otherwise(F.array(F.lit(1.0), F.lit(0.3))).alias("vector")))
)
query("same_clusters_split", ("face_vectors",), "SELECT face_id AS id, cluster_id%5 AS label, CASE WHEN face_id%3=arg_min(face_id, face_id) OVER (PARTITION BY cluster_id%5)%3 THEN 0 ELSE 1 END AS part FROM face_vectors WHERE face_id%3<2")(
    lambda v: G.purified(v.where("face_id % 3 < 2").select(F.col("face_id").alias("id"), (F.col("cluster_id") % 5).alias("label"), F.when(F.col("face_id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("vector")))
)
