"""Faces, clusters and persons: counters, representatives, suggestions and state changes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from shutterlake.functions import columns as C
from shutterlake.operators import blocks
from shutterlake.operators.numbering import numbered

#: Cluster ids from here on stand for a person rather than for a natural cluster.
SYNTHETIC = 10_000_000
BOX = ("x", "y", "w", "h")


@dataclass(frozen=True)
class Tiers:
    suggest: float = 0.55
    assign: float = 0.70
    group: float = 0.72


def live() -> Column:
    return ~F.coalesce("ignored", F.lit(False))


def unpinned() -> Column:
    return ~F.coalesce("pinned", F.lit(False))


# --- counters -------------------------------------------------------------


def clusters_by_size(faces: DataFrame) -> DataFrame:
    """All clusters, with ignored and pinned faces."""
    return faces.where("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"))


def unnamed_clusters(faces: DataFrame) -> DataFrame:
    return faces.where(F.col("cluster_id").isNotNull() & F.col("person_id").isNull() & live() & unpinned()).groupBy("cluster_id").agg(F.count("*").alias("n"))


def cluster_persons(faces: DataFrame) -> DataFrame:
    return faces.where("cluster_id is not null and person_id is not null").groupBy("cluster_id").agg(F.min("person_id").alias("person_id"))


def dominant_person(faces: DataFrame) -> DataFrame:
    """The most frequent person of each cluster; of equals the lowest id."""
    n = faces.where("cluster_id is not null and person_id is not null").groupBy("cluster_id", "person_id").agg(F.count("*").alias("n"))
    return n.groupBy("cluster_id").agg(F.max_by("person_id", F.struct("n", -F.col("person_id"))).alias("person_id"), F.max("n").alias("n"))


def suggested_clusters(faces: DataFrame, person_id: int) -> DataFrame:
    return faces.where((F.col("suggestion_person_id") == person_id) & F.col("person_id").isNull() & live()).groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("suggestion_score").alias("score"))


def pending_counts(faces: DataFrame) -> DataFrame:
    return faces.where(F.col("suggestion_person_id").isNotNull() & F.col("person_id").isNull() & live()).groupBy(F.col("suggestion_person_id").alias("person_id")).agg(F.countDistinct("cluster_id").alias("n_pending"))


def clusters_for_person(faces: DataFrame, person_id: int) -> DataFrame:
    return faces.where((F.col("person_id") == person_id) & live()).groupBy("cluster_id").agg(F.count("*").alias("n_faces"), F.countDistinct("photo_id").alias("n_photos"))


def person_photo_counts(faces: DataFrame) -> DataFrame:
    """Photos per person, counting faces that are in a cluster."""
    return faces.where(F.col("person_id").isNotNull() & F.col("cluster_id").isNotNull() & live()).groupBy("person_id").agg(F.countDistinct("photo_id").alias("n_photos"))


def photos_of_person(faces: DataFrame, person_id: int) -> DataFrame:
    return faces.where((F.col("person_id") == person_id) & live()).select("photo_id").distinct()


def photos_of_cluster(faces: DataFrame, cluster_id: int) -> DataFrame:
    return faces.where((F.col("cluster_id") == cluster_id) & live()).select("photo_id").distinct()


def enriched_persons(faces: DataFrame) -> DataFrame:
    """(person_id, n_photos, cover_face, n_pending) of every person."""
    counts, covers, pending = person_photo_counts(faces), cover_faces(faces).select("person_id", F.col("id").alias("cover_face")), pending_counts(faces)
    return counts.join(covers, "person_id", "left").join(pending, "person_id", "left").select("person_id", "n_photos", "cover_face", F.coalesce("n_pending", F.lit(0)).alias("n_pending"))


def face_stats(faces: DataFrame) -> DataFrame:
    return faces.agg(
        F.count("*").alias("n_faces"), F.countDistinct("photo_id").alias("n_photos"), F.countDistinct("cluster_id").alias("n_clusters"),
        F.count_if(F.col("person_id").isNotNull()).alias("n_identified"),
    )


def recognition_counters(faces: DataFrame) -> DataFrame:
    named, suggested = F.col("person_id").isNotNull(), F.col("suggestion_person_id").isNotNull()
    return faces.agg(
        F.count("*").alias("total"), F.count_if(named).alias("identified"), F.count_if(~named & live()).alias("unidentified"), F.count_if(~live()).alias("ignored"),
        F.count_if(~unpinned()).alias("pinned"), F.count_if(suggested & ~named).alias("suggested"), F.count_if(F.col("cluster_id") >= SYNTHETIC).alias("synthetic"),
        F.count_if(F.col("cluster_id") < 0).alias("isolated"), F.count_if(F.col("cluster_id").isNull()).alias("unclustered"), F.countDistinct("person_id").alias("n_persons"),
    )


# --- representatives ------------------------------------------------------


def _first(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__n = 1").drop("__n")


def area() -> Column:
    return F.col("w") * F.col("h")


def cover_faces(faces: DataFrame) -> DataFrame:
    """The cover of each person, else its largest face; the lowest id of equals."""
    return _first(faces.where(F.col("person_id").isNotNull() & live()), ["person_id"], F.col("is_cover").desc(), area().desc(), F.col("id"))


def representative_faces(faces: DataFrame) -> DataFrame:
    return _first(faces.where(F.col("cluster_id").isNotNull() & live()), ["cluster_id"], F.col("is_cover").desc(), area().desc(), F.col("id"))


def set_cover(faces: DataFrame, face_id: int) -> DataFrame:
    """The face becomes the only cover of its cluster."""
    own = faces.where(F.col("id") == face_id).select(F.col("cluster_id").alias("__c"))
    same = faces.join(F.broadcast(own), faces.cluster_id == F.col("__c"), "left")  # one row
    return same.withColumn("is_cover", F.when(F.col("__c").isNotNull(), F.col("id") == face_id).otherwise(F.col("is_cover"))).drop("__c")


def dedup_faces(faces: DataFrame, photos: DataFrame | None = None) -> DataFrame:
    """Of the faces of one person in one photo all but the largest are ignored; photos: (photo_id) of those to look at."""
    rank = F.row_number().over(Window.partitionBy("photo_id", "person_id").orderBy(area().desc(), "id"))
    candidate = F.col("person_id").isNotNull() & live()
    if photos is not None:
        marked = faces.join(photos.select("photo_id", F.lit(True).alias("__asked")).distinct(), "photo_id", "left").select(*faces.columns, "__asked")
        out = marked.withColumn("__rank", F.when(F.col("__asked") & candidate, F.row_number().over(Window.partitionBy("photo_id", "person_id", live()).orderBy(area().desc(), "id"))))
        return out.withColumn("ignored", F.when(F.col("__rank") > 1, True).otherwise(F.col("ignored"))).select(*faces.columns)
    ranked = faces.where(candidate).withColumn("ignored", rank > 1)
    return ranked.unionByName(faces.where(~candidate))


def restore_orphans(faces: DataFrame) -> DataFrame:
    """Where every face of a person in a photo is ignored, the largest is not any more."""
    by = Window.partitionBy("photo_id", "person_id")
    first = F.row_number().over(by.orderBy(area().desc(), "id")) == 1
    every = F.min(F.coalesce("ignored", F.lit(False))).over(by)
    named = faces.where("person_id is not null")
    fixed = named.withColumn("__r", every & first).withColumn("ignored", F.when(F.col("__r"), False).otherwise(F.col("ignored"))).drop("__r")
    return fixed.unionByName(faces.where("person_id is null"))


def least_sides(faces: DataFrame, sizes: DataFrame) -> DataFrame:
    """faces with __least, the side below which a face of the photo is too small.

    sizes: (photo_id, width, height). The base is 3 % of the photo's short side,
    at least 22. Faces of 20 % of it, and twice the base, are foreground; if there
    are any, a quarter of the smallest one's side counts in place of the base.
    Photos of unknown size have 121 for both.
    """
    side, short = F.least("w", "h"), F.least("width", "height")
    unknown = short.isNull()
    base = F.when(unknown, 121).otherwise(F.greatest(F.lit(22), F.floor(short * 0.03)))
    front = F.when(unknown, 121).otherwise(F.greatest(base * 2, F.floor(short * 0.20)))
    least_front = F.min(F.when(side >= front, side)).over(Window.partitionBy("photo_id"))
    return faces.join(sizes, "photo_id", "left").withColumn("__least", F.coalesce(least_front / 4.0, base.cast("double"))).select(*faces.columns, "__least")


def auto_ignore(faces: DataFrame, sizes: DataFrame, least_score: float = 0.65) -> DataFrame:
    """faces with auto_ignored: too small for the photo and its foreground faces, or of a low score."""
    return least_sides(faces, sizes).withColumn("auto_ignored", (F.least("w", "h") < F.col("__least")) | (F.col("det_score") < least_score)).select(*faces.columns, "auto_ignored")


def unignore_by_size(faces: DataFrame, sizes: DataFrame, least_score: float = 0.65) -> DataFrame:
    """Ignored faces with an embedding and no low score that are large enough by today's rule are not ignored any more."""
    good = F.col("has_embedding") & ~live() & (F.coalesce("det_score", F.lit(1.0)) >= least_score) & (F.least("w", "h") >= F.col("__least"))
    return least_sides(faces, sizes).withColumn("ignored", F.when(good, False).otherwise(F.col("ignored"))).select(*faces.columns)


def detections(raw: DataFrame, least_score: float = 0.5, least_side: int = 20) -> DataFrame:
    """Faces of a detector that count, in pixels of the whole photo. raw: (photo_id, x1, y1, x2, y2, score, scale, has_embedding); scale: of the picture the detector saw."""
    corner = {c: F.col(c).cast("long") for c in ("x1", "y1", "x2", "y2")}
    inverse = F.when(F.col("scale") == 1.0, F.lit(1.0)).otherwise(1.0 / F.col("scale"))
    box = {"x": corner["x1"], "y": corner["y1"], "w": corner["x2"] - corner["x1"], "h": corner["y2"] - corner["y1"]}
    whole = raw.where((F.col("score") >= least_score) & F.col("has_embedding")).select("photo_id", *((v * inverse).cast("long").alias(n) for n, v in box.items()), F.col("score").alias("det_score"))
    return whole.where((F.col("w") >= least_side) & (F.col("h") >= least_side))


# --- vectors --------------------------------------------------------------


def centroids(vectors: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, centroid): mean of the raw vectors, place by place; partial sums per task."""
    flat = vectors.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, F.posexplode("embedding").alias("pos", "v"))
    mean = flat.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return mean.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("centroid"))  # as long as a vector


def best_person(clusters: DataFrame, persons: DataFrame, exclude: str | None = None) -> DataFrame:
    """(cluster_id, person_id, score): the nearest person centroid of each cluster centroid."""
    left = clusters.select(F.col("cluster_id").alias("id"), F.col("centroid").alias("vector"), *([F.col(exclude)] if exclude else []))
    right = persons.select(F.col("person_id").alias("id"), F.col("centroid").alias("vector"))
    return blocks.cosine_best(left, right, exclude=exclude).select(F.col("id").alias("cluster_id"), F.col("best").alias("person_id"), "score")


def tier(score, tiers: Tiers) -> Column:
    s = C.col(score)
    return F.when(s >= tiers.assign, "assign").when(s >= tiers.suggest, "suggest").otherwise("none")


def apply_suggestions(faces: DataFrame, best: DataFrame, tiers: Tiers) -> DataFrame:
    """Faces after suggestions by cluster: the assign tier names them, the suggest tier marks them; what is set stays."""
    b = best.select("cluster_id", F.col("person_id").alias("__p"), F.col("score").alias("__s"))
    j = faces.join(b, "cluster_id", "left")
    free = F.col("person_id").isNull() & F.col("suggestion_person_id").isNull() & F.col("__s").isNotNull()
    sure, maybe = free & (F.col("__s") >= tiers.assign), free & (F.col("__s") >= tiers.suggest) & (F.col("__s") < tiers.assign)
    j = j.withColumns({"__sure": F.coalesce(sure, F.lit(False)), "__maybe": F.coalesce(maybe, F.lit(False))})
    j = j.withColumns({"person_id": F.when(F.col("__sure"), F.col("__p")).otherwise(F.col("person_id")), "suggestion_person_id": F.when(F.col("__maybe"), F.col("__p")).otherwise(F.col("suggestion_person_id")), "suggestion_score": F.when(F.col("__maybe"), F.col("__s")).otherwise(F.col("suggestion_score"))})
    return dedup_faces(j.select(*faces.columns), j.where("__sure").select("photo_id"))


def find_similar(faces: DataFrame, vectors: DataFrame, tiers: Tiers = Tiers()) -> tuple[DataFrame, DataFrame]:
    """(best person of each unnamed cluster that reaches the suggest tier, one row of n_made and n_checked). vectors: (face_id, embedding)."""
    v = faces.join(vectors.select(F.col("face_id").alias("id"), "embedding"), "id").select("cluster_id", "person_id", "suggestion_person_id", "ignored", "embedding")
    clusters = centroids(v.where(F.col("person_id").isNull() & F.col("suggestion_person_id").isNull() & live()), "cluster_id")
    best = best_person(clusters, centroids(v, "person_id"))
    made = best.where(F.col("score") >= tiers.suggest)
    counts = clusters.join(made.select("cluster_id", F.lit(1).alias("made")), "cluster_id", "left").agg(F.count("made").alias("n_made"), F.count("*").alias("n_checked"))
    return made, counts


def resuggested(faces: DataFrame, vectors: DataFrame, clusters: DataFrame, exclude: int | None = None, tiers: Tiers = Tiers()) -> DataFrame:
    """Faces after the suggestions of some clusters (cluster_id) were cleared and made anew, one person left out."""
    asked = clusters.select("cluster_id", F.lit(True).alias("__asked")).distinct()
    j = faces.join(asked, "cluster_id", "left")
    cleared = j.withColumns({c: F.when(F.col("__asked").isNull(), F.col(c)) for c in ("suggestion_person_id", "suggestion_score")}).select(*faces.columns)
    v = faces.join(vectors.select(F.col("face_id").alias("id"), "embedding"), "id").select("cluster_id", "person_id", "embedding")
    others = v if exclude is None else v.where(F.col("person_id") != exclude)
    best = best_person(centroids(v.join(asked.select("cluster_id"), "cluster_id", "left_semi"), "cluster_id"), centroids(others, "person_id"))
    return apply_suggestions(cleared, best.where(F.col("score") > 0), tiers)


def unsuggested_isolated(faces: DataFrame) -> DataFrame:
    """Isolated faces without person and suggestion."""
    return faces.where((F.col("cluster_id") < 0) & F.col("person_id").isNull() & F.col("suggestion_person_id").isNull())


def unassigned_natural(faces: DataFrame) -> DataFrame:
    """Unnamed faces of clusters that stand for no person."""
    return faces.where((F.col("cluster_id") > 0) & (F.col("cluster_id") < SYNTHETIC) & F.col("person_id").isNull())


def best_of_pairs(vectors: DataFrame) -> DataFrame:
    """(cluster_id, person_id, score): for each unnamed cluster the person with the nearest centroid of any of its clusters; centroids by person and cluster."""
    pairs = centroids(vectors, "person_id", "cluster_id").select("person_id", "centroid", F.struct("person_id", "cluster_id").alias("pair"))
    known = numbered(pairs, "pair")
    left = centroids(vectors.where("person_id is null"), "cluster_id").select(F.col("cluster_id").alias("id"), F.col("centroid").alias("vector"))
    near = blocks.cosine_best(left, known.select(F.col("n").alias("id"), F.col("centroid").alias("vector")))
    return near.join(known.select(F.col("n").alias("best"), "person_id"), "best").select(F.col("id").alias("cluster_id"), "person_id", "score")


def best_of_selection(best: DataFrame, clusters: DataFrame) -> DataFrame:
    """(person_id, score): the strongest suggestion among selected clusters."""
    top = best.join(clusters.select("cluster_id").distinct(), "cluster_id", "left_semi").agg(F.max(F.struct("score", (-F.col("person_id")).alias("p"))).alias("t"))
    return top.where("t is not null").select((-F.col("t.p")).alias("person_id"), F.col("t.score").alias("score"))


def embeddings_to_cluster(faces: DataFrame, unnamed_only: bool = False) -> DataFrame:
    """Faces that a clustering run looks at."""
    wanted = F.col("has_embedding") & live() & unpinned()
    return faces.where(wanted & F.col("person_id").isNull() if unnamed_only else wanted)


def with_rotation(faces: DataFrame, indexed: DataFrame) -> DataFrame:
    """Faces with the rotation at which their photo was indexed; placeholders have 0. indexed: (photo_id, rotation)."""
    j = faces.join(indexed.select("photo_id", F.col("rotation").alias("__r")), "photo_id", "left")
    return j.select(*faces.columns, F.when(F.col("has_embedding"), F.coalesce("__r", F.lit(0))).otherwise(0).alias("detected_rotation"))


def set_ignored(faces: DataFrame, ids: DataFrame, value: bool = True) -> DataFrame:
    """Ignoring a face drops its suggestion; taking that back does not bring it again."""
    hit = F.col("__hit").isNotNull()
    j = faces.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    changes = {"ignored": F.when(hit, value).otherwise(F.col("ignored"))}
    if value:
        changes |= {c: F.when(~hit, F.col(c)) for c in ("suggestion_person_id", "suggestion_score")}
    return j.withColumns(changes).select(*faces.columns)


def summed(vectors: DataFrame, key: str) -> DataFrame:
    """(key, n, total): sums of vectors, from which centroids follow and which changes update."""
    flat = vectors.where(f"{key} is not null").select(key, F.posexplode("embedding").alias("pos", "v"))
    sums = flat.groupBy(key, "pos").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").alias("n"))
    return sums.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda t: t["s"]).alias("total"))  # as long as a vector


def updated_sums(sums: DataFrame, added: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Sums after vectors came and went; only the changes are read."""
    minus = summed(removed, key).select(key, (-F.col("n")).alias("n"), F.transform("total", lambda x: -x).alias("total"))
    changes = sums.unionByName(summed(added, key)).unionByName(minus).select(key, "n", F.posexplode("total").alias("pos", "s"))
    per = changes.groupBy(key, "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return per.groupBy(key).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda t: t["s"]).alias("total")).where("n > 0")


def group_similarity(vectors: DataFrame, key: str) -> DataFrame:
    """(key, n, similarity): mean cosine of all pairs of a group, from the sum of its unit vectors."""
    unit = vectors.select(key, "embedding", C.norm("embedding").alias("l")).where(f"{key} is not null and l > 1e-8")
    flat = unit.select(key, "l", F.posexplode("embedding").alias("pos", "v"))
    sums = flat.groupBy(key, "pos").agg(F.sum(F.col("v").cast("double") / F.col("l")).alias("s"), F.count("*").alias("n"))
    total = sums.groupBy(key).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q")).where("n > 1")
    return total.select(key, "n", ((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("similarity"))


# --- boxes ----------------------------------------------------------------


def box_pairs(left: DataFrame, right: DataFrame, least: float, on: tuple[str, ...] = ("photo_id",)) -> DataFrame:
    """(photo_id, a, b, iou) of boxes of one photo that overlap enough."""
    a, b = left.alias("a"), right.alias("b")
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]
    score = C.iou(tuple(f"a.{c}" for c in BOX), tuple(f"b.{c}" for c in BOX))
    return a.join(b, cond).select(F.col("a.photo_id").alias("photo_id"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), score.alias("iou")).where(F.col("iou") > least)


def match_scores(annotations: DataFrame, faces: DataFrame, least: float = 0.30) -> DataFrame:
    """(photo_id, annotation, face, score): 1 + IoU if the centre of one is in the other, else an IoU of least or more."""
    a, f = annotations.alias("a"), faces.alias("f")
    fb, ab = tuple(f"f.{c}" for c in BOX), tuple(f"a.{c}" for c in BOX)
    value = C.iou(ab, fb)
    score = F.when(C.centre_inside(fb, ab) | C.centre_inside(ab, fb), 1.0 + value).when(value >= least, value)
    return a.join(f, F.col("a.photo_id") == F.col("f.photo_id")).select(F.col("a.photo_id").alias("photo_id"), F.col("a.id").alias("annotation"), F.col("f.id").alias("face"), score.alias("score")).where("score is not null")


def greedy_matches(scores: DataFrame) -> DataFrame:
    """(photo_id, annotation, face, score): annotations in order of id take their best free face.

    Photos follow one another in sorted partitions, so that one pass over each
    settles them all; what is held is one photo's taken faces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        photo = last = None
        used = set()
        for batch in batches:
            taken = []
            for i, (p, a, f) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if p != photo:
                    photo, last, used = p, None, set()
                if a != last and f not in used:
                    last = a
                    used.add(f)
                    taken.append(i)
            yield batch.take(pa.array(taken, pa.int64()))

    rows = scores.select("photo_id", "annotation", "face", "score")
    ordered = rows.repartition("photo_id").sortWithinPartitions("photo_id", "annotation", F.col("score").desc(), "face")
    return ordered.mapInArrow(run, rows.schema).select(*scores.columns)


# --- state changes --------------------------------------------------------


def propagate_person(faces: DataFrame) -> DataFrame:
    """Unnamed faces of a cluster take the lowest person of the cluster, which is joined by key after pre-aggregation."""
    named = cluster_persons(faces).withColumnRenamed("person_id", "__p")
    return faces.join(named, "cluster_id", "left").withColumn("person_id", F.coalesce("person_id", "__p")).select(*faces.columns)


def update_clusters(faces: DataFrame, labels: DataFrame) -> DataFrame:
    """Faces after a clustering run; labels: (id, label), -1 for noise.

    Unnamed faces that are not pinned lose cluster and suggestion first. Named
    faces with an embedding that end up in no cluster lose their person, and
    persons spread within clusters.
    """
    free = unpinned() & F.col("person_id").isNull()
    cleared = faces.withColumns({c: F.when(~free, F.col(c)) for c in ("cluster_id", "suggestion_person_id", "suggestion_score")})
    marked = cleared.join(labels.select("id", "label"), "id", "left")
    marked = marked.withColumn("cluster_id", F.when(F.col("label").isNotNull(), F.when(F.col("label") >= 0, F.col("label"))).otherwise(F.col("cluster_id")).cast("long")).select(*faces.columns)
    adrift = unpinned() & F.col("cluster_id").isNull() & F.col("has_embedding")
    return dedup_faces(propagate_person(marked.withColumn("person_id", F.when(~adrift, F.col("person_id")))))


def synthetic_clusters(faces: DataFrame) -> DataFrame:
    """Every named face is in the cluster that stands for its person."""
    natural = F.col("person_id").isNotNull() & (F.col("cluster_id").isNull() | (F.col("cluster_id") < SYNTHETIC))
    return faces.withColumn("cluster_id", F.when(natural, F.col("person_id") + SYNTHETIC).otherwise(F.col("cluster_id")))


def merge_persons(faces: DataFrame, source: int, target: int) -> DataFrame:
    named = F.when(F.col("person_id") == source, target).otherwise(F.col("person_id")).cast("long")
    hinted = F.when(F.col("suggestion_person_id") == source, target).otherwise(F.col("suggestion_person_id")).cast("long")
    return dedup_faces(faces.withColumns({"person_id": named, "suggestion_person_id": hinted}), faces.where(F.col("person_id") == source).select("photo_id"))


def merge_clusters(faces: DataFrame, source: int, target: int) -> DataFrame:
    return faces.withColumn("cluster_id", F.when(F.col("cluster_id") == source, target).otherwise(F.col("cluster_id")).cast("long"))


def isolate(faces: DataFrame, ids: DataFrame) -> DataFrame:
    """Faces of ids get clusters of their own, numbered downwards below every pinned one, in order of id."""
    lowest = faces.agg(F.least(F.coalesce(F.min(F.when(~unpinned(), F.col("cluster_id"))), F.lit(0)), F.lit(0)).alias("low")).first().low
    j = faces.join(numbered(ids.select("id").distinct(), "id", "__n"), "id", "left")
    hit = F.col("__n").isNotNull()
    return j.withColumns({"cluster_id": F.when(hit, F.lit(lowest) - F.col("__n")).otherwise(F.col("cluster_id")), "pinned": F.when(hit, True).otherwise(F.col("pinned")), "person_id": F.when(~hit, F.col("person_id"))}).select(*faces.columns)


def noise_to_singletons(labels: DataFrame) -> DataFrame:
    """Label -1 becomes labels of their own after the largest one, in order of id."""
    top = labels.agg(F.coalesce(F.max("label"), F.lit(-1)).alias("top")).first().top
    noise = numbered(labels.where("label = -1").select("id"), "id")
    return labels.where("label <> -1").unionByName(noise.select("id", (F.lit(top) + F.col("n")).cast(labels.schema["label"].dataType).alias("label")))


def assign_person(faces: DataFrame, ids: DataFrame, person_id: int) -> DataFrame:
    j = faces.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    named = j.withColumn("person_id", F.when(F.col("__hit"), person_id).otherwise(F.col("person_id")).cast("long")).select(*faces.columns)
    return dedup_faces(named, j.where("__hit").select("photo_id"))


def assign_cluster(faces: DataFrame, cluster_id: int, person_id: int) -> DataFrame:
    return assign_person(faces, faces.where(F.col("cluster_id") == cluster_id).select("id"), person_id)


def unassign_person(faces: DataFrame, person_id: int) -> DataFrame:
    return faces.withColumn("person_id", F.when(F.col("person_id") != person_id, F.col("person_id")))


def accept_suggestion(faces: DataFrame, cluster_id: int) -> DataFrame:
    """All faces of a cluster get the person that is suggested for it, the lowest of several."""
    own = F.col("cluster_id") == cluster_id
    found = faces.where(own).agg(F.min("suggestion_person_id").alias("p")).first().p
    if found is None:
        return faces
    hit = F.coalesce(own, F.lit(False))
    accepted = faces.withColumns({"person_id": F.when(hit, found).otherwise(F.col("person_id")).cast("long"), "suggestion_person_id": F.when(~hit, F.col("suggestion_person_id")), "suggestion_score": F.when(~hit, F.col("suggestion_score"))})
    return dedup_faces(accepted, faces.where(own).select("photo_id"))


def clear_suggestion(faces: DataFrame, cluster_id: int) -> DataFrame:
    hit = F.col("cluster_id") == cluster_id
    keep = ~F.coalesce(hit, F.lit(False))
    return faces.withColumns({"suggestion_person_id": F.when(keep, F.col("suggestion_person_id")), "suggestion_score": F.when(keep, F.col("suggestion_score"))})


def ignore_cluster(faces: DataFrame, cluster_id: int, value: bool = True) -> DataFrame:
    hit = F.coalesce(F.col("cluster_id") == cluster_id, F.lit(False))
    return faces.withColumns({"ignored": F.when(hit, value).otherwise(F.col("ignored")), "suggestion_person_id": F.when(~hit, F.col("suggestion_person_id"))})


def orphan_persons(faces: DataFrame, persons: DataFrame) -> DataFrame:
    """Faces of persons that no longer exist are unnamed; nothing changes if there are no persons at all."""
    known = persons.select(F.col("id").alias("person_id"), F.lit(True).alias("__known")).distinct()
    if known.isEmpty():
        return faces
    return faces.join(known, "person_id", "left").withColumn("person_id", F.when(F.col("__known"), F.col("person_id"))).select(*faces.columns)


def to_index(photos: DataFrame, indexed: DataFrame, errors: DataFrame) -> DataFrame:
    """Images that are neither indexed nor failed."""
    return photos.where(~C.is_video("path")).join(indexed, "path", "left_anti").join(errors, "path", "left_anti")


def unassign_from_cluster(faces: DataFrame, cluster_id: int, person_id: int) -> DataFrame:
    hit = F.coalesce((F.col("cluster_id") == cluster_id) & (F.col("person_id") == person_id), F.lit(False))
    return faces.withColumn("person_id", F.when(~hit, F.col("person_id")))


def unassign_faces(faces: DataFrame, ids: DataFrame, keep_cluster: bool = False) -> DataFrame:
    """Faces lose their person and, unless keep_cluster is set, their cluster and pin."""
    j = faces.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    free = F.col("__hit").isNotNull()
    values = {"person_id": F.when(~free, F.col("person_id"))}
    if not keep_cluster:
        values |= {"cluster_id": F.when(~free, F.col("cluster_id")), "pinned": F.when(free, False).otherwise(F.col("pinned"))}
    return j.withColumns(values).select(*faces.columns)


def isolate_and_assign(faces: DataFrame, ids: DataFrame, person_id: int) -> DataFrame:
    return assign_person(isolate(faces, ids), ids, person_id)


def set_suggestions_null(faces: DataFrame, ids: DataFrame) -> DataFrame:
    j = faces.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return j.withColumns({c: F.when(F.col("__hit").isNull(), F.col(c)) for c in ("suggestion_person_id", "suggestion_score")}).select(*faces.columns)


def isolate_and_suggest(faces: DataFrame, ids: DataFrame, best: DataFrame, least: float) -> DataFrame:
    """Faces of ids are isolated and lose their suggestions; best (id, person_id, score) is suggested where the score reaches least."""
    apart = set_suggestions_null(isolate(faces, ids), ids)
    b = best.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("score") >= least).select("id", F.col("person_id").alias("__p"), F.col("score").alias("__s"))
    j = apart.join(b, "id", "left")
    return j.withColumns({"suggestion_person_id": F.coalesce("__p", "suggestion_person_id"), "suggestion_score": F.coalesce("__s", "suggestion_score")}).select(*faces.columns)


def add_face(faces: DataFrame, face: DataFrame) -> DataFrame:
    return faces.unionByName(face, allowMissingColumns=True)


def delete_faces(faces: DataFrame, ids: DataFrame) -> DataFrame:
    return faces.join(ids.select("id"), "id", "left_anti").select(*faces.columns)


def regrouped_singletons(best: DataFrame, sizes: DataFrame) -> DataFrame:
    """(person_id, clusters): clusters of one face that have the same suggested person, if there are at least two."""
    single = best.join(sizes.where("n = 1").select("cluster_id"), "cluster_id", "left_semi")
    return single.groupBy("person_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("cluster_id")).alias("clusters")).where("n > 1").select("person_id", "clusters")


def panel_order(faces: DataFrame) -> DataFrame:
    """Named faces first, then from left to right."""
    return faces.orderBy(F.col("person_id").isNull(), "x", "id")


def group_order(groups: DataFrame) -> DataFrame:
    """Largest groups first, by clusters and then by faces. groups: (group_id, n_clusters, n_faces)."""
    return groups.orderBy(F.col("n_clusters").desc(), F.col("n_faces").desc(), "group_id")
