"""Boxes that another program drew around persons, and how they name detected faces.

annotations: (id, photo_id, x, y, w, h, person_id, consumed). faces have
has_embedding; a face without one is a placeholder for an annotation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shutterlake.functions import columns as C
from shutterlake.operators import faces as P

#: From this IoU on two boxes are of one face.
LEAST_IOU = 0.30


def same_place(a: str, f: str) -> Column:
    """True if the centre of one box lies in the other, or the boxes overlap by more than LEAST_IOU."""
    ab, fb = tuple(f"{a}.{c}" for c in P.BOX), tuple(f"{f}.{c}" for c in P.BOX)
    return C.centre_inside(fb, ab) | C.centre_inside(ab, fb) | (C.iou(ab, fb) > LEAST_IOU)


def _consume(annotations: DataFrame, hits: DataFrame) -> DataFrame:
    """Annotations whose ids are in hits are consumed."""
    marked = annotations.join(hits.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return marked.withColumn("consumed", F.col("consumed") | F.coalesce("__hit", F.lit(False))).select(*annotations.columns)


def consumed_by_person(annotations: DataFrame, faces: DataFrame) -> DataFrame:
    """Annotations are consumed by a face in the same place that already has their person."""
    a, f = annotations.where("not consumed").alias("a"), faces.where("person_id is not null and has_embedding").alias("f")
    met = a.join(f, (F.col("a.photo_id") == F.col("f.photo_id")) & (F.col("a.person_id") == F.col("f.person_id"))).where(same_place("a", "f"))
    return _consume(annotations, met.select("a.id"))


def applied(annotations: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, annotations) after free annotations have named unnamed faces, each the best face that is left, in order of id."""
    free = faces.where(F.col("person_id").isNull() & P.live())
    taken = P.greedy_matches(P.match_scores(annotations.where("not consumed"), free, LEAST_IOU))
    named = taken.join(annotations.select(F.col("id").alias("annotation"), F.col("person_id").alias("__p")), "annotation").select(F.col("face").alias("id"), "__p")
    out = faces.join(named, "id", "left").withColumn("person_id", F.coalesce("__p", "person_id")).select(*faces.columns)
    return out, _consume(annotations, taken.select(F.col("annotation").alias("id")))


def released(annotations: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Annotations of a person that a face of their photo lost are free again."""
    lost = before.where("person_id is not null").join(after.where("person_id is null").select("id"), "id", "left_semi").select("photo_id", "person_id", F.lit(True).alias("__lost")).distinct()
    marked = annotations.join(lost, ["photo_id", "person_id"], "left")
    return marked.withColumn("consumed", F.col("consumed") & F.col("__lost").isNull()).select(*annotations.columns)


def saved(annotations: DataFrame, faces: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(faces, annotations) after annotations of some photos were imported: new replaces all that the photos had.

    They name faces where they can; those of persons that the photo's faces
    already have, or in the place of a detected face, are consumed; the rest
    get placeholders, and older placeholders of the photos that nobody pinned go.
    """
    photos = new.select("photo_id").distinct()
    fresh = new.withColumn("consumed", F.lit(False)).select(*annotations.columns)
    others = faces.join(photos, "photo_id", "left_anti").select(*faces.columns)
    named, fresh = applied(fresh, faces.join(photos, "photo_id", "left_semi").select(*faces.columns))
    real = named.where("has_embedding")
    known = fresh.where("not consumed").join(real.where("person_id is not null").select("photo_id", "person_id"), ["photo_id", "person_id"], "left_semi")
    fresh = _consume(fresh, known)
    a, f = fresh.where("not consumed").alias("a"), real.alias("f")
    fresh = _consume(fresh, a.join(f, F.col("a.photo_id") == F.col("f.photo_id")).where(same_place("a", "f")).select("a.id"))
    kept = named.where(F.col("has_embedding") | ~P.unpinned())
    # A placeholder's id is that of its annotation, below all ids of faces.
    places = fresh.where("not consumed").select((-F.col("id") - 1).alias("id"), "photo_id", *P.BOX, "person_id", F.lit(False).alias("has_embedding"), F.lit(False).alias("ignored"), F.lit(False).alias("pinned"))
    out = others.unionByName(kept).unionByName(places, allowMissingColumns=True)
    return out, annotations.join(photos, "photo_id", "left_anti").select(*annotations.columns).unionByName(fresh)


def merged_persons(annotations: DataFrame, source: int, target: int) -> DataFrame:
    return annotations.withColumn("person_id", F.when(F.col("person_id") == source, target).otherwise(F.col("person_id")).cast("long"))


def of_known_persons(annotations: DataFrame, persons: DataFrame) -> DataFrame:
    """Annotations without those of persons that no longer exist; all stay if there are no persons at all."""
    known = persons.select(F.col("id").alias("person_id")).distinct()
    return annotations if known.isEmpty() else annotations.join(known, "person_id", "left_semi").select(*annotations.columns)


def imported_persons(sidecar_faces: DataFrame, contacts: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sidecar faces with person_id, names to be created): contacts name the hashes of sidecar faces, persons have ids by name.

    Faces of an unknown hash are left out; names that no person has yet get no id.
    """
    names = contacts.groupBy("hash").agg(F.min("name").alias("name"))
    named = sidecar_faces.join(names, "hash").join(persons.select(F.col("id").alias("person_id"), "name"), "name", "left")
    return named, named.where("person_id is null").select("name").distinct()


def import_statistics(sidecar_faces: DataFrame, edits: DataFrame, created: DataFrame) -> DataFrame:
    """(n_created, n_faces, n_photos, n_edits) of an import."""
    return (
        sidecar_faces.agg(F.count("*").alias("n_faces"), F.countDistinct("ini", "file").alias("n_photos"))
        .join(F.broadcast(edits.agg(F.count("*").alias("n_edits")))).join(F.broadcast(created.agg(F.count("*").alias("n_created"))))  # one row each
        .select("n_created", "n_faces", "n_photos", "n_edits")
    )
