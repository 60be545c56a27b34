"""Keeping face tables current: errors, re-detection, placeholders, boxes after edits; and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from shutterlake.functions import columns as C
from shutterlake.operators import faces as P
from shutterlake.sources.snapshots import newest


def mark_errors(errors: DataFrame, new: DataFrame) -> DataFrame:
    """errors: (path, error_type, last_attempt, excluded). New failures replace old ones; an exclusion stays."""
    kept = new.join(errors.select("path", F.col("excluded").alias("__was")), "path", "left").withColumn("excluded", F.coalesce("__was", F.lit(False)))
    return newest(errors, kept.select(*errors.columns), "path")


def errors_of(errors: DataFrame, excluded: bool | None = None) -> DataFrame:
    """Failed photos; all, or only those that are excluded or not."""
    return errors if excluded is None else errors.where(F.coalesce("excluded", F.lit(False)) == excluded)


def index_outcomes(outcomes: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(indexed photos, errors) after a run: (path, error_type, n_faces, rotation, at); a photo that now works is no error any more."""
    worked = outcomes.where("error_type is null")
    failed = outcomes.where("error_type is not null").select("path", "error_type", F.col("at").alias("last_attempt"), F.lit(False).alias("excluded"))
    left = errors.join(worked.select("path"), "path", "left_anti").select(*errors.columns)
    return worked.select("path", F.col("at").alias("indexed_at"), F.col("n_faces").alias("face_count"), "rotation"), mark_errors(left, failed)


def set_excluded(errors: DataFrame, paths: DataFrame, excluded: bool, now: float) -> DataFrame:
    """A photo without an error gets a row only to be excluded."""
    hit = paths.select("path").distinct().withColumn("__hit", F.lit(True))
    changed = errors.join(hit, "path", "left").withColumn("excluded", F.when(F.col("__hit"), excluded).otherwise(F.col("excluded"))).select(*errors.columns)
    if not excluded:
        return changed
    added = hit.join(errors, "path", "left_anti").select("path", F.lit("excluded").alias("error_type"), F.lit(now).alias("last_attempt"), F.lit(True).alias("excluded"))
    return changed.unionByName(added)


def redetected(old: DataFrame, new: DataFrame, least: float = 0.30) -> DataFrame:
    """New detections of photos with the person, cluster and state of the old face they overlap most, one to one.

    old and new: (id, photo_id, x, y, w, h, ...); what is carried over are the
    columns of old that new has too, apart from the box, score and ids.
    """
    pairs = P.box_pairs(new, old, least).select("photo_id", F.col("a").alias("annotation"), F.col("b").alias("face"), F.col("iou").alias("score"))
    matched = P.greedy_matches(pairs).select(F.col("annotation").alias("id"), F.col("face").alias("__old"))
    carried = [c for c in ("person_id", "cluster_id", "ignored", "pinned", "is_cover", "suggestion_person_id", "suggestion_score") if c in old.columns and c in new.columns]
    before = old.select(F.col("id").alias("__old"), *(F.col(c).alias(f"__{c}") for c in carried))
    joined = new.join(matched, "id", "left").join(before, "__old", "left")
    return joined.select(*(F.when(F.col("__old").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in carried else F.col(c) for c in new.columns))


def without_placeholders(faces: DataFrame, least: float = 0.30) -> DataFrame:
    """Faces without placeholders (no embedding) that overlap a real face; its person takes over where the real face has none, and both stay where persons differ."""
    real, dummy = faces.where("has_embedding"), faces.where("not has_embedding")
    over = P.box_pairs(dummy, real, least).select("photo_id", F.col("a").alias("dummy"), F.col("b").alias("real"), "iou")
    dp, rp = dummy.select(F.col("id").alias("dummy"), F.col("person_id").alias("dp")), real.select(F.col("id").alias("real"), F.col("person_id").alias("rp"))
    best = F.row_number().over(Window.partitionBy("dummy").orderBy(F.col("iou").desc(), "real"))
    fit = over.join(dp, "dummy").join(rp, "real").where("rp is null or dp is null or rp = dp").withColumn("n", best).where("n = 1")
    gift = fit.groupBy("real").agg(F.min("dp").alias("__gift"))
    left = faces.join(fit.select(F.col("dummy").alias("id")), "id", "left_anti")
    return left.join(gift, left.id == gift.real, "left").withColumn("person_id", F.coalesce("person_id", "__gift")).select(*faces.columns)


def remapped(faces: DataFrame, updates: DataFrame, gone: DataFrame) -> DataFrame:
    """Faces after a photo was saved with geometry: new boxes by id, lost faces gone."""
    u = updates.select("id", *(F.col(c).alias(f"__{c}") for c in P.BOX))
    kept = faces.join(gone.select("id"), "id", "left_anti").join(u, "id", "left")
    return kept.select(*(F.coalesce(f"__{c}", c).alias(c) if c in P.BOX else F.col(c) for c in faces.columns))


def best_rotation(detections: DataFrame) -> DataFrame:
    """(photo_id, rotation): 0 if that finds a face, else the quarter turn with most faces, the smallest of equals. detections: (photo_id, rotation, n_faces)."""
    upright = F.max(F.when(F.col("rotation") == 0, F.col("n_faces")))
    most = F.max_by("rotation", F.struct("n_faces", -F.col("rotation")))
    return detections.groupBy("photo_id").agg(F.when(upright > 0, 0).otherwise(most).alias("rotation"))


def export_names(photos: DataFrame, existing: DataFrame) -> DataFrame:
    """(id, name): file names for an export; a taken or repeated name gets _1, _2, ... in order of id."""
    stem, ext = F.regexp_replace("filename", r"\.[^.]*$", ""), C.extension("filename")
    base = photos.select("id", stem.alias("stem"), ext.alias("ext"))
    taken = existing.select(F.col("name").alias("__taken")).distinct()
    plain = F.concat("stem", F.lit("."), "ext")
    marked = base.withColumn("plain", plain).join(taken, F.col("plain") == F.col("__taken"), "left")
    n = F.row_number().over(Window.partitionBy("plain").orderBy("id")) - F.when(F.col("__taken").isNull(), 1).otherwise(0)
    return marked.withColumn("n", n).select("id", F.when(F.col("n") == 0, F.col("plain")).otherwise(F.concat("stem", F.lit("_"), F.col("n").cast("string"), F.lit("."), "ext")).alias("name"))


def duplicate_report(photos: DataFrame) -> DataFrame:
    """(html): one table row per duplicate group, members in order of path."""
    member = F.format_string("<li>%s (%d x %d)</li>", "path", "width", "height")
    rows = photos.where("duplicate_group_id is not null").groupBy("duplicate_group_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", member.alias("m")))), lambda s: s["m"]), "").alias("items"))
    return rows.where("n > 1").select(F.format_string("<tr><td>%d</td><td>%d</td><td><ul>%s</ul></td></tr>", "duplicate_group_id", "n", "items").alias("html"))
