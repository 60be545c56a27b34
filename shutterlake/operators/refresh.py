"""The refresh of the cluster view: unnamed clusters, groups of like ones, and the person each group may be."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shutterlake.operators import clustering, faces as P


def flat(faces: DataFrame) -> DataFrame:
    """First phase: (cluster_id, n) of unnamed clusters."""
    return P.unnamed_clusters(faces)


def grouped(faces: DataFrame, vectors: DataFrame, tiers: P.Tiers = P.Tiers()) -> DataFrame:
    """Second phase: (cluster_id, n, group_id, person_id, score, tier) of unnamed clusters.

    Clusters whose centroids are alike share a group; a group's person is that
    of its cluster with the highest score. vectors: (face_id, embedding).
    """
    v = faces.join(vectors.select(F.col("face_id").alias("id"), "embedding"), "id").select("cluster_id", "person_id", "ignored", "pinned", "embedding")
    means = P.centroids(v.where(F.col("person_id").isNull() & P.live() & P.unpinned()), "cluster_id")
    groups = clustering.cosine_groups(means, tiers.group, "cluster_id", "centroid").select(F.col("id").alias("cluster_id"), "group_id")
    best = P.best_person(means, P.centroids(v, "person_id"))
    of_group = groups.join(best, "cluster_id").groupBy("group_id").agg(F.max(F.struct("score", (-F.col("person_id")).alias("p"))).alias("t"))
    named = groups.join(of_group, "group_id", "left").select("cluster_id", "group_id", (-F.col("t.p")).alias("person_id"), F.col("t.score").alias("score"))
    return flat(faces).join(named, "cluster_id", "left").select("cluster_id", "n", F.coalesce("group_id", "cluster_id").alias("group_id"), "person_id", "score", P.tier(F.coalesce("score", F.lit(0.0)), tiers).alias("tier"))


def promoted(faces: DataFrame, view: DataFrame, tiers: P.Tiers = P.Tiers()) -> DataFrame:
    """Faces after the suggestions of a refreshed view."""
    return P.apply_suggestions(faces, view.where("person_id is not null").select("cluster_id", "person_id", "score"), tiers)


def changed_since(faces: DataFrame, unidentified_before: int) -> bool:
    """False if as many faces are unidentified as at the last clustering run, which then need not run again."""
    return P.embeddings_to_cluster(faces, unnamed_only=True).count() != unidentified_before
