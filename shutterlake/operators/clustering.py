"""Near-duplicate groups, threshold clusters and their purification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from shutterlake import scratch
from shutterlake.functions import columns as C
from shutterlake.operators import blocks
from shutterlake.operators.graph import connected_components
from shutterlake.operators.numbering import numbered


def duplicate_pairs(fingerprints: DataFrame, most: int = 10, day: str | None = "day", new: str | None = None) -> DataFrame:
    """(a, b, distance) of fingerprints within ``most`` bits whose known days do not differ."""
    pairs = blocks.hamming_pairs(fingerprints, most, new=new)
    if day is None:
        return pairs
    days = fingerprints.select("id", F.col(day).alias("d"))
    a, b = days.select(F.col("id").alias("a"), F.col("d").alias("da")), days.select(F.col("id").alias("b"), F.col("d").alias("db"))
    return pairs.join(a, "a").join(b, "b").where(~C.dates_differ("da", "db")).select("a", "b", "distance")


def groups(pairs: DataFrame) -> DataFrame:
    """(id, group_id) of every member; a group's id is its smallest member."""
    return connected_components(pairs, "a", "b").select(F.col("node").alias("id"), F.col("component").alias("group_id"))


def print_groups(fingerprints: DataFrame, most: int = 10, day: str = "day") -> DataFrame:
    """(id, group_id) of the groups that duplicate_pairs of (id, bits, day) join, without a pair for every two equal ones.

    Rows of one fingerprint and day are links of each other, so that one stands for them all; groups of one row are left out.
    """
    alike = fingerprints.groupBy("bits", F.col(day).alias("day")).agg(F.min("id").alias("id"), F.count("*").alias("n"))
    found = groups(duplicate_pairs(alike.select("id", "bits", "day"), most))
    named = alike.join(found, "id", "left").where("group_id is not null or n > 1").select(F.col("bits").alias("__bits"), F.col("day").alias("__day"), F.coalesce("group_id", "id").alias("group_id"))
    same = (fingerprints["bits"] == named["__bits"]) & fingerprints[day].eqNullSafe(named["__day"])
    return fingerprints.join(named, same).select("id", "group_id")


def verified_pairs(pairs: DataFrame, micros: DataFrame, most: float = 0.34) -> DataFrame:
    """Pairs (a, b, ...) whose small pictures differ little; micros: (id, micro). A pair without both pictures stays."""
    a, b = (micros.select(F.col("id").alias(n), F.col("micro").alias(f"__{n}")) for n in "ab")
    j = pairs.join(a, "a", "left").join(b, "b", "left")
    near = F.col("__a").isNull() | F.col("__b").isNull() | (micro_difference("__a", "__b") <= most)
    return j.where(near).select(*pairs.columns)


def renumbered(members: DataFrame) -> DataFrame:
    """(id, group_no): groups of several members numbered 1, 2, ... by their smallest member. members: (id, group_id)."""
    sizes = members.groupBy("group_id").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    places = numbered(sizes.select("group_id", "first"), "first", "group_no")
    return members.join(places.select("group_id", "group_no"), "group_id").select("id", "group_no")


def micro_difference(a, b):
    """Mean absolute difference of two small normalised images."""
    return F.aggregate(F.zip_with(C.col(a), C.col(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(C.col(a))


def cosine_groups(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "vector") -> DataFrame:
    """(id, group_id) of every row: components of the graph of cosines of threshold or more, lone rows included."""
    pairs = blocks.cosine_pairs(vectors, threshold, key, vector)
    found = groups(pairs)
    return vectors.select(F.col(key).alias("id")).join(found, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


#: Distinct vectors of a cluster up to which all distances are held at once.
MATRIX_ROWS = 2000
#: Bytes of rows of distances that are held beyond that.
ROW_BYTES = 64 << 20


def purify(frame: pd.DataFrame, least: float = 0.60, most_rows: int | None = None) -> pd.DataFrame:
    """Split one cluster by complete linkage so that all cosines inside a part reach ``least``; noise stays, and clusters of over most_rows if it is given."""
    out = frame[["id", "label"]].assign(part=0)
    n = len(frame)
    if n < 2 or (most_rows is not None and n > most_rows) or frame["label"].iloc[0] < 0:
        return out
    v = np.array(frame["vector"].tolist(), dtype=np.float64)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    limit = np.sqrt(2 * (1 - least))
    first = _linked_in_matrix(v, limit) if n <= MATRIX_ROWS else _linked_by_rows(v, limit)
    return out.assign(part=np.unique(first, return_inverse=True)[1])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors; products of any shape give the same ones."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.round(a @ b.T, 12)))


def _linked_in_matrix(v: np.ndarray, limit: float) -> np.ndarray:
    """The first member of each vector's part."""
    d = _distances(v, v)
    np.fill_diagonal(d, np.inf)
    first = np.arange(len(v))
    while True:
        i, j = np.unravel_index(np.argmin(d), d.shape)
        if not d[i, j] <= limit:
            return first
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        first[first == j] = i


def _linked_by_rows(v: np.ndarray, limit: float) -> np.ndarray:
    """The same as _linked_in_matrix, with some rows of distances at a time.

    Each part knows its nearest later part. Distances of parts only grow, so one
    that is out of date is a lower bound and is renewed when its turn comes.
    """
    n = len(v)
    first, members = np.arange(n), {i: [i] for i in range(n)}
    near, at, old = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    step = max(1, ROW_BYTES // (8 * n))
    for lo in range(0, n, step):
        d = _distances(v[lo : lo + step], v)
        d[np.arange(n)[None, :] <= np.arange(lo, lo + len(d))[:, None]] = np.inf
        at[lo : lo + step] = d.argmin(axis=1)
        near[lo : lo + step] = d.min(axis=1)
    rows: dict[int, np.ndarray] = {}

    def row(i: int) -> np.ndarray:
        """The largest distance of every vector from the members of part i."""
        if i not in rows:
            while len(rows) >= step:
                del rows[next(iter(rows))]
            rows[i] = np.maximum.reduce([_distances(v[members[i][k : k + step]], v).max(axis=0) for k in range(0, len(members[i]), step)])
        return rows[i]

    while True:
        i = int(near.argmin())
        if not near[i] <= limit:
            return first
        if old[i]:
            d = np.full(n, -np.inf)
            np.maximum.at(d, first, row(i))
            d[: i + 1] = np.inf
            d[d == -np.inf] = np.inf
            at[i], near[i], old[i] = d.argmin(), d.min(), False
            continue
        j = int(at[i])
        merged = np.maximum(row(i), row(j)) if i in rows and j in rows else None
        for k in (i, j):
            rows.pop(k, None)
        if merged is not None:
            rows[i] = merged
        first[members[j]] = i
        members[i] += members.pop(j)
        near[j] = np.inf
        old |= (at == i) | (at == j)
        old[i] = True


def purified(labelled: DataFrame, most_rows: int | None = None) -> DataFrame:
    """(id, label, part) from (id, label, vector), cluster by cluster; noise passes by and is never gathered.

    Equal vectors are of one part, so the lowest id of each stands for them all.
    most_rows: clusters of more rows are not cut up.
    """
    rows = labelled.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
    cut = rows.where("label >= 0")
    if most_rows is not None:
        cut = cut.join(cut.groupBy("label").count().where(F.col("count") <= most_rows).select("label"), "label", "left_semi")
    alike = scratch.written(cut.groupBy("label", "vector").agg(F.min("id").alias("id")), "vectors", gathered=True)
    several = alike.groupBy("label").count().where("count > 1").select("label")
    parts = alike.join(several, "label", "left_semi").groupBy("label").applyInPandas(lambda f: purify(f.sort_values("id").reset_index(drop=True)), "id long, label long, part long")
    named = alike.join(parts.select("id", "part"), "id").select(F.col("label").alias("__label"), F.col("vector").alias("__vector"), F.col("part").alias("__part"))
    same = (rows["label"] == named["__label"]) & (rows["vector"] == named["__vector"])
    return rows.join(named, same, "left").select("id", "label", F.coalesce("__part", F.lit(0).cast("long")).alias("part"))


def keypoint_matches(left: np.ndarray, right: np.ndarray, ratio: float = 0.75) -> int:
    """Number of left binary descriptors whose nearest right one is clearly nearer than the second."""
    if not len(left) or len(right) < 2:
        return 0
    d = np.bitwise_count(left[:, None, :] ^ right[None, :, :]).sum(axis=2, dtype=np.int64)
    two = np.partition(d, 1, axis=1)[:, :2]
    return int((two[:, 0] < ratio * two[:, 1]).sum())


def fingerprint_image(grey: np.ndarray) -> tuple[int, np.ndarray | None]:
    """(64-bit perceptual hash, 8x8 normalised thumbnail) of a grey image; no thumbnail if it is flat."""

    def resized(n: int) -> np.ndarray:
        rows = np.array_split(np.arange(grey.shape[0]), n) if grey.shape[0] >= n else [[i * grey.shape[0] // n] for i in range(n)]
        cols = np.array_split(np.arange(grey.shape[1]), n) if grey.shape[1] >= n else [[i * grey.shape[1] // n] for i in range(n)]
        return np.array([[grey[np.ix_(r, c)].mean() for c in cols] for r in rows])

    n = 32
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    low = (basis @ resized(n) @ basis.T)[:8, :8].ravel()
    bits = low > np.median(low[1:])
    micro = resized(8)
    deviation = micro.std()
    return int(sum(1 << i for i, b in enumerate(bits) if b)), (micro - micro.mean()) / deviation if deviation > 1e-6 else None
