"""Similarity joins without cross joins: rows meet in pairs of blocks, or under band keys."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS = 2000
#: Size up to which one side of a join by best cosine is held whole.
BROADCAST_BYTES = 32 << 20


def _block_count(df: DataFrame, rows: int) -> int:
    return max(1, -(-df.count() // rows))


def _unit(vectors) -> np.ndarray:
    v = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), -1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(n > 1e-8, v / np.where(n > 1e-8, n, 1.0), 0.0)


def cosine_pairs(df: DataFrame, threshold: float, key: str = "id", vector: str = "vector", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, score) for all a < b with a cosine of threshold or more, exactly.

    Rows are dealt to blocks; each pair of blocks is one small matrix product.
    """
    n = _block_count(df, block_rows)
    dealt = df.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").withColumn("block", F.pmod(F.xxhash64("k"), F.lit(n)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda o: F.struct(F.least(F.col("block"), o).alias("p"), F.greatest(F.col("block"), o).alias("q")))
    sent = dealt.select("k", "v", "block", F.explode(pairs).alias("pq")).select("k", "v", "block", "pq.p", "pq.q")

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = frame["p"].iloc[0], frame["q"].iloc[0]
        left = frame[frame["block"] == p]
        right = left if p == q else frame[frame["block"] == q]
        s = _unit(left["v"]) @ _unit(right["v"]).T if len(left) and len(right) else np.zeros((len(left), len(right)))
        i, j = np.nonzero(s >= threshold)
        a, b = left["k"].to_numpy()[i], right["k"].to_numpy()[j]
        keep = a < b if p == q else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": s[i, j][keep]})

    return sent.groupBy("p", "q").applyInPandas(match, "a long, b long, score double")


def cosine_best(left: DataFrame, right: DataFrame, key: str = "id", vector: str = "vector", exclude: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, best, score): for each left row the right row of the highest cosine; of equal scores the lowest id.

    exclude: a column of left with a right id that its row must not get. A right
    side of at most BROADCAST_BYTES, which is measured, goes to every task as one
    matrix; a larger one meets the left side in pairs of blocks.
    """
    rows, dims = right.agg(F.count("*"), F.max(F.size(vector))).first()
    if rows * max(dims or 0, 1) * 8 <= BROADCAST_BYTES:
        return _best_of_matrix(left, right, key, vector, exclude)
    na, nb = _block_count(left, block_rows), _block_count(right, block_rows)
    ban = F.col(exclude).cast("long") if exclude else F.lit(None).cast("long")
    both = ("long", "array<double>")
    lrows = left.select(F.col(key).cast(both[0]).alias("k"), F.col(vector).cast(both[1]).alias("v"), ban.alias("ban"), F.pmod(F.xxhash64(key), F.lit(na)).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("q"))
    rrows = right.select(F.col(key).cast(both[0]).alias("k"), F.col(vector).cast(both[1]).alias("v"), F.pmod(F.xxhash64(key), F.lit(nb)).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(na - 1))).alias("p"))
    rrows = rrows.withColumn("p", F.col("p").cast("long"))

    def match(lf: pd.DataFrame, rf: pd.DataFrame) -> pd.DataFrame:
        if not len(lf) or not len(rf):
            return pd.DataFrame({"id": [], "best": [], "score": []})
        rf = rf.sort_values("k")
        s = np.round(_unit(lf["v"]) @ _unit(rf["v"]).T, 12)
        ids = rf["k"].to_numpy()
        s = np.where(ids[None, :] == lf["ban"].to_numpy(dtype=np.float64)[:, None], -2.0, s)
        j = s.argmax(axis=1)
        out = pd.DataFrame({"id": lf["k"].to_numpy(), "best": ids[j], "score": s[np.arange(len(lf)), j]})
        return out[out["score"] > -2.0]

    met = lrows.groupBy("p", "q").cogroup(rrows.groupBy("p", "q")).applyInPandas(match, "id long, best long, score double")
    top = met.groupBy("id").agg(F.max(F.struct(F.col("score"), (-F.col("best")).alias("n"))).alias("t"))
    return top.select("id", (-F.col("t.n")).alias("best"), F.col("t.score").alias("score"))


def _best_of_matrix(left: DataFrame, right: DataFrame, key: str, vector: str, exclude: str | None) -> DataFrame:
    held = right.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").orderBy("k").toPandas()  # BROADCAST_BYTES at most
    shared = left.sparkSession.sparkContext.broadcast((held["k"].to_numpy(dtype=np.int64), _unit(held["v"]) if len(held) else np.zeros((0, 0))))
    ban = F.col(exclude).cast("double") if exclude else F.lit(None).cast("double")
    rows = left.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), ban.alias("ban")).where("v is not null")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for frame in frames:
            if not len(frame) or not len(ids):
                continue
            s = np.round(_unit(frame["v"]) @ matrix.T, 12)
            s[ids[None, :] == frame["ban"].to_numpy(dtype=np.float64)[:, None]] = -2.0
            j = s.argmax(axis=1)
            out = pd.DataFrame({"id": frame["k"].to_numpy(), "best": ids[j], "score": s[np.arange(len(frame)), j]})
            yield out[out["score"] > -2.0]

    return rows.mapInPandas(run, "id long, best long, score double")


def hamming_pairs(df: DataFrame, most: int, key: str = "id", bits: str = "bits", width: int = 64, new: str | None = None) -> DataFrame:
    """(a, b, distance) for all a < b within ``most`` bits, exactly, by bands.

    With m bands some band differs in at most most // m bits; m is the least
    with a radius of 2. One side is sent under all variants of its bands, the
    other under its own, so pairs meet by equality. The join is never a
    broadcast: Spark sizes a side before a row of it becomes hundreds of
    variants, and would build those in the driver. new: a boolean column; pairs
    of two rows that are not new are left out.
    """
    m = max(1, -(-(most + 1) // 3))
    radius = most // m
    edges = [width * i // m for i in range(m + 1)]
    fresh = F.col(new) if new else F.lit(True)
    base = df.select(F.col(key).alias("k"), F.col(bits).alias("x"), fresh.alias("fresh"))
    bands, probes = [], []
    for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
        value = F.shiftrightunsigned("x", lo).bitwiseAND(_signed((1 << (hi - lo)) - 1))
        masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(hi - lo), r)]
        bands.append(F.struct(F.lit(n).alias("n"), value.alias("band")))
        probes.append(_probe(n, value, masks))
    own = base.select("k", "x", "fresh", F.explode(F.array(*bands)).alias("s")).select("k", "x", "fresh", "s.*")
    sent = base.select(F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("fresh").alias("fresh2"), F.explode(F.concat(*probes)).alias("s")).select("k2", "x2", "fresh2", "s.*")
    met = own.join(sent.hint("merge"), ["n", "band"]).where((F.col("k") < F.col("k2")) & (F.col("fresh") | F.col("fresh2")))
    near = met.withColumn("distance", F.bit_count(F.col("x").bitwiseXOR(F.col("x2")))).where(F.col("distance") <= most)
    return near.select(F.col("k").alias("a"), F.col("k2").alias("b"), "distance").distinct()


def _signed(v: int) -> int:
    return v if v < 1 << 63 else v - (1 << 64)


def _probe(n: int, value, masks: list[int]):
    return F.transform(F.array(*(F.lit(_signed(v)).cast("long") for v in masks)), lambda mask: F.struct(F.lit(n).alias("n"), value.bitwiseXOR(mask).alias("band")))


def ratio_pairs(df: DataFrame, ratio: float, key: str = "id", area: str = "area", group: list[str] = ()) -> DataFrame:
    """(a, b) for all a < b whose areas are within a factor: neighbours in logarithmic buckets."""
    bucket = F.floor(F.log(float(ratio), F.col(area).cast("double"))).cast("long")
    base = df.select(*group, F.col(key).alias("k"), F.col(area).cast("double").alias("s"), bucket.alias("bucket")).where("s > 0")
    sent = base.select(*group, F.col("k").alias("k2"), F.col("s").alias("s2"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    near = (F.col("k") < F.col("k2")) & (F.greatest("s", "s2") <= ratio * F.least("s", "s2"))
    return base.join(sent, [*group, "bucket"]).where(near).select(*group, F.col("k").alias("a"), F.col("k2").alias("b"))


def near_any(probes: DataFrame, rows: DataFrame, ratio: float, key: str = "id", area: str = "area") -> DataFrame:
    """(key) of the rows whose area is within a factor of that of any probe but themselves.

    A row meets the distinct areas of probes in its logarithmic bucket and the two
    beside it, each area once with the lowest and highest of its keys.
    """
    bucket = lambda c: F.floor(F.log(float(ratio), c)).cast("long")
    areas = probes.where(F.col(area) > 0).groupBy(F.col(area).cast("double").alias("pa")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    sent = areas.select("pa", "lo", "hi", F.explode(F.array(*(bucket(F.col("pa")) + d for d in (-1, 0, 1)))).alias("bucket"))
    asked = rows.where(F.col(area) > 0).select(F.col(key).alias("k"), F.col(area).cast("double").alias("a")).withColumn("bucket", bucket(F.col("a")))
    near = (F.greatest("a", "pa") <= ratio * F.least("a", "pa")) & ((F.col("lo") != F.col("k")) | (F.col("hi") != F.col("k")))
    return asked.join(sent, "bucket").where(near).select(F.col("k").alias(key)).distinct()
