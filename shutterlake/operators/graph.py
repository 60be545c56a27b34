"""Connected components as an iterated DataFrame plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from shutterlake import scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round takes the smallest label of the neighbours and then follows
    labels one step (label := label of label), so long chains halve. Both joins
    run between written tables, which lets AQE split the partition of a hub.
    Edges with a null end or a loop are ignored.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    both = scratch.written(e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", gathered=True)
    labels = scratch.written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels", gathered=True)
    signature = None
    for _ in range(max_rounds):
        # Whether labels still change is told by a sum that the write takes along.
        told = Observation()
        jumped = scratch.written(_follow(labels).observe(told, F.sum(F.xxhash64("node", "label").cast("decimal(20,0)")).alias("sum")), "labels", gathered=True)
        scratch.drop(labels)
        now = told.get["sum"]
        if now == signature:
            labels = jumped
            break
        signature = now
        seen = both.join(jumped, both.b == jumped.node).select(both.a.alias("node"), "label")
        lowest = seen.unionAll(jumped.select("node", "label")).groupBy("node").agg(F.min("label").alias("label"))
        labels = scratch.written(lowest, "labels", gathered=True)
        scratch.drop(jumped)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    scratch.drop(both)
    return labels.select("node", F.col("label").alias("component"))


def _follow(labels: DataFrame) -> DataFrame:
    to = labels.select(F.col("node").alias("via"), F.col("label").alias("next"))
    return labels.join(to, labels.label == to.via, "left").select("node", F.coalesce("next", "label").alias("label"))
