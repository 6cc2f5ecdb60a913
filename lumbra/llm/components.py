"""Connected components by alternating large-star and small-star rounds.

Each round reads the edges written by the one before and writes its own to the shared folder, so plans stay short and
a lost executor costs a round at most. Joins are on a node's least neighbour, which is pre-aggregated; the rows of a
giant star's node meet it in all tasks (:func:`common.join_unique`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, join_unique, written

#: Rounds grow with the logarithm of a component's diameter; beyond these an error is raised.
ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges of two long columns to (node, component): the smallest node reachable, for every node with an edge to another. Nulls and loops are no edges."""
    e = edges.filter(f"{a} is not null and {b} is not null and {a} <> {b}").select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e = written(e, "edges")
    before = _state(e)
    for _ in range(ROUNDS):
        if not before[0]:
            break
        # a neighbour takes the least of a node's neighbours and itself: that is below it only if it is the upper end of an edge
        below = e.groupBy("hi").agg(F.min("lo").alias("m")).withColumnRenamed("hi", "lo")
        large = written(join_unique(e, below, ["lo"], "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct(), "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = join_unique(large, low, ["hi"]).filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = written(moved.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = _state(after)
        for x in (e, large):
            drop_written(x)
        e = after
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components still change after {ROUNDS} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
