"""Connected components by joins; no edge or component comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .base import stored


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that is not the smallest of its component.

    Each round points every node at its smallest neighbour (counted before the shuffle, so a hub costs
    one row per task), follows the pointers twice, and contracts the edges to what they point at.
    Rounds are written to the shared folder; their number grows with the logarithm of the longest
    path. Null ends and loops are no edges.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("high"), F.least(x, y).alias("low"))
    left = stored(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
                  .select(*pair(F.col(a), F.col(b))).distinct(), "edges")
    known = None
    while not left.isEmpty():
        both = left.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
            left.select(F.col("low").alias("node"), F.col("high").alias("root")))
        step = stored(both.groupBy("node").agg(F.min("root").alias("root")).filter("root < node"), "pointers")
        for _ in range(2):
            next_ = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            step = step.join(next_, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
        step = stored(step, "pointers")
        if known is None:
            known = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            known = stored(known.join(moved, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
                           .unionByName(step), "roots")
        to = lambda end: step.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        left = left.join(to("high"), "high", "left").join(to("low"), "low", "left")
        left = left.select(*pair(F.coalesce("high_root", "high"), F.coalesce("low_root", "low")))
        left = stored(left.filter("high != low").distinct(), "edges")
    if known is None:
        return left.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return known
