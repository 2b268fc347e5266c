"""Connected components as DataFrame rounds: large-star and small-star steps until no edge changes.

Every round is written to the shared folder, so a lost executor costs one round. Hubs don't meet in one task's
memory: each step is a combined minimum and an equi-join, whose skewed partitions adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b. One large-star or small-star step; the result is distinct, a > b."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> node, root: each node that has an edge to another, and its component's least node."""
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    while True:
        # a star forest: every a has one b, and no b is an a
        stats = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if stats[0] == 0 or tuple(stats) == sign:
            break
        sign = tuple(stats)
        before, now = now, materialise(_star(_star(now, True), False), "edges")
        discard(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
