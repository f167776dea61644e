"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; a node's edges are never gathered into one row. Nothing but a change count
reaches the driver, and each round is stored in the shared folder, so that the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    near = both if large else both.where("a > b")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    met = near.join(least, "a")
    if large:
        moved = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (smallest id reachable) of every node of ``edges`` (columns ``a``, ``b``; NULLs and loops ignored)."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stored(now, "stars"), None
    for _ in range(rounds):
        last, now = now, stored(_stars(_stars(now, True), False), "stars")
        discard(last)
        size = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before:
            break
        before = size
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct(),
    )
