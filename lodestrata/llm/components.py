"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm._shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours that are larger (large) or no larger (small) to its smallest neighbour or itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    kept = near.where("b > a") if large else near.where("b < a")
    out = kept.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, b) links between longs to (node, component): the smallest node that is linked, directly or not.

    Nodes without links do not appear. Loops and repeated links change nothing; a null on either
    side is no link. Each round is written to the shared folder; nothing is gathered on the driver.
    """
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        edges = stored(_star(_star(edges, True), False), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
            ).distinct()
        before = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
