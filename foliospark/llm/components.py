"""Connected components of a graph too large for one machine: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import drop_saved, saved


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge (u, v), the smallest node that it reaches.

    Repeated edges, loops and either direction are welcome; nulls must be absent. Each step hangs nodes on smaller
    ones; the number of steps grows with the logarithm of the longest path. Every step is written to the shared folder,
    so a lost executor costs one step at most. Nothing of the graph reaches the driver but a count and a checksum.
    """
    now = saved(_larger_first(edges.select("u", "v")), "edges")
    mark = _mark(now)
    while True:
        grown = saved(_star(now, large=True), "edges")
        after = saved(_star(grown, large=False), "edges")
        seen, mark = mark, _mark(after)
        drop_saved(grown)
        drop_saved(now)
        now = after
        if mark == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _larger_first(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: every larger neighbour of u is hung on u's smallest; else every smaller one, and u itself."""
    at = edges.select(F.col("u").alias("n"), F.col("v").alias("w"))
    if large:
        at = at.unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("w")))
    least = saved(at.groupBy("n").agg(F.min("w").alias("m")).withColumn("m", F.least("m", "n")), "least")
    hung = at.join(least, "n")
    if large:
        hung = hung.filter("w > n").select(F.col("w").alias("u"), F.col("m").alias("v"))
        return _larger_first(hung)
    own = least.select(F.col("n").alias("u"), F.col("m").alias("v"))
    return _larger_first(hung.select(F.col("w").alias("u"), F.col("m").alias("v")).unionByName(own))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
