"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.columns import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v, least: the edges (u, v) with the smallest of u and all its partners; hot u are summed before they meet."""
    least = edges.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("least"))
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest member) for every node of ``edges`` (columns a, b; loops and repeats are fine).

    Each round hangs every node's larger partners, then its smaller ones, on its smallest; the rounds end when no edge
    changes. Lineage is cut in the shared folder after each round.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        oriented = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        linked = _with_least(oriented)
        small = linked.select(F.col("v").alias("u"), F.col("least").alias("v")).union(linked.select("u", F.col("least").alias("v")))
        now = stored(small.where("u <> v").distinct())
        state = now.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if mark == tuple(state):
            break
        mark = tuple(state)
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
