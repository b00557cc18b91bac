"""Connected components of an edge table by alternating large and small stars.

Each round is a written table; per-node minima are combined before the shuffle and written before
they are joined back, so the join of a node with very many edges is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.plans.scratch import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge (u, v) of longs; root is the smallest node of its component."""
    now = materialize(_ordered(edges), "edges")
    mark = _mark(now)
    while mark[0]:
        after = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        new = _mark(after)
        now = after
        if new == mark:
            break
        mark = new
    tops = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops)


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sum of the edges, to see when nothing changes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges with the least neighbour of their node u."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met = _with_least(both).where("v > u")
    return _ordered(met.select(F.col("v").alias("u"), F.least("m", "u").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = materialize(edges, "stars")
    met = _with_least(edges)
    return _ordered(
        met.select("v", "m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            met.select("u", F.col("m").alias("v"))
        )
    )
