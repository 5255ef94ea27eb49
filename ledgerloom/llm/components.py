"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpointed


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the smallest of u and its neighbours."""
    near = _both(edges)
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """Columns ``id`` and ``component``: each node with an edge, and the smallest node it reaches.

    ``edges`` has long columns u and v; loops, repeats and either direction are allowed, rows
    with a null are not links. Nodes without a link to another node are left out. Steps alternate
    until the edges are a forest of stars, which is when nothing changes; nodes with very many
    neighbours only meet in a minimum and in joins that adaptive execution may split.
    """
    now = edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct()
    now = checkpointed(now)
    mark = None
    while mark != (new := _mark(now)) and new[0]:
        mark = new
        now = checkpointed(small_star(checkpointed(large_star(now))))
    nodes = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
