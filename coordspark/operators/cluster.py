"""Clusters of clashes, and merging of contact points that are close."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coordspark.functions.geometry import AXES
from coordspark.operators.components import components


def near_pairs(points: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """a, b: ties (ids) that link the points (id, keys, x, y, z) with equal keys as all pairs within ``radius`` do, each once.

    Points are dealt to grid cells of the radius and their neighbours ahead, so the join is an equi-join on key and cell.
    Points in one cell are tied to the cell's smallest id if they are within reach of it, and compared one by one only
    with what is left, so that a crowded cell does not expand into all its pairs: a cell's side is radius / sqrt(3), all
    its points are within the radius of each other.
    """
    size = radius / 3**0.5
    cells = points.select("id", *keys, *AXES, *(F.floor(F.col(k) / size).alias(f"c{k}") for k in AXES))
    crowd = cells.groupBy(*keys, "cx", "cy", "cz").agg(F.min("id").alias("hub"))
    cells = cells.join(crowd, [*keys, "cx", "cy", "cz"])
    # all points of a cell are within the radius of each other: one tie each
    inner = cells.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
    # between two cells one close pair is enough to tie them, by their hubs: two numbers, which each task adds up without sorting
    steps = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    # equal points are compared once
    places = cells.select("hub", *keys, *AXES, "cx", "cy", "cz").distinct()
    ahead = places.select("*", F.explode(F.array(*steps)).alias("s")).select(F.col("hub").alias("a"), *keys, *AXES, *((F.col(f"c{a}") + F.col(f"s.{s}")).alias(f"c{a}") for a, s in zip(AXES, "ijk", strict=True)))
    other = places.select(F.col("hub").alias("b"), *keys, "cx", "cy", "cz", *(F.col(k).alias(f"b{k}") for k in AXES))
    d2 = sum(((F.col(k) - F.col(f"b{k}")) ** 2 for k in AXES[1:]), (F.col("x") - F.col("bx")) ** 2)
    # a plan's sizes are those before a place becomes a row for each neighbour: by them, the larger side would be broadcast
    tied = ahead.hint("merge").join(other, [*keys, "cx", "cy", "cz"]).where(d2 <= radius * radius).select("a", "b").distinct()
    return inner.unionByName(tied)


def clusters(points: DataFrame, radius: float = 500, keys: list[str] = ("type_pair", "storey")) -> DataFrame:
    """id, cluster: points with equal keys that are linked by steps within ``radius``; a lone point is its own cluster."""
    linked = components(near_pairs(points, radius, list(keys)))
    return points.join(linked, points.id == linked.node, "left").select("id", F.coalesce("component", "id").alias("cluster"))


def merge_segments(points: DataFrame, radius: float = 50) -> DataFrame:
    """Contact points (id, pair, x, y, z) of a pair within ``radius`` become one: pair, cluster, n and their mean."""
    of = clusters(points, radius, ["pair"])
    return points.join(of, "id").groupBy("pair", "cluster").agg(F.count("*").alias("n"), *(F.avg(k).alias(k) for k in AXES))
