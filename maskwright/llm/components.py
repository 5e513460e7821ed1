"""Connected components by alternating large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import write_once


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:  # all neighbours; those above the node go to the smallest of all
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # neighbours below the node
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = sides.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = sides.join(lowest, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lowest.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of type long. Returns (node, component), the component being its smallest node, for every node of an edge that
    joins two nodes. Rounds go on until nothing changes, about the square of the logarithm of the nodes at most. Each is a table
    in the shared folder."""
    current = write_once(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        current = write_once(_star(_star(current, True), False), "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
