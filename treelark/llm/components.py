"""Connected components of a written edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), u > v. Large: hangs every larger neighbour of a node on the node's smallest neighbour; small: the
    smaller ones and the node itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component: the smallest node reachable) for the nodes of edges(u, v), in either order, with repeats or loops."""
    now = c.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        after = c.written(_star(_star(now, True), False), "edges")
        found = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        c.dropped(now)
        now = after
        if found == state or not found[0]:
            break
        state = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
