"""Breadth-first reach over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.shared import drop_shared, shared_table


def reach(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth): nodes within ``depth`` steps of the seeds (node), with their least distance. edges: u, v.

    Each round joins the frontier with the edges and leaves out what was met before; rounds are written as shared tables, so a lost
    executor costs its part of one round. Nothing reaches the driver but whether a frontier is empty.
    """
    found = shared_table(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = found
    for k in range(1, depth + 1):
        following = frontier.select(F.col("node").alias("u")).join(edges.select("u", "v"), "u").select(F.col("v").alias("node")).where("node is not null").distinct()
        fresh = shared_table(following.join(found.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        if fresh.isEmpty():
            break
        whole = shared_table(found.unionByName(fresh))
        drop_shared(found, *([frontier] if frontier is not found else []))
        found, frontier = whole, fresh
    return found
