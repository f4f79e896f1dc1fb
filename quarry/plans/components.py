"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014).

No round collects a neighbourhood: each computes the least neighbour of a node with a partial aggregation
and joins it back, so a node with very many neighbours costs no more memory than another. Rounds are written
as shared tables; only whether a round has settled them reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.shared import drop_shared, shared_table


def _least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v) in both directions, and m: the least of u and its neighbours.

    The aggregate is written before it is joined: a join of two written sides is one whose hot keys Spark splits.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = shared_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return both.join(least, "u"), least


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges (u, v): any orderable type, both not null. Returns (node, root): the least node reachable from each node of an edge to another.

    No edges give no rows. Raises if the rounds do not settle; they need about log2 of the longest path.
    """
    kind = edges.schema["u"].dataType
    now = shared_table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").cast(kind).alias("v")).distinct())
    for _ in range(max_rounds):
        if _settled(now):
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        linked, least = _least(now)
        mid = shared_table(linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: neighbours not above u, and u itself, go to the least of them
        below = mid.groupBy("u").agg(F.min("v").alias("m"))
        small = mid.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(below.select("u", F.col("m").alias("v")))
        after = shared_table(small.where("u <> v").distinct())
        drop_shared(mid, now, least)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (u above v) are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    return ends.groupBy("node").agg(F.sum("as_u").alias("a"), F.sum("as_v").alias("b")).where("a > 1 or (a > 0 and b > 0)").isEmpty()
