"""Joins in time: the newest row before each other row, and points in ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, at: str, take: list[str]) -> DataFrame:
    """left with the columns ``take`` of the newest row of right of the same key that is not later; null without one. Of rows of right at one
    time the greatest is taken.

    One sort of both sides together, no pairs: right's rows are carried forward along a window. A hot key is one sorted, spillable run.
    """
    l = left.select(key, at, F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"), F.lit(1).alias("_side"))
    r = right.select(key, at, F.lit(None).alias("_l"), F.struct(*take).alias("_r"), F.lit(0).alias("_side"))
    both = l.withColumn("_r", F.col("_r").cast(r.schema["_r"].dataType)).unionByName(r.withColumn("_l", F.col("_l").cast(l.schema["_l"].dataType)))
    order = Window.partitionBy(key).orderBy(at, "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_r", F.last("_r", ignorenulls=True).over(order)).where("_side = 1")
    return carried.select("_l.*", *[F.col(f"_r.{c}").alias(f"right_{c}") for c in take])


def in_ranges(points: DataFrame, at: Column, ranges: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """Pairs of points and the ranges [start, end] that hold them. Ranges are dealt to the buckets of ``width`` that they touch, so points meet
    those of their own bucket alone; a width near the ranges' usual length keeps both small."""
    bucket = lambda c: F.floor(c / F.lit(width))
    p = points.withColumns({"_at": at, "_b": bucket(at)})
    r = ranges.withColumns({"_s": start, "_e": end}).where("_s <= _e").withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(r, "_b").where("_at between _s and _e").drop("_b", "_at", "_s", "_e")
