"""Windowed aggregations that run on batches and on streams alike, and a runner that drains a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.shared import shared_dir


def _watermarked(events: DataFrame, at: str, late: str) -> DataFrame:
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def windowed(events: DataFrame, at: str, key: str, value: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count and sum by key and window; a stream drops what comes later than ``late``."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    rows = _watermarked(events, at, late)
    out = rows.groupBy(window.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    rows = _watermarked(events, at, late)
    out = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now, and return the last state (complete) or all rows (append).

    Each batch has a folder of its number, which a batch that runs again writes anew, so nothing is lost or counted twice.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = stream.schema

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/_batch={number}")

    spark.createDataFrame([], schema).write.parquet(f"{root}/out/_batch=-1")
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    read = lambda number: spark.read.schema(schema).parquet(f"{root}/out/_batch={number}")
    last = query.lastProgress
    numbers = range(last.batchId + 1) if last else range(0)
    if mode == "complete":
        return read(numbers[-1] if numbers else -1)
    whole = read(-1)
    for k in numbers:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/out/_batch={k}")
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            whole = whole.unionByName(read(k))
    return whole
