"""Table access and shared tables.

A shared table is a parquet table in the folder that the cluster names in ``spark.checkpoint.dir``.
Every executor can read it again after any other executor is lost, so it cuts lineage as checkpoint() does,
but is columnar and is computed once.
"""

from __future__ import annotations

import contextlib
import gc
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one below the warehouse where that is unset and all runs on one machine (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{named.rstrip('/')}/quarry-{spark.sparkContext.applicationId}"


_recording: list[list[DataFrame]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """Collects the shared tables that are written meanwhile, so that a caller can drop them when nothing reads them any more."""
    _recording.append([])
    try:
        yield _recording[-1]
    finally:
        made = _recording.pop()
        if _recording:
            _recording[-1] += made


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs that have ended: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_table(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to a new table in the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._shared_path = path
    if _recording:
        _recording[-1].append(made)
    return made


_stored: dict[tuple[str, str], DataFrame] = {}


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table that is built once for an application and name and read afterwards, as an index is. Its source must not change meanwhile."""
    key = spark.sparkContext.applicationId, name
    if key not in _stored:
        _stored[key] = shared_table(build())
    return _stored[key]


def drop_shared(*tables: DataFrame) -> None:
    """Delete shared tables that nothing reads any more. Other DataFrames are left alone."""
    for df in tables:
        named = getattr(df, "_shared_path", None)
        if named:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
