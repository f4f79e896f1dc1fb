"""The crawl queue: upserts, scheduling with backoff, host spacing. Batch forms, and a stateful gate for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.dates import queue_backoff

MAX_ATTEMPTS, RETRY_STATES = 3, ("error", "timeout")


def upsert(requests: DataFrame, key: str, depth: str, context: str) -> DataFrame:
    """One item for each key: least depth, distinct contexts in order, number of requests."""
    return requests.groupBy(key).agg(F.min(depth).alias("depth"), F.array_sort(F.collect_set(context)).alias("contexts"), F.count("*").alias("requests"))


def schedule(attempts: DataFrame, key: str, at: str, failed: Column) -> DataFrame:
    """State of each key after its attempts: done after a success, pending with a time after up to two failures, unresolved after three."""
    tries = attempts.groupBy(key).agg(
        F.count_if(failed).alias("failures"), F.max(F.when(failed, F.col(at))).alias("last_failure"), F.count_if(~failed).alias("successes")
    )
    state = F.when(F.col("successes") > 0, "done").when(F.col("failures") >= MAX_ATTEMPTS, "unresolved").otherwise("pending")
    retry = F.timestamp_add("SECOND", queue_backoff(F.col("failures")).cast("int"), F.col("last_failure"))
    return tries.withColumn("state", state).withColumn("retry_at", F.when(F.col("state") == "pending", retry))


def next_per_host(items: DataFrame, host: str, order: list[Column | str]) -> DataFrame:
    """At most one item of each host, the first in order."""
    first = F.min_by(F.struct(*[c for c in items.columns if c != host]), F.struct(*order)).alias("_s")
    return items.groupBy(host).agg(first).select(host, "_s.*")


def too_soon(requests: DataFrame, host: str, at: str, seconds: int, tie: str) -> DataFrame:
    """Requests that came earlier after the host's last one than its interval allows."""
    last = F.lag(at).over(Window.partitionBy(host).orderBy(at, tie))
    waited = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    return requests.withColumn("waited_us", waited).where(F.col("waited_us") < seconds * 1_000_000)


def retained(items: DataFrame, checked_at: str, now: Column, days: int = 30) -> DataFrame:
    """Items with a check from the last days need no new one."""
    age = F.unix_seconds(now) - F.unix_seconds(F.col(checked_at).cast("timestamp"))
    return items.withColumn("state", F.when(age.between(0, days * 86400), "retained_prior_evidence").otherwise("pending"))


def budgeted(items: DataFrame, seen_at: str, key: str, budget: int) -> DataFrame:
    """The budget goes to items never seen, then to those seen longest ago. A top-k: each task keeps budget rows at most."""
    return items.orderBy(F.col(seen_at).isNotNull(), seen_at, key).limit(budget)


def host_gate(requests: DataFrame, interval_seconds: float = 1.0) -> DataFrame:
    """Streaming requests (host, at timestamp): each with the time when its host lets it go.

    State of a host is the end of its last slot; it never moves back, so late requests do not undo it.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        free = state.get[0] if state.exists else 0.0
        for batch in batches:
            out = batch.sort_values("at")
            slots = []
            for at in out["at"].astype("int64") / 1e9 if str(out["at"].dtype).endswith("ns]") else out["at"].map(lambda t: t.timestamp()):
                slot = max(at, free)
                free = slot + interval_seconds
                slots.append(slot)
            yield pd.DataFrame({"host": key[0], "at": out["at"], "slot": pd.to_datetime(slots, unit="s")})
        state.update((free,))

    grouped = requests.select("host", "at").groupBy("host")
    return grouped.applyInPandasWithState(run, "host string, at timestamp, slot timestamp", "free double", "append", "NoTimeout")
