"""Evidence-aware merging: the newest supported value wins, what it replaces stays in history, patches apply once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(observations: DataFrame, keys: list[str], at: str, tie: list[str]) -> DataFrame:
    """One row for each key, the newest; of ties the last by ``tie``. Blank values are no observations and are left out before.

    An aggregation with partial results: a key with very many observations costs a task no more memory.
    """
    rest = [c for c in observations.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull(), at, *tie)).alias("_s")
    return observations.groupBy(*keys).agg(newest).select(*keys, "_s.*")


def history(observations: DataFrame, keys: list[str], value: str, at: str, tie: list[str]) -> DataFrame:
    """Values that a later, different one replaced, with when it did."""
    later = Window.partitionBy(*keys).orderBy(at, *tie)
    nxt = observations.withColumns({"next_value": F.lead(value).over(later), "replaced_at": F.lead(at).over(later)})
    return nxt.where(F.col("next_value").isNotNull() & (F.col("next_value") != F.col(value)))


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of the columns; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def apply_once(patches: DataFrame, key: str, mark: str = "fingerprint") -> DataFrame:
    """Patches without those that were applied before: the first of each fingerprint."""
    rest = [c for c in patches.columns if c != mark]
    return patches.groupBy(mark).agg(F.min_by(F.struct(*rest), key).alias("_s"), F.count("*").alias("times")).select(mark, "times", "_s.*")


def golden(records: DataFrame, key: str, fields: dict[str, Column], rank: list[Column]) -> DataFrame:
    """One record for each key: each field's first known value in order of rank."""
    found = [F.min_by(f, F.when(f.isNotNull(), F.struct(*rank))).alias(n) for n, f in fields.items()]
    return records.groupBy(key).agg(*found)


def best_rating(ratings: DataFrame, key: str, platform: str, score: str, count: str) -> DataFrame:
    """For each key the platform with most reviews among those with a score and a review."""
    known = ratings.where(F.col(score).isNotNull() & (F.col(count) > 0))
    best = F.max_by(F.struct(platform, score, count), F.struct(F.col(count), F.col(platform))).alias("_s")
    return known.groupBy(key).agg(best).select(key, "_s.*")


def status_of(checked: Column, fetched: Column) -> Column:
    """Verification status: a proof outranks a failed fetch, which outranks nothing at all."""
    return F.when(checked, "source_checked").when(fetched == "ok", "needs_review").when(fetched.isNotNull(), "unavailable").otherwise("legacy_unverified")
