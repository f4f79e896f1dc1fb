"""Validation: rules as columns, references, preservation of a baseline, profiles and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks; a rule is a column that is true where it holds. Null counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(F.col(key).cast("string").alias("key"), F.explode(broken).alias("rule"))


def missing_references(facts: DataFrame, column: str, entities: DataFrame, key: str) -> DataFrame:
    """Values of a foreign key without entity, and how many facts have them."""
    used = facts.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("facts"))
    return used.join(entities.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def preservation(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, field, change): removed records, and fields that lost or changed a known value. Added records are no loss.

    A hash of the row keeps unchanged records out of the field-by-field comparison.
    """
    fields = [c for c in baseline.columns if c != key]
    pack = lambda df, n: df.select(F.col(key).alias("key"), F.struct(*fields).alias(n))
    both = pack(baseline, "old").join(pack(current, "new"), "key", "left")
    gone = both.where("new is null").select("key", F.lit("").alias("field"), F.lit("removed").alias("change"))
    kept = both.where("new is not null and xxhash64(old) <> xxhash64(new)")
    each = [
        F.when(F.col(f"old.{f}").isNotNull() & ~F.col(f"old.{f}").eqNullSafe(F.col(f"new.{f}")), F.struct(F.lit(f).alias("field"), F.when(F.col(f"new.{f}").isNull(), "lost").otherwise("changed").alias("change")))
        for f in fields
    ]
    lost = kept.select("key", F.explode(F.array_compact(F.array(*each))).alias("e")).select("key", "e.field", "e.change")
    return gone.unionByName(lost)


def profile(rows: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, value) in one pass."""
    wide = rows.agg(*[m.cast("long").alias(n) for n, m in metrics.items()])
    return wide.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*metrics))).alias("metric", "value"))


def coverage(registry: DataFrame, records: DataFrame, on: str) -> DataFrame:
    """Every registered key with its number of records, zero included. Records are counted before the join."""
    counted = records.groupBy(on).agg(F.count("*").alias("records"))
    return registry.join(counted, on, "left").withColumn("records", F.coalesce("records", F.lit(0)))


def quotes_found(quotes: DataFrame, captures: DataFrame) -> DataFrame:
    """quotes (quote_id, capture_id, quote) and captures (capture_id, body, sha256): why a quote's proof fails, or ok.

    The body's hash must be the stored one, and the quote must stand in the body, white space aside.
    """
    one = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    joined = quotes.join(captures, "capture_id", "left")
    status = (
        F.when(F.col("body").isNull(), "no_capture").when(F.sha2("body", 256) != F.col("sha256"), "hash_mismatch")
        .when(F.contains(one(F.col("body")), one(F.col("quote"))), "ok").otherwise("quote_not_found")
    )
    return joined.select("quote_id", "capture_id", status.alias("status"))


def duplicate_groups(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """Keys that several rows share, with the number of members and the least."""
    grouped = rows.where(key.isNotNull() & (key != "")).groupBy(key.alias("group_key"))
    return grouped.agg(F.count("*").alias("members"), F.min(member).alias("first_member")).where("members > 1")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
