"""Merging observations with their proofs into a state, field by field.

A state and a batch are long tables with a row for each entity and field: entity, field, value, proofs, where a proof is
struct(source, observed_at, method, evidence). An absent field is no retraction, a proof stays with the value it proves, and older
observations never supersede newer ones. Entities and fields meet in one full outer join on written or scanned sides, so
work is in proportion to the rows, and a hot entity has as many rows as it has fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import is_known

#: How generic links are marked by their method, and fields that a personal site's excerpt keeps.
GENERIC, PERSONAL, PROTECTED = "_generic_lab_link", "personal_site", ("researchSummary", "googleScholarUrl")
KEYS = ["entity", "field"]


def newest(proofs: Column) -> Column:
    """The time of the newest dated proof; null without one."""
    return F.array_max(F.transform(proofs, lambda p: p["observed_at"]))


def union(a: Column, b: Column) -> Column:
    """The proofs of both, each once, sorted."""
    both = F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_union(a, b))
    return F.array_sort(F.array_distinct(both))


def generic(proofs: Column) -> Column:
    return F.coalesce((F.size(proofs) > 0) & F.forall(proofs, lambda p: F.endswith(p["method"], F.lit(GENERIC))), F.lit(False))


def personal(proofs: Column) -> Column:
    return F.coalesce(F.exists(proofs, lambda p: F.contains(p["method"], F.lit(PERSONAL))), F.lit(False))


def merge_observed(state: DataFrame, batch: DataFrame, same_resource: Column | None = None, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """Returns entity, field, value, proofs, action and, where something was set aside, other (value, proofs).

    action: kept (nothing new), proved (the same value or a proof alone), set (a first value), replaced (other is what was replaced),
    additional (other is an observation kept beside: a generic name of the same resource, or an excerpt that a personal site outranks) and
    outdated (the batch is older). same_resource says that both sides speak of one resource; columns of the sides are o and n.
    """
    old = state.select(*KEYS, F.struct("value", "proofs").alias("o"))
    new = batch.select(*KEYS, F.struct("value", "proofs").alias("n"))
    both = old.join(new, KEYS, "full_outer")
    had, has = F.coalesce(is_known(F.col("o.value")), F.lit(False)), F.coalesce(is_known(F.col("n.value")), F.lit(False))
    same = F.coalesce(same_resource, F.lit(False)) if same_resource is not None else F.lit(False)
    differs = had & has & (F.col("o.value") != F.col("n.value"))
    better = same & generic(F.col("o.proofs")) & ~generic(F.col("n.proofs"))
    worse = same & generic(F.col("n.proofs")) & ~generic(F.col("o.proofs"))
    older = F.coalesce(newest(F.col("n.proofs")) < newest(F.col("o.proofs")), newest(F.col("n.proofs")).isNull() & newest(F.col("o.proofs")).isNotNull())
    outranked = F.col("field").isin(*protected) & personal(F.col("o.proofs")) & ~personal(F.col("n.proofs"))
    action = (
        F.when(F.col("n").isNull() | (~has & F.col("n.value").isNotNull()), "kept").when(F.col("n.value").isNull(), "proved").when(differs & worse, "additional")
        .when(differs & older & ~better, "outdated").when(differs & outranked, "additional").when(differs, "replaced").when(had, "proved").otherwise("set")
    )
    marked = both.withColumn("action", action)
    takes, joins = F.col("action").isin("set", "replaced"), F.col("action").isin("proved", "set")
    return marked.select(
        *KEYS, F.when(takes, F.col("n.value")).otherwise(F.col("o.value")).alias("value"),
        F.when(F.col("action") == "replaced", F.col("n.proofs")).when(joins, union(F.col("o.proofs"), F.col("n.proofs"))).otherwise(F.col("o.proofs")).alias("proofs"), "action",
        F.when(F.col("action") == "replaced", F.col("o")).when(F.col("action") == "additional", F.col("n")).alias("other"),
    )


def state_of(merged: DataFrame) -> DataFrame:
    return merged.select(*KEYS, "value", "proofs")


def set_aside(merged: DataFrame) -> DataFrame:
    """(entity, field, kind, value, proofs): what was replaced, and what was kept beside."""
    return merged.where("other is not null").select(*KEYS, F.col("action").alias("kind"), "other.*")


def merge_verified(state: DataFrame, batch: DataFrame, checks: DataFrame, old_checks: DataFrame) -> DataFrame:
    """As merge_observed, for entities whose check is not older than the last and succeeded; a failed fetch keeps all fields.

    checks and old_checks: entity, status, observed_at. Evidence survives a failure, which the entity's latest check reports.
    """
    before = old_checks.select("entity", F.col("observed_at").alias("checked"))
    able = checks.join(before, "entity", "left").where((F.col("status") == "verified") & F.col("observed_at").isNotNull() & (F.col("checked").isNull() | (F.col("observed_at") >= F.col("checked"))))
    return merge_observed(state, batch.join(able.select("entity"), "entity", "left_semi"))


def latest_checks(checks: DataFrame, old_checks: DataFrame) -> DataFrame:
    """entity, status, observed_at of the latest check, and history: the one it replaced."""
    old = old_checks.select("entity", F.struct("status", "observed_at").alias("o"))
    new = checks.select("entity", F.struct("status", "observed_at").alias("n"))
    both = old.join(new, "entity", "full_outer")
    takes = F.col("n.observed_at").isNotNull() & (F.col("o").isNull() | F.col("o.observed_at").isNull() | (F.col("n.observed_at") >= F.col("o.observed_at")))
    now = F.when(takes, F.col("n")).otherwise(F.col("o"))
    return both.select("entity", now.alias("c"), F.when(takes & (F.col("o") != F.col("n")), F.col("o")).alias("history")).select("entity", "c.*", "history")


def proofs_lost(baseline: DataFrame, current: DataFrame, owners: DataFrame) -> DataFrame:
    """(entity, field, proof) of a baseline that nobody who owns the entity's id has any more. owners: identity, entity (ids and aliases)."""
    each = lambda df: df.select(*KEYS, F.explode("proofs").alias("p")).select(*KEYS, F.to_json("p").alias("proof")).distinct()
    kept = owners.join(each(current), "entity").select(F.col("identity").alias("entity"), "field", "proof").distinct()
    return each(baseline).join(kept, [*KEYS, "proof"], "left_anti")


def ambiguous_owners(owners: DataFrame) -> DataFrame:
    """Identities that several entities claim."""
    return owners.distinct().groupBy("identity").agg(F.count("*").alias("owners"), F.min("entity").alias("first_owner")).where("owners > 1")


def relationships_lost(baseline: DataFrame, current: DataFrame, owners: DataFrame) -> DataFrame:
    """(entity, kind, target) links of a baseline that no owner of the entity has, where targets count as the one entity that owns them."""
    one = owners.distinct().groupBy("identity").agg(F.count("*").alias("n"), F.min("entity").alias("owner")).where("n = 1").select("identity", "owner")
    canonical = lambda df: df.join(one, df["target"] == one["identity"], "left").withColumn("to", F.coalesce("owner", "target")).drop("identity", "owner")
    held = owners.join(canonical(current).select("entity", "kind", "to"), "entity").select(F.col("identity").alias("entity"), "kind", "to").distinct()
    return canonical(baseline).join(held, ["entity", "kind", "to"], "left_anti").select("entity", "kind", "target").distinct()
