"""Entity resolution that never guesses: cascades whose steps must be unique, alias closure, blocked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import name_tokens
from quarry.plans.components import connected_components


def match_names(records: DataFrame, roster: DataFrame) -> DataFrame:
    """records (record_id, name, scope) against roster (person_id, name, scope): record_id, person_ids, method.

    Within a scope: the same tokens; else a surname sequence that ends one full name only; else first and last name, or its
    initial, with all other given tokens in the middle, that fit one full name only. Several full names make a record
    ambiguous and none unresolved. The join is on scope and last token, so no pair is formed across surnames.
    """
    own = records.select("record_id", "scope", name_tokens(F.col("name")).alias("t")).withColumn("last", F.element_at(F.when(F.size("t") > 0, F.col("t")), -1))
    people = roster.select("person_id", F.col("scope").alias("scope_"), name_tokens(F.col("name")).alias("p")).withColumn("last_", F.element_at(F.when(F.size("p") > 0, F.col("p")), -1))
    pairs = own.join(people, (F.col("scope") == F.col("scope_")) & (F.col("last") == F.col("last_")))
    t, p = F.col("t"), F.col("p")
    ends = (F.size(p) >= F.size(t)) & (F.slice(p, F.greatest(F.size(p) - F.size(t) + 1, F.lit(1)), F.greatest(F.size(t), F.lit(1))) == t)
    middle = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0)))
    initial = lambda a: F.get(F.filter(middle(a), lambda x: F.length(x) == 1), F.lit(0))
    differ = F.coalesce(initial(t) != initial(p), F.lit(False))
    first = (t[0] == p[0]) | ((F.length(t[0]) == 1) & F.startswith(p[0], t[0]))
    within = F.forall(F.filter(middle(t), lambda x: F.length(x) > 1), lambda x: F.array_contains(middle(p), x))
    qualified = (F.size(t) >= 2) & (F.size(p) >= 2) & ~differ & first & within
    marked = pairs.select("record_id", "person_id", "p", (t == p).alias("exact"), ends.alias("suffix"), qualified.alias("qualified"))
    ids = lambda c: F.array_sort(F.collect_set(F.when(F.col(c), F.col("person_id"))))
    names = lambda c: F.size(F.collect_set(F.when(F.col(c), F.col("p"))))
    found = marked.groupBy("record_id").agg(
        *[ids(c).alias(c) for c in ("exact", "suffix", "qualified")], *[names(c).alias(f"n_{c}") for c in ("suffix", "qualified")]
    )
    out = records.select("record_id").join(found, "record_id", "left")
    method = (
        F.when(F.size("exact") > 0, "exact_name_same_scope").when(F.col("n_suffix") == 1, "unique_surname_same_scope")
        .when(F.col("n_qualified") == 1, "unique_first_last_same_scope").when((F.size("suffix") > 0) | (F.size("qualified") > 0), "ambiguous").otherwise("unresolved")
    )
    people_of = (
        F.when(method == "exact_name_same_scope", F.col("exact")).when(method == "unique_surname_same_scope", F.col("suffix"))
        .when(method == "unique_first_last_same_scope", F.col("qualified")).otherwise(F.array().cast("array<bigint>"))
    )
    return out.select("record_id", people_of.alias("person_ids"), method.alias("method"))


def canonical_ids(pairs: DataFrame) -> DataFrame:
    """Alias closure: pairs (u, v) of ids of one entity; returns (node, root), the least id of each entity."""
    return connected_components(pairs.select("u", "v"))


def remap(facts: DataFrame, column: str, canonical: DataFrame) -> DataFrame:
    """Foreign keys replaced by their canonical id; others stay."""
    names = canonical.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return facts.join(names, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_root", column)).drop("_node", "_root")


def author_matches(records: DataFrame, roster: DataFrame, least: float = 0.55) -> DataFrame:
    """(record_id, person_id, score): shared tokens by the longer name's, 0.2 each for the last token and the scope, 1 at most.

    Candidates of one scope meet in any token they share. Those of different scopes need a share of ``least`` - 0.2, so they meet
    in one of a name's rarest tokens: a name of n tokens leaves out as many of its most frequent ones as it must share less one.
    """

    def named(df: DataFrame, key: str) -> DataFrame:
        tokens = name_tokens(F.col("name"))
        return df.select(F.col(key).alias("id"), "scope", F.array_distinct(tokens).alias("t"), F.when(F.size(tokens) > 0, F.element_at(tokens, -1)).alias("last")).where(F.size("t") > 0)

    a, b = named(records, "record_id"), named(roster, "person_id")
    words = [df.select("id", "scope", F.size("t").alias("n"), F.explode("t").alias("w")) for df in (a, b)]
    local = words[0].join(words[1], (words[0]["w"] == words[1]["w"]) & (words[0]["scope"] == words[1]["scope"])).select(words[0]["id"].alias("x"), words[1]["id"].alias("y"))
    often = words[0].select("w").unionByName(words[1].select("w")).groupBy("w").agg(F.count("*").alias("df"))

    def rare(df: DataFrame) -> DataFrame:
        ordered = df.join(often, "w").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("s"))
        keep = F.col("n") - F.ceil(F.col("n") * (least - 0.2) - 1e-9) + 1
        return ordered.select("id", F.explode(F.slice("s", 1, keep.cast("int"))).alias("e")).select("id", F.col("e.w").alias("w"))

    far = rare(words[0]).withColumnRenamed("id", "x").join(rare(words[1]).withColumnRenamed("id", "y"), "w").select("x", "y")
    pairs = local.unionByName(far).distinct()
    both = pairs.join(a.select(F.col("id").alias("x"), F.struct("scope", "t", "last").alias("p")), "x").join(b.select(F.col("id").alias("y"), F.struct("scope", "t", "last").alias("q")), "y")
    overlap = F.size(F.array_intersect("p.t", "q.t")) / F.greatest(F.size("p.t"), F.size("q.t"))
    extra = F.when(F.col("p.last") == F.col("q.last"), 0.2).otherwise(0.0) + F.when(F.col("p.scope") == F.col("q.scope"), 0.2).otherwise(0.0)
    return both.select(F.col("x").alias("record_id"), F.col("y").alias("person_id"), F.round(F.least(F.lit(1.0), overlap + extra), 6).alias("score")).where(F.col("score") >= least)
