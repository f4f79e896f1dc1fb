"""Lookups that answer only where the answer is one: by id, URL or name, in ranked steps, by host, by pattern and by route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import urls


def only(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """(key, member, members): the one member of each key, null where several share it."""
    known = rows.select(key.alias("key"), F.col(member)).where("key is not null and key <> ''").distinct()
    grouped = known.groupBy("key").agg(F.min(member).alias(member), F.count("*").alias("members"))
    return grouped.withColumn(member, F.when(F.col("members") == 1, F.col(member)))


def candidates(rows: DataFrame, entities: DataFrame, url: str, member: str) -> DataFrame:
    """rows with each entity whose URL is the same resource."""
    keyed = entities.select(urls.url_key(F.col(url)).alias("_k"), F.col(member).alias("found")).where("_k <> ''")
    return rows.join(keyed, urls.url_key(rows[url]) == keyed["_k"]).drop("_k")


def variants(entities: DataFrame, url: str, member: str) -> DataFrame:
    """Entities whose URLs are spellings of one another, for review: (key, members, first) of loose keys with several resources."""
    keyed = entities.select(urls.comparison_key(F.col(url)).alias("key"), urls.url_key(F.col(url)).alias("resource"), member).where("key <> ''")
    return keyed.groupBy("key").agg(F.count_distinct("resource").alias("resources"), F.count("*").alias("members"), F.min(member).alias("first")).where("resources > 1")


def resolve(rows: DataFrame, entities: DataFrame, steps: list[tuple[str, Column, Column]], row_id: str, member: str) -> DataFrame:
    """row_id, found, step: the entity of the first step whose key names exactly one. steps: (name, key of rows, key of entities).

    A key that several entities share answers nothing, and later steps are tried. One join a step, on distinct keys.
    """
    out = rows.select(row_id, *[k.alias(f"_k{i}") for i, (_, k, _) in enumerate(steps)])
    for i, (_, _, own) in enumerate(steps):
        one = only(entities, own, member).where(F.col(member).isNotNull()).select(F.col("key").alias(f"_k{i}"), F.col(member).alias(f"_f{i}"))
        out = out.join(one, f"_k{i}", "left")
    found = F.coalesce(*[F.col(f"_f{i}") for i in range(len(steps))])
    step = F.coalesce(*[F.when(F.col(f"_f{i}").isNotNull(), F.lit(name)) for i, (name, _, _) in enumerate(steps)])
    return out.select(row_id, found.alias("found"), step.alias("step"))


def record_index(entities: DataFrame, member: str, aliases: str) -> DataFrame:
    """(identity, member): ids and aliases, each with the one entity that owns it; ambiguous ones have null."""
    each = entities.select(F.col(member), F.explode(F.array_union(F.array(F.col(member)), F.coalesce(aliases, F.array().cast(entities.schema[aliases].dataType)))).alias("identity")).distinct()
    return each.groupBy("identity").agg(F.min(member).alias(member), F.count("*").alias("owners")).withColumn(member, F.when(F.col("owners") == 1, F.col(member)))


def by_host(url: Column, owners: dict[str, str], fallback: Column) -> Column:
    """The owner of a URL's host, www. aside."""
    table = F.create_map(*[F.lit(x) for kv in owners.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.regexp_replace(urls.bare_host(url), r"^www\.", "")), fallback)


def classified(value: Column, known: dict[str, str], patterns: list[tuple[str, str]], fallback: str) -> Column:
    """The class of a key: its own where it is known, else that of the first pattern that matches, else the fallback."""
    own = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), value) if known else F.lit(None).cast("string")
    out = F.when(own.isNotNull(), own)
    for pattern, label in patterns:
        out = out.when(value.rlike(pattern), label)
    return out.otherwise(fallback)


def routes(patches: DataFrame, people: DataFrame, url: str, person: str) -> tuple[DataFrame, DataFrame]:
    """(applied, held): patches whose URL is one person's, with that person, and those of a URL that several or none have."""
    one = only(people, urls.url_key(F.col(url)), person)
    met = patches.join(one.select(F.col("key").alias("_k"), F.col(person), "members"), urls.url_key(patches[url]) == F.col("_k"), "left").drop("_k")
    return met.where(F.col(person).isNotNull()), met.where(F.col(person).isNull())


def matched_ratings(ratings: DataFrame, people: DataFrame) -> DataFrame:
    """ratings (rating_id, name, department) and people (person_id, name, department): rating_id, person_id of equal keys of names.

    Several people of one key are told apart by the whole name, else by a department with a word in common; what stays ambiguous is no match.
    """
    from quarry.functions.names import published_name, without_middle_initials

    stop = F.array(*map(F.lit, ("and", "of", "the", "department", "science", "sciences", "engineering", "studies")))
    words = lambda c: F.array_except(F.array_distinct(F.filter(F.split(published_name(c), " "), lambda w: w != "")), stop)
    side = lambda df, k, n: df.select(F.col(k), without_middle_initials(F.col("name")).alias("key"), F.struct(published_name(F.col("name")).alias("name"), words(F.col("department")).alias("words")).alias(n))
    met = side(ratings, "rating_id", "r").join(side(people, "person_id", "p"), "key").where("key <> ''")
    exact, related = F.col("r.name") == F.col("p.name"), F.arrays_overlap("r.words", "p.words")
    told = met.select("rating_id", "person_id", exact.alias("exact"), related.alias("related"), F.col("p.name").alias("name"))
    sums = told.groupBy("rating_id").agg(F.count("*").alias("n"), F.count_if("exact").alias("exacts"), F.count_if("related").alias("relateds"), F.count_distinct(F.when(F.col("related"), F.col("name"))).alias("names"))
    keep = F.when(F.col("n") < 2, True).when(F.col("exacts") > 0, F.col("exact")).otherwise(F.col("related") & ((F.col("relateds") == 1) | (F.col("names") == 1)))
    return told.join(sums, "rating_id").where(keep).select("rating_id", "person_id")


def captures_of(listed: DataFrame, captures: DataFrame, url: str) -> DataFrame:
    """listed (url) with captures (capture, url, final_url, observed_at): each listed URL's newest direct capture, and how many related ones led there."""
    direct = captures.groupBy(urls.url_key(F.col(url)).alias("key")).agg(F.max_by("capture", F.struct("observed_at", "capture")).alias("direct"), F.count("*").alias("captures"))
    related = captures.where(~urls.url_key(F.col(url)).eqNullSafe(urls.url_key(F.col("final_url")))).groupBy(urls.url_key(F.col("final_url")).alias("key")).agg(F.count("*").alias("related"))
    keyed = listed.withColumn("key", urls.url_key(F.col(url)))
    return keyed.join(direct, "key", "left").join(related, "key", "left").select(*listed.columns, "direct", F.coalesce("captures", F.lit(0)).alias("captures"), F.coalesce("related", F.lit(0)).alias("related"))


def incremental(targets: DataFrame, receipts: DataFrame, fresh: Column, key: str) -> DataFrame:
    """targets and receipts by key: which to reuse, probe, or keep of targets that vanished."""
    both = targets.select(key, F.lit(True).alias("wanted")).distinct().join(receipts.withColumn("fresh", fresh), key, "full_outer")
    plan = F.when(F.col("wanted").isNull(), "kept").when(F.coalesce("fresh", F.lit(False)), "reused").otherwise("probed")
    return both.withColumn("plan", plan).drop("wanted", "fresh")


def page_faults(pages: DataFrame, page: str, total: str, rows: DataFrame, row_id: str) -> DataFrame:
    """(fault, n) of a source read page by page: a total that changed, repeated ids, empty pages, and rows that are missing."""
    said = pages.agg(F.count_distinct(total).alias("totals"), F.max(total).alias("total"), F.count_if(F.col("rows") == 0).alias("empty"))
    got = rows.agg(F.count("*").alias("rows"), F.count_distinct(row_id).alias("ids"))
    faults = F.array(
        F.struct(F.lit("total_changed").alias("fault"), (F.col("totals") - 1).alias("n")), F.struct(F.lit("repeated_ids").alias("fault"), (F.col("rows") - F.col("ids")).alias("n")),
        F.struct(F.lit("empty_pages").alias("fault"), F.col("empty").alias("n")), F.struct(F.lit("missing_rows").alias("fault"), F.greatest(F.col("total") - F.col("ids"), F.lit(0)).cast("long").alias("n")),
    )
    return said.crossJoin(got).select(F.inline(faults))  # one row each


def reviews_due(registry: DataFrame, counts: dict[str, DataFrame], on: str) -> DataFrame:
    """Every registered key with its number in each counted table, zero included."""
    for name, df in counts.items():
        registry = registry.join(df.groupBy(on).agg(F.count("*").alias(name)), on, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return registry
