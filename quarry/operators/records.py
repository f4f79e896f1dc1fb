"""Records of one entity from several sources: quality, best values, and lists that keep each entry once.

Groups are aggregated with partial results. Lists are long tables of (key, place, entry), reduced to each entry's first place,
so no group's lists are put together before they are short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.labels import low_information, title_score
from quarry.functions.text import is_known

CONFIDENCE = ("low", "medium", "high")


def confidence_rank(value: Column) -> Column:
    """low 1, medium 2, high 3, anything else 0."""
    return F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.coalesce(value, F.lit(""))).cast("int")


def listing_quality(confidence: Column, link_labels: Column, contacts: Column) -> Column:
    """Rank of a listing: confidence, kinds of links, contacts."""
    has = lambda *names: F.arrays_overlap(link_labels, F.array(*map(F.lit, names)))
    links = F.when(has("Faculty profile"), 3).otherwise(0) + F.when(has("Website", "Lab site", "Lab / research"), 2).otherwise(0) - F.when(has("Catalog faculty listing"), 1).otherwise(0)
    return F.struct(confidence_rank(confidence).alias("confidence"), links.alias("links"), contacts.alias("contacts"))


def lab_quality(confidence: Column, links: Column, interests: Column, summary: Column) -> Column:
    return F.struct(confidence_rank(confidence).alias("confidence"), links.alias("links"), interests.alias("interests"), F.length(F.coalesce(summary, F.lit(""))).alias("summary"))


def person_quality(academic: Column, website: Column, email: Column, profile: Column, summary: Column, sources: Column) -> Column:
    """Rank of a person's record: a known author, a site, an address, a profile of their own, an informative summary, sources."""
    one = lambda c: c.cast("int")
    own = is_known(profile) & ~F.contains(profile, F.lit("catalog.")) & ~F.contains(profile, F.lit("/api/"))
    return F.struct(
        one(F.coalesce(is_known(academic), F.lit(False))).alias("academic"), one(F.coalesce(is_known(website), F.lit(False))).alias("website"), one(F.coalesce(is_known(email), F.lit(False))).alias("email"),
        one(F.coalesce(own, F.lit(False))).alias("profile"), one(~low_information(summary)).alias("summary"), sources.alias("sources"),
    )


def academic_quality(author: Column, citations: Column, h_index: Column, works: Column) -> Column:
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.struct(F.coalesce(is_known(author), F.lit(False)).cast("double").alias("author"), number(citations).alias("citations"), number(h_index).alias("h_index"), number(works).alias("works"))


def best_known(value: Column, rank: Column) -> Column:
    """Aggregate: the known value of the highest rank; null without one."""
    return F.max_by(value, F.when(is_known(value), rank))


def best_summary(summary: Column, tie: Column) -> Column:
    """Aggregate: the longest informative summary, else the longest; of equals the one with the greatest tie."""
    return F.max_by(summary, F.when(F.coalesce(summary, F.lit("")) != "", F.struct(~low_information(summary), F.length(summary), tie)))


def best_title(title: Column, tie: Column) -> Column:
    return F.max_by(title, F.struct(title_score(title), tie))


def best_confidence(value: Column) -> Column:
    """Aggregate: the highest confidence; medium where none says."""
    return F.max_by(F.coalesce(value, F.lit("medium")), confidence_rank(F.coalesce(value, F.lit("medium"))))


def consolidated(records: DataFrame, key: Column, rank: list[Column], values: dict[str, Column], member: str) -> DataFrame:
    """One record for each key: the best record's columns in ``best``, the aggregates in values, members and how many.

    rank orders the records; of equals the least member is kept.
    """
    order = F.struct(*rank, (-F.col(member)).alias("_tie"))
    best = F.max_by(F.struct(*[F.col(c) for c in records.columns]), order).alias("best")
    merged = F.array_sort(F.collect_set(member)).alias("merged_ids")
    return records.groupBy(key.alias("key")).agg(best, merged, F.count("*").alias("records"), *[v.alias(n) for n, v in values.items()])


def first_of_each(entries: DataFrame, keys: list[str], identity: Column, place: list[str]) -> DataFrame:
    """Each identity of a key once, the first by place; empty identities are left out. An aggregation with partial results."""
    rest = [c for c in entries.columns if c not in keys]
    found = entries.where(identity.isNotNull() & (identity != "")).groupBy(*keys, identity.alias("_identity"))
    return found.agg(F.min_by(F.struct(*rest), F.struct(*place)).alias("_e")).select(*keys, "_e.*")


def merged_links(links: DataFrame, key: str, place: list[str]) -> DataFrame:
    """links: key, label, url. Web links once by URL, with a word for a missing label."""
    web = links.where(F.col("url").rlike("^https?://")).withColumn("label", F.coalesce(F.nullif(F.col("label"), F.lit("")), F.lit("Source")))
    return first_of_each(web, [key], F.col("url"), place)


def merged_contacts(contacts: DataFrame, key: str, place: list[str]) -> DataFrame:
    """contacts: key, type, value, href. Once by link, else by type and value; shared mailboxes are no one's."""
    from quarry.functions.labels import clean_email, email_allowed

    value = F.when((F.col("type") == "email") & (F.coalesce("value", F.lit("")) == ""), clean_email(F.col("href"))).otherwise(F.coalesce("value", F.lit("")))
    own = contacts.withColumn("value", value).where((F.col("type") != "email") | email_allowed(F.col("value")))
    href = F.lower(F.coalesce("href", F.lit("")))
    return first_of_each(own, [key], F.when(href != "", href).otherwise(F.concat_ws(":", "type", F.lower("value"))), place)


def merged_people(people: DataFrame, key: str, place: list[str]) -> DataFrame:
    """people: key, name, role. Once by name and role in any case."""
    named = people.where(F.coalesce("name", F.lit("")) != "").withColumn("role", F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("Research contact")))
    return first_of_each(named, [key], F.concat_ws("\x00", F.lower("name"), F.lower("role")), place)


def merged_checks(checks: DataFrame, key: str, place: list[str]) -> DataFrame:
    """checks: key, kind, checked. Of each kind the first that was checked, else the first."""
    return first_of_each(checks, [key], F.col("kind"), ["unchecked", *place]) if "unchecked" in checks.columns else first_of_each(
        checks.withColumn("unchecked", ~F.coalesce("checked", F.lit(False))), [key], F.col("kind"), ["unchecked", *place]
    ).drop("unchecked")


def merged_affiliations(rows: DataFrame, key: str) -> DataFrame:
    """rows: key, department, title, source. One row a department: the best title, and its sources."""
    known = rows.where(F.coalesce("department", F.lit("")) != "")
    return known.groupBy(key, "department").agg(best_title(F.col("title"), F.col("title")).alias("title"), F.array_sort(F.collect_set("source")).alias("sources"))


def identity_edges(records: DataFrame, member: str, keys: dict[str, Column]) -> DataFrame:
    """(u, v) links of each record to the least one that shares a key; empty and missing keys link nothing."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), k.alias("key")) for n, k in keys.items()])).alias("k")
    spread = records.select(member, each).select(member, "k.*").where("key is not null and key <> ''")
    least = spread.groupBy("kind", "key").agg(F.min(member).alias("v"))
    return spread.join(least, ["kind", "key"]).select(F.col(member).alias("u"), "v").where("u <> v").distinct()


def reject(records: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected with reason) by a column that is empty where nothing speaks against a record."""
    marked = records.withColumn("reason", reason)
    return marked.where("reason = ''").drop("reason"), marked.where("reason <> ''")


def cleaned(records: DataFrame, key: str, rules: dict[str, tuple[str, Column, Column]]) -> tuple[DataFrame, DataFrame]:
    """rules: name -> (field, condition, replacement), applied in one pass to the values as they were.

    Returns the records and the log: key, field, previous, replacement, reason. Of several rules of a field the first that holds is applied.
    """
    by: dict[str, list[tuple[str, Column, Column]]] = {}
    for name, (fld, condition, replacement) in rules.items():
        by.setdefault(fld, []).append((name, F.coalesce(condition, F.lit(False)), replacement))
    changes, logs = {}, []
    for fld, own in by.items():
        value, reason = F.col(fld), F.lit(None).cast("string")
        for name, condition, replacement in reversed(own):
            value, reason = F.when(condition, replacement).otherwise(value), F.when(condition, F.lit(name)).otherwise(reason)
        changes[fld] = value
        changed = reason.isNotNull() & ~value.eqNullSafe(F.col(fld))
        logs.append(F.when(changed, F.struct(F.lit(fld).alias("field"), F.col(fld).cast("string").alias("previous"), value.cast("string").alias("replacement"), reason.alias("reason"))))
    log = records.select(F.col(key), F.explode(F.array_compact(F.array(*logs))).alias("c")).select(key, "c.*")
    return records.withColumns(changes), log


def paged(rows: DataFrame, order: list[Column], page: int, size: int = 40) -> DataFrame:
    """Rows up to and with the page, as a reader sees them who asked for more page by page."""
    return rows.orderBy(*order).limit((page + 1) * size)


def step_in(rows: DataFrame, order: list[Column], key: str, selected: Column, step: int) -> DataFrame:
    """The row a step after the selected one in an ordered page, or the nearest end. For pages, not whole tables."""
    from pyspark.sql import Window

    placed = rows.withColumn("_at", F.row_number().over(Window.orderBy(*order)))
    at = placed.agg(F.max(F.when(selected, F.col("_at"))).alias("s"), F.max("_at").alias("n"))
    wanted = at.select(F.greatest(F.lit(1), F.least(F.coalesce("s", F.lit(0)) + step, "n")).alias("_at"))
    return placed.join(F.broadcast(wanted), "_at").drop("_at").select(key)
