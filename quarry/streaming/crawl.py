"""The crawl queue as tables: seeding, resuming, scope, outcomes, hosts, batches and its own history.

A queue is a table of items (url_key, url, state, attempts, depth, retry_at) and a table of contexts (url_key, department, kind, source). Each step
is a transformation of whole tables, so it can be a batch of a stream as well; states are pending, running, done, unresolved,
retained_prior_evidence and scope_excluded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import urls

# Attempts, waits in seconds, the least interval of a slow host, files that are no pages.
ATTEMPTS, WAIT, COOLDOWN, CAP, SLOW = 3, 30, 60, 3600, 10.0
FILES = r"(?i)\.(?:pdf|zip|png|jpe?g|gif|xlsx?|docx?|pptx?|bib|mp4)(?:$|\?)"


def seeds(*found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, contexts, rejected) of tables (url, department, kind, source, depth): one item a URL with the least depth, each context once.

    URLs that no request can be made to are kept beside as they were listed; files are no items.
    """
    rows = found[0]
    for df in found[1:]:
        rows = rows.unionByName(df)
    safe = rows.withColumn("safe", urls.safe_url(F.col("url")))
    rejected = safe.where("safe = ''").select("url", "department", "kind", "source", F.lit("invalid_literal_uri_not_requested").alias("status")).distinct()
    able = safe.where("safe <> ''").where(~F.col("url").rlike(FILES)).withColumn("url_key", urls.url_key(F.col("safe")))
    items = able.groupBy("url_key").agg(F.min("safe").alias("url"), F.min("depth").alias("depth"))
    return items.withColumns({"state": F.lit("pending"), "attempts": F.lit(0), "retry_at": F.lit(0.0)}), able.select("url_key", "department", "kind", "source").distinct(), rejected


def upserted(queue: DataFrame, items: DataFrame) -> DataFrame:
    """The queue with new items; known ones keep their state and take the least depth."""
    both = queue.select("url_key", F.struct("url", "state", "attempts", "depth", "retry_at").alias("q")).join(items.select("url_key", F.struct("url", "state", "attempts", "depth", "retry_at").alias("i")), "url_key", "full_outer")
    now = F.coalesce("q", "i")
    return both.select("url_key", now["url"].alias("url"), now["state"].alias("state"), now["attempts"].alias("attempts"), F.least(F.col("q.depth"), F.col("i.depth")).alias("depth"), now["retry_at"].alias("retry_at"))


def resumed(queue: DataFrame, retryable: Column, final_url: Column, not_before: Column, now: Column) -> DataFrame:
    """A queue that is opened again: what was running is pending, sign-in pages are unresolved, passing failures get another try later."""
    login = (F.col("state") == "done") & urls.authentication_target(F.coalesce(final_url, F.lit("")))
    again = (F.col("state") == "unresolved") & (F.col("attempts") < ATTEMPTS) & retryable
    state = F.when(F.col("state") == "running", "pending").when(login, "unresolved").when(again, "pending").otherwise(F.col("state"))
    later = F.greatest(F.coalesce(not_before, F.lit(0.0)), now + WAIT * F.pow(F.lit(2), F.col("attempts")))
    return queue.withColumns({"state": state, "retry_at": F.when(again, later).otherwise(F.col("retry_at"))})


def settled(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The queue after requests. outcomes: url_key, status, retryable, not_before. Every request is an attempt; failures that may pass wait twice as long each time."""
    met = queue.join(outcomes, "url_key", "left")
    tried = F.col("status").isNotNull()
    attempts = F.col("attempts") + F.when(tried, 1).otherwise(0)
    again = tried & (F.col("status") != "ok") & F.coalesce("retryable", F.lit(False)) & (attempts < ATTEMPTS)
    state = F.when(~tried, F.col("state")).when(F.col("status") == "ok", "done").when(again, "pending").otherwise("unresolved")
    later = F.greatest(F.coalesce("not_before", F.lit(0.0)), now + WAIT * F.pow(F.lit(2), attempts))
    return met.withColumns({"state": state, "attempts": attempts, "retry_at": F.when(again, later).otherwise(F.col("retry_at"))}).select(*queue.columns)


def scoped(queue: DataFrame, reason: Column) -> DataFrame:
    """Items that a reason speaks against are excluded with it; excluded ones that none speaks against any more are pending again."""
    out = F.coalesce(reason, F.lit("")) != ""
    state = F.when(out & F.col("state").isin("pending", "running", "unresolved"), "scope_excluded").when(~out & (F.col("state") == "scope_excluded"), "pending").otherwise(F.col("state"))
    return queue.withColumns({"scope_reason": F.when(out, reason), "state": state})


def scope_reason(url: Column, kinds: Column, depth: Column, official: Column, most_depth: int = 2) -> Column:
    """Why an item is outside the crawl: outside pages need a context that lists them, generic pages identify nobody, and links end at a depth."""
    listed = F.exists(kinds, lambda k: k.isin("lab_destination", "unresolved_candidate", "profile"))
    return F.coalesce(urls.generic_external_reason(url), F.when(~official & ~listed, "outside").when(depth > most_depth, "too_deep"), F.lit(""))


def scope_counts(queue: DataFrame) -> DataFrame:
    """How many items each reason excludes, and how many of a state none does."""
    return queue.groupBy("state", "scope_reason").agg(F.count("*").alias("items"), F.min("depth").alias("least_depth"))


def next_batch(queue: DataFrame, hosts: DataFrame, now: Column, per_host: int, most: int) -> DataFrame:
    """Items to ask for now: due, of hosts that may be asked, the least depth first, at most per_host of one and most at once.

    hosts: host, not_before. Spark limits each task to a host's first items before it shuffles, so a hot host's backlog stays where it is.
    """
    from pyspark.sql import Window

    due = queue.where((F.col("state") == "pending") & (F.col("retry_at") <= now)).withColumn("host", urls.host(F.col("url")))
    open_ = due.join(hosts.select("host", "not_before"), "host", "left").where(F.coalesce("not_before", F.lit(0.0)) <= now).drop("not_before")
    order = Window.partitionBy("host").orderBy("depth", "attempts", "url_key")
    return open_.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= per_host).orderBy("turn", "depth", "url_key").limit(most)


def deferred(hosts: DataFrame, answers: DataFrame) -> DataFrame:
    """Hosts after their answers. hosts: host, not_before, failures. answers: host, at, status, retry_after (seconds or null).

    An answer that asks to wait counts as a failure and doubles the wait up to an hour, or as long as it says; a good answer clears the failures.
    """
    busy = F.col("status").isin(429, 503)
    last = answers.groupBy("host").agg(F.max_by(F.struct("status", "retry_after", "at"), "at").alias("a"), F.count_if(busy).alias("times"))
    met = hosts.join(last, "host", "full_outer")
    waits = F.col("a.status").isin(429, 503)
    failures = F.when(F.col("a").isNull(), F.coalesce("failures", F.lit(0))).when(waits, F.coalesce("failures", F.lit(0)) + F.col("times").cast("int")).otherwise(0)
    wait = F.greatest(F.coalesce("a.retry_after", F.lit(0.0)), F.least(F.lit(float(CAP)), COOLDOWN * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(6)))))
    return met.select("host", F.when(waits, F.greatest(F.coalesce("not_before", F.lit(0.0)), F.col("a.at") + wait)).otherwise(F.coalesce("not_before", F.lit(0.0))).alias("not_before"), failures.cast("int").alias("failures"))


def intervals(hosts: Column, slow: tuple[str, ...], least: float = 1.0) -> Column:
    """Seconds between requests of a host; slow ones need more."""
    return F.when(urls.within_any(hosts, slow), F.greatest(F.lit(SLOW), F.lit(least))).otherwise(F.lit(least)) if slow else F.lit(least)


def discovered(items: DataFrame, links: DataFrame, most_depth: int = 2) -> DataFrame:
    """(url, department, kind, source, depth) of the links of pages that were read: one deeper, in the page's contexts. links: url_key, target; items: url_key, url, depth, department."""
    return items.where(F.col("depth") < most_depth).join(links, "url_key").select(F.col("target").alias("url"), "department", F.lit("directory").alias("kind"), F.col("url").alias("source"), (F.col("depth") + 1).alias("depth"))


def rebound(decisions: DataFrame, queue: DataFrame) -> DataFrame:
    """Decisions (selector, ...) whose selector is an older form of a URL, on the key of the one item that its loose form names; ambiguous ones keep their selector."""
    keys = queue.groupBy(urls.loose_key(F.col("url")).alias("loose")).agg(F.count("*").alias("n"), F.min("url_key").alias("key")).where("n = 1")
    met = decisions.join(keys, urls.loose_key(decisions["selector"]) == keys["loose"], "left")
    return met.withColumn("selector", F.coalesce("key", "selector")).select(*decisions.columns)


def due_for_rescan(stamps: Column, status: Column, cutoff: Column) -> Column:
    """Whether a verified record's checks are all older than a cutoff."""
    known = F.array_compact(stamps)
    return F.coalesce((status == "verified") & (F.size(known) > 0) & F.forall(known, lambda t: t < cutoff), F.lit(False))


def profile_queue(records: DataFrame, official: Column, rescan: Column) -> DataFrame:
    """Records by what is to be done: selected for a request, unresolved without an address of their own, or outside the campus."""
    return records.withColumn("plan", F.when(~official, "outside").when(F.coalesce("url", F.lit("")).isin("", "Not found"), "unresolved").when(rescan | (F.col("status") != "verified"), "selected").otherwise("settled"))
