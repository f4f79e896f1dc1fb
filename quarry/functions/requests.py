"""What became of a request: retries, scope and proof, as column expressions over a capture's fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.dates import robots_retry_at
from quarry.functions.urls import request_key

# Statuses of redirects, errors that no retry mends.
REDIRECTS = (301, 302, 303, 307, 308)
FINAL_ERRORS = ("access_challenge", "robots_redirect_is_not_a_robots_file", "robots_response_is_html")
REFUSED = r"(?i)curl:\s*\((?:1|3|60|63|77)\)|certificate|response_exceeds_size_limit"
#: Seconds that a host's rules are good for, attempts at most.
ROBOTS_TTL, ATTEMPTS = 86_400, 3


def transient(status: Column, http_status: Column, error: Column) -> Column:
    """Whether a failure may pass: server and transport errors, not refusals by permission or certificate."""
    error = F.coalesce(error, F.lit(""))
    retry = http_status.isin(408, 429) | http_status.between(500, 599)
    return (
        F.when(error.isin(*FINAL_ERRORS), False).when(F.coalesce(retry, F.lit(False)), True).when(error.rlike(REFUSED), False)
        .otherwise(F.coalesce(http_status == 0, F.lit(False)) | F.coalesce(status == "fetch_error", F.lit(False)) | error.rlike(r"curl:\s*\(\d+\)"))
    )


def retryable(status: Column, http_status: Column, error: Column, robots: Column) -> Column:
    """robots: struct(status, http_status, error, attempts) of the host's rules, which decide where they were not to be had."""
    rules = (F.coalesce(robots["attempts"], F.lit(1)) < ATTEMPTS) & transient(robots["status"], robots["http_status"], robots["error"])
    refused = status.isin("authentication_required", "robots_denied", "access_challenge")
    return F.when(status == "robots_unavailable", rules).when(refused, False).otherwise(transient(status, http_status, error))


def reusable_robots(meta: Column, now: Column) -> Column:
    """Whether a host's stored rules may be used: a day old at most, redirects recorded, and no failure that may be tried again."""
    old = now - F.coalesce(meta["retrieved"], F.lit(0)) > ROBOTS_TTL
    unrecorded = meta["http_status"].isin(*REDIRECTS) & meta["redirects"].isNull()
    attempts = F.coalesce(meta["attempts"], F.lit(1))
    again = (meta["status"] == "unavailable") & (attempts < ATTEMPTS) & transient(meta["status"], meta["http_status"], meta["error"])
    again = again & (now >= robots_retry_at(meta["retry_after_at"], meta["retrieved"], meta["attempts"]))
    return F.coalesce(meta.isNotNull() & ~old & ~F.coalesce(unrecorded, F.lit(False)) & ~F.coalesce(again, F.lit(False)), F.lit(False))


def request_proven(url: Column, http_status: Column, redirects: Column, made: Column) -> Column:
    """Whether a page was asked for at all: a status, a mark, or a redirect that began at the URL. redirects: array of (from, to, http_status)."""
    began = F.exists(F.coalesce(redirects, F.array().cast(REDIRECTS_TYPE)), lambda r: r["http_status"].isin(*REDIRECTS) & (request_key(r["from"]) == request_key(url)))
    return F.coalesce(made, F.lit(False)) | F.coalesce(http_status.between(0, 599), F.lit(False)) | F.coalesce(began, F.lit(False))


REDIRECTS_TYPE = "array<struct<from:string,to:string,http_status:int>>"


def request_scope(url: Column, listed: Column, proven: Column) -> Column:
    """Whether the listed URL itself was asked for, another one, or none but the host's rules."""
    same = F.coalesce(request_key(url) == request_key(listed), F.lit(False))
    return (
        F.when(request_key(url).isNull(), "unknown_request_provenance").when(proven & same, "listed_url_direct_request").when(proven, "related_url_request_only")
        .when(same, "listed_url_access_precheck_only").otherwise("related_url_access_precheck_only")
    )
