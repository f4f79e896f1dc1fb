"""Rules of whole records: sources, recruiting claims, evidence, courses, ratings, publications and profiles, as named columns for ``quality.violations``.

A rule is a column that is true where a record keeps it. Columns are named as the arguments say, so that any table can be checked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.dates import valid_date
from quarry.functions.urls import valid_url

# States that records, courses, ratings and profiles may have.
RECRUITING = ("Recruiting", "Not recruiting", "Unknown")
VERIFICATION = ("source_checked", "needs_review", "unavailable", "legacy_unverified")
COURSES = ("historical", "scheduled", "undated", "current", "planned", "tentative")
RATINGS = ("verified", "no_reviews", "not_checked", "not_found", "unavailable", "needs_review")


def _known(value: Column) -> Column:
    return F.trim(F.coalesce(value.cast("string"), F.lit(""))) != ""


def required(fields: list[Column]) -> dict[str, Column]:
    return {f"missing_{k}": f.isNotNull() for k, f in enumerate(fields)}


def url_or_missing(value: Column) -> Column:
    return F.coalesce(value.isin("Not found", "Unknown") | valid_url(value), F.lit(False))


def common(institution: Column, department: Column, areas: Column) -> dict[str, Column]:
    """Areas may be empty, which means unknown, but not blank."""
    return {"institution": _known(institution), "department": _known(department), "areas": areas.isNotNull() & F.forall(areas, _known)}


def sources(urls: Column) -> dict[str, Column]:
    return {"sources_empty": F.coalesce(F.size(urls) > 0, F.lit(False)), "sources_invalid": F.forall(urls, valid_url)}


def recruiting(status: Column, text: Column, url: Column, urls: Column) -> dict[str, Column]:
    """A claim needs explicit text and a URL that is among the sources."""
    claims = F.coalesce(status.isin("Recruiting", "Not recruiting"), F.lit(False))
    web = F.coalesce(url.rlike("(?i)^https?://"), F.lit(False))
    return {
        "recruiting_status": status.isin(*RECRUITING), "recruiting_text": ~claims | _known(text), "recruiting_url": ~claims | web,
        "recruiting_source": ~claims | F.coalesce(F.array_contains(urls, url), F.lit(False)),
    }


def evidence(proofs: Column, urls: Column, today: Column) -> dict[str, Column]:
    """proofs: array of struct(field, source, observed_at, evidence)."""
    return {
        "evidence_text": F.forall(proofs, lambda p: valid_url(p["source"]) & _known(p["evidence"])), "evidence_source": F.forall(proofs, lambda p: F.coalesce(F.array_contains(urls, p["source"]), F.lit(False))),
        "evidence_date": F.forall(proofs, lambda p: valid_date(p["observed_at"], today)),
    }


def verification(status: Column, verified: Column, proofs: Column, link_review: Column) -> dict[str, Column]:
    """The fields said to be verified are those with evidence, and a reviewed link issue stays one."""
    fields = F.array_sort(F.array_distinct(F.filter(F.transform(proofs, lambda p: p["field"]), lambda f: f != "profileLinkIdentityReview")))
    return {
        "verification_status": status.isin(*VERIFICATION), "checked_without_evidence": (status != "source_checked") | (F.size(fields) > 0), "fields_verified": F.array_sort(verified) == fields,
        "link_review": ~F.coalesce(link_review, F.lit(False)) | (status == "needs_review"),
    }


def courses(rows: Column, urls: Column, today: Column) -> dict[str, Column]:
    """rows: array of struct(code, term, source, observed_at, evidence, status, confidence, verification)."""
    complete = lambda c: _known(c["code"]) & _known(c["term"]) & _known(c["source"]) & _known(c["observed_at"]) & _known(c["evidence"])
    return {
        "course_fields": F.forall(rows, complete), "course_source": F.forall(rows, lambda c: valid_url(c["source"]) & F.coalesce(F.array_contains(urls, c["source"]), F.lit(False))),
        "course_status": F.forall(rows, lambda c: F.coalesce(c["status"].isin(*COURSES), F.lit(False))),
        "course_unconfirmed": F.forall(rows, lambda c: ~F.coalesce((c["confidence"] == "low") | (c["verification"] == "needs_review"), F.lit(False))),
        "course_date": F.forall(rows, lambda c: valid_date(c["observed_at"], today)),
    }


def rating(status: Column, score: Column, scale: Column, count: Column, source: Column, proven: Column) -> dict[str, Column]:
    """A verified rating has a score of 1 to 5, reviews and a proof; any other has no score at all."""
    good = F.coalesce(status == "verified", F.lit(False))
    return {
        "rating_status": status.isin(*RATINGS), "rating_score": ~good | F.coalesce(score.between(1, 5) & (scale == 5), F.lit(False)), "rating_count": ~good | F.coalesce(count >= 1, F.lit(False)),
        "rating_proof": ~good | F.coalesce(valid_url(source) & proven, F.lit(False)), "rating_unverified": good | score.isNull(),
    }


def publication(title: Column, year: Column, url: Column, doi: Column, impact: Column) -> dict[str, Column]:
    """impact: struct(value, year, source, status) or null."""
    return {
        "publication_title": _known(title), "publication_year": year.isNotNull(), "publication_url": url_or_missing(url), "publication_doi": doi.isNull() | url_or_missing(doi),
        "impact_status": impact.isNotNull() & impact["status"].isin("verified", "not_checked", "unavailable"),
    }


def profiles(rows: Column, states: tuple[str, ...]) -> dict[str, Column]:
    """rows: array of struct(kind, url, search_url, source, status, checked)."""
    return {
        "profile_status": F.forall(rows, lambda p: F.coalesce(p["status"].isin(*states), F.lit(False))),
        "profile_urls": F.forall(rows, lambda p: url_or_missing(p["url"]) & url_or_missing(p["search_url"]) & url_or_missing(p["source"])), "profile_checked": F.forall(rows, lambda p: p["checked"].isNotNull()),
    }


def metric_sources(rows: Column) -> dict[str, Column]:
    """rows: array of struct(source, url)."""
    return {"metric_source": F.forall(rows, lambda m: _known(m["source"]) & url_or_missing(m["url"]))}
