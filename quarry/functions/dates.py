"""Date functions: academic terms, local dates, backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The month in which each term ends (on the 28th), and the order of terms in a year.
TERM_END = {"Fall": 12, "Winter": 3, "Spring": 6, "Summer": 9, "Summer 1": 8, "Summer 2": 9, "Summer 3": 9}
TERM_ORDER = {"winter": 1, "spring": 2, "summer": 3, "fall": 4, "autumn": 4}


def _pick(key: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, table.values())), F.array_position(F.array(*map(F.lit, table)), key).cast("int") - 1), F.lit(0))


def term_order(term: Column) -> Column:
    """Sorts terms by year and season; what is not named counts as 0."""
    term = F.coalesce(term, F.lit(""))
    year = F.coalesce(F.nullif(F.regexp_extract(term, r"\b(?:19|20)\d{2}\b", 0), F.lit("")).cast("int"), F.lit(0))
    return year * 10 + _pick(F.lower(F.regexp_extract(term, r"(?i)\b(winter|spring|summer|fall|autumn)\b", 1)), TERM_ORDER)


def term_status(term: Column, as_of: Column) -> Column:
    """historical if the term's last day is before as_of, else scheduled; undated if it is not season and year alone."""
    pattern = r"^(Fall|Winter|Spring|Summer(?: [123])?) (\d{4})$"
    month = _pick(F.regexp_extract(F.coalesce(term, F.lit("")), pattern, 1), TERM_END)
    year = F.nullif(F.regexp_extract(F.coalesce(term, F.lit("")), pattern, 2), F.lit("")).cast("int")
    end = F.make_date(year, F.greatest(month, F.lit(1)), F.lit(28))
    return F.when((month == 0) | year.isNull(), "undated").when(end < as_of, "historical").otherwise("scheduled")


def local_date(at: Column, zone: str = "America/Los_Angeles") -> Column:
    """Calendar date in a zone of a UTC timestamp."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def queue_backoff(attempts: Column) -> Column:
    """Seconds until the next attempt."""
    return (F.lit(30) * F.pow(F.lit(2.0), attempts)).cast("long")


def host_backoff(failures: Column) -> Column:
    """Seconds that a host rests after so many failures in a row."""
    return F.least(F.lit(3600.0), F.lit(60) * F.pow(F.lit(2.0), F.least(failures - 1, F.lit(6)))).cast("long")


def date_label(value: Column) -> Column:
    """A date as it is, a time as the local date of the records' place; words for none and for what is neither."""
    when = F.try_to_timestamp(value)
    local = F.date_format(F.from_utc_timestamp(when, "America/Los_Angeles"), "yyyy-MM-dd")
    known = value.isNotNull() & ~value.isin("", "Not found", "Unknown")
    return F.when(~known, "Not checked").when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value).when(when.isNull(), "Date unavailable").otherwise(local)


def valid_date(value: Column, today: Column) -> Column:
    """An ISO date or time that is not in the future; false for null."""
    when = F.try_to_timestamp(F.regexp_replace(value, "Z$", "+00:00"))
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}") & (when.cast("date") <= today), F.lit(False))


def valid_time(value: Column) -> Column:
    """An ISO time with a zone."""
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(?:Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait, from a number or an HTTP date; null for neither, never negative."""
    seconds = value.try_cast("double")
    at = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, F.unix_timestamp(at).cast("double") - now)
    return F.when(F.isnan(wait) | (F.abs(wait) == float("inf")), None).otherwise(F.greatest(wait, F.when(wait.isNotNull(), F.lit(0.0))))


def robots_retry_at(retry_after_at: Column, retrieved: Column, attempts: Column) -> Column:
    """When a host's rules may be asked for again: its own word, or a minute doubled by each attempt."""
    return F.greatest(F.coalesce(retry_after_at, F.lit(0)), F.coalesce(retrieved, F.lit(0)) + 60 * F.pow(F.lit(2), F.greatest(F.lit(0), F.coalesce(attempts, F.lit(1)) - 1)))


def host_wait(last: Column, interval: Column, not_before: Column, now: Column) -> Column:
    """Seconds until a host may be asked again."""
    return F.greatest(F.lit(0.0), F.coalesce(last, F.lit(0.0)) + F.greatest(F.lit(1.0), F.coalesce(interval, F.lit(0.0))) - now, F.coalesce(not_before, F.lit(0.0)) - now)


def numeric(value: Column) -> Column:
    """A number, or 0."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def doi(identifier: Column, url: Column) -> Column:
    """A publication's own identifier, else its resolver link; null without either."""
    return F.when(F.coalesce(identifier, F.lit("")) != "", identifier).when(F.contains(url, F.lit("doi.org/")), url)
