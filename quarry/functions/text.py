"""Text functions: folding, normal form, tokens, names, snippets, e-mail addresses. All are native column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def bases() -> dict[str, str]:
    """Characters of the basic plane whose compatibility form without marks differs: accented letters, full-width forms, voiced kana, ligatures.

    Syllables and signs that come apart into several letters of other scripts stay, on both sides of a comparison.
    """
    found = {}
    for c in map(chr, range(0xC0, 0xFFFE)):
        if unicodedata.category(c)[0] not in "LNSP" or 0xAC00 <= ord(c) <= 0xD7A3:
            continue
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
        if base != c and base and (len(base) == 1 or base.isascii() and base.isalpha()):
            found[c] = base
    return found


@lru_cache(maxsize=1)
def _single() -> tuple[str, str]:
    one = {c: b for c, b in bases().items() if len(b) == 1}
    return "".join(one), "".join(one.values())


def _unfolded(text: Column) -> Column:
    """Compatibility forms without marks."""
    letters, plain = _single()
    text = F.translate(text, letters, plain)
    ligatures = {c: b for c, b in bases().items() if len(b) > 1 and "\ufb00" <= c <= "\ufb06"}
    several = text.rlike("[" + "".join(ligatures) + "]")
    out = text
    for c, b in ligatures.items():
        out = F.replace(out, F.lit(c), F.lit(b))
    return F.regexp_replace(F.when(several, out).otherwise(text), r"\p{M}+", "")


def fold_text(text: Column) -> Column:
    """Lower case without accents; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    # bytes beyond the characters: only then is there anything to fold
    return F.lower(F.when(F.octet_length(text) > F.char_length(text), _unfolded(text)).otherwise(text))


def folded(text: str) -> str:
    """``fold_text`` of a value, for queries."""
    ligatures = {c: b for c, b in bases().items() if len(b) == 1 or "\ufb00" <= c <= "\ufb06"}
    text = text.translate(str.maketrans(ligatures))
    return "".join(c for c in text if not unicodedata.category(c).startswith("M")).lower()


def to_ascii(text: Column) -> Column:
    """ASCII letters of compatibility forms; what has none vanishes. Null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) > F.char_length(text), F.regexp_replace(_unfolded(text), r"[^\x00-\x7F]+", "")).otherwise(text)


def normalize(text: Column) -> Column:
    """Folded text in which each run of other characters than letters, digits and @ . + - is one space."""
    return F.trim(F.regexp_replace(fold_text(text), r"[^\p{L}\p{N}@.+-]+", " "))


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), normalize(text), F.lit(" "))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(normalize(text), " "), "")


def vocabulary_tokens(text: Column) -> Column:
    """Distinct runs of letters and digits, of three characters or more; whether they are letters alone is cheaper told of distinct ones."""
    return F.array_distinct(F.filter(F.split(fold_text(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))


def is_known(value: Column) -> Column:
    """False for null, empty and the two sentinels of missing values."""
    return value.isNotNull() & ~value.isin("", "Not found", "Unknown")


def name_tokens(name: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(fold_text(name), r"[^\p{L}\p{N}]+", " "), " "), "")


def snippet(text: Column, position: Column, length: Column, before: int = 110, after: int = 130) -> Column:
    """What stands round a phrase at a position from 1, as one line."""
    start = F.greatest(position - before, F.lit(1))
    cut = F.substring(text, start, position + length + after - start)
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def first_email(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", 0)
    return F.lower(F.nullif(found, F.lit("")))


def first_sentence(text: Column, words: list[str], least: int = 60, most: int = 260) -> Column:
    """The first sentence of a fitting length that has one of the words; null without one."""
    sentences = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+")
    has = lambda s: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(s), w))
    return F.get(F.filter(sentences, lambda s: F.length(s).between(least, most) & has(s)), F.lit(0))
