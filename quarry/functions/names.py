"""Names of people: normal forms, identity keys and comparisons that never guess. All are native column expressions.

Null counts as the empty text. Where two names are compared, a name without tokens matches nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import to_ascii

# Degrees and roles after a comma, degrees anywhere, titles before a name, words that are no part of a person's name.
DEGREE_AFTER_COMMA = (
    r"(?i),\s*(?:Ph\.?D\.?|Pharm\.?D\.?|M\.?D\.?|M\.?F\.?A\.?|D\.?M\.?A\.?|Ed\.?D\.?|J\.?D\.?|M\.?A\.?|M\.?S\.?|M\.?B\.?A\.?|M\.?P\.?H\.?|M\.?A\.?S\.?|B\.?A\.?|B\.?S\.?|B\.?F\.?A\.?|"
    r"Psy\.?D\.?|D\.?D\.?S\.?|D\.?V\.?M\.?|R\.?N\.?|BCPS|APh|Teaching Professor|Associate Professor|Assistant Professor|Professor|Lecturer)\b.*$"
)
CREDENTIALS = (
    r"(?<![A-Za-z])(?:Ph\.?D\.?|M\.?D\.?|D\.?O\.?|M\.?P\.?H\.?|M\.?P\.?A\.?|M\.?A\.?|M\.?Sc\.?|M\.?S\.?|MEd|MAS|MMM|MSW|MMSc|MBBS|DSc|ScD|DPhil|EdD|PharmD|MSPH|DMSc|DDS|MBA|FACOG|"
    r"DABCC\s*\(CC\)|FCSHP|FASHP|FABM|DFASHRM|FRCPSC|FASCO|FACP|ATSF|FACS|FAAD|MRCP|FACC|FAHA|FAAP|Au\.?D\.?|CCC-[A-Z]+|BCS-S|IBCLC)(?![A-Za-z])"
)
HONORIFICS = r"(?i)^(?:(?:adjunct|distinguished|emeritus|assistant|associate|professor|dr)\.?\s+)+"
NOT_A_PERSON = r"(?i)\d|\b(?:faculty|directory|research|staff|student|emeritus|professor|contact|website|chair|lecturer|profile)\b"
NO_INSTRUCTOR = r"(?i)^(?:staff|tbd|tba|not offered|various|cancelled|canceled|none|n/?a|\x{2714}|\x{2713}|x)(?:\W|$)"
PARENTHESES = r"\([^)]*\)"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def squeezed(value: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(_text(value), r"\s+", " "))


def normalized(value: Column) -> Column:
    """Lower-case ASCII letters and digits; anything else is a space."""
    return squeezed(F.regexp_replace(F.lower(to_ascii(value)), "[^a-z0-9 ]", " "))


def _parts(value: Column) -> Column:
    return F.array_remove(F.split(value, " "), "")


def name_key(name: Column) -> Column:
    """Letters alone, without parentheses; the grouping key of names."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(to_ascii(name), PARENTHESES, " ")), "[^a-z]+", " "))


def published_name(value: Column) -> Column:
    """Letters and digits; apostrophes vanish, so that O'Hara is one token."""
    return F.trim(F.regexp_replace(F.lower(to_ascii(F.regexp_replace(_text(value), "['’]", ""))), "[^a-z0-9]+", " "))


def without_middle_initials(value: Column) -> Column:
    """The published name without single letters inside; the first and last token stay."""
    parts = _parts(published_name(value))
    return F.array_join(F.filter(parts, lambda x, i: (i == 0) | (i == F.size(parts) - 1) | (F.length(x) > 1)), " ")


def person_in_text(name: Column, text: Column) -> Column:
    """Whether the first and the last token of a name of two or more stand in the text as whole words."""
    parts = _parts(normalized(F.regexp_replace(_text(name), PARENTHESES, "")))
    hay = F.concat(F.lit(" "), normalized(text), F.lit(" "))
    has = lambda t: F.contains(hay, F.concat(F.lit(" "), t, F.lit(" ")))
    return (F.size(parts) >= 2) & has(F.element_at(parts, 1)) & has(F.element_at(parts, -1))


def given_name_first(name: Column) -> Column:
    """'Last, First' as 'First Last'."""
    return F.when(F.contains(name, F.lit(",")), squeezed(F.concat(F.regexp_extract(name, "^[^,]*,(?s)(.*)$", 1), F.lit(" "), F.split_part(name, F.lit(","), F.lit(1))))).otherwise(name)


def roster_tokens(name: Column) -> Column:
    """ASCII letter runs of a name, given name first."""
    plain = F.regexp_replace(_text(name), PARENTHESES, "")
    return F.regexp_extract_all(F.lower(to_ascii(given_name_first(plain))), F.lit("[a-z]+"), F.lit(0))


def without_degree(raw: Column) -> Column:
    """A name without a doctorate at its end, given name first."""
    return given_name_first(squeezed(F.regexp_replace(_text(raw), r",?\s*(?:Ph\.?D\.?|M\.?D\.?)\s*$", "")))


def identity_name(raw: Column) -> Column:
    """Without honorifics, nicknames in quotes or parentheses, and punctuation. Missing given names are never inferred."""
    name = F.regexp_replace(without_degree(raw), HONORIFICS, "")
    name = F.regexp_replace(name, PARENTHESES + "|[\"'‘’“”][^\"'‘’“”]+[\"'‘’“”]", "")
    return normalized(F.regexp_replace(name, "['’]", ""))


def capitalised(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substr(word, F.lit(2))))


def smart_case(value: Column) -> Column:
    """Words all in capitals or all in small letters are capitalised; initials and quoted words stay."""
    keeps = lambda w: F.contains(w, F.lit(".")) | w.rlike("^[\"']")
    return F.array_join(F.transform(_parts(squeezed(value)), lambda w: F.when(~keeps(w) & ((F.upper(w) == w) | (F.lower(w) == w)), capitalised(w)).otherwise(w)), " ")


def canonical_name(value: Column) -> Column:
    """Without degrees and roles, given name first, in a reader's case."""
    name = F.trim(F.regexp_replace(_text(value), "​", ""))
    name = F.regexp_replace(squeezed(name), r"^[ *.,;:|]+|[ *.,;:|]+$", "")
    name = F.regexp_replace(F.regexp_replace(name, DEGREE_AFTER_COMMA, ""), "^[ ,]+|[ ,]+$", "")
    name = F.replace(name, F.lit("*"), F.lit(""))
    parts = F.array_remove(F.transform(F.split(name, ","), squeezed), "")
    flipped = F.concat(smart_case(F.get(parts, F.lit(1))), F.lit(" "), smart_case(F.get(parts, F.lit(0))))
    shouted = (F.upper(name) == name) & (F.lower(name) != name)
    return squeezed(F.when(F.contains(name, F.lit(",")), F.when(F.size(parts) >= 2, flipped).otherwise(name)).when(shouted, smart_case(name)).otherwise(name))


def slug(value: Column) -> Column:
    """ASCII letters and digits joined by hyphens; a digest where nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(to_ascii(value)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(plain != "", plain).otherwise(F.substring(F.sha1(_text(value)), 1, 12))


def merge_key(value: Column) -> Column:
    """The slug of a canonical name without middle initials."""
    parts = _parts(canonical_name(value))
    kept = F.filter(parts, lambda x, i: (i == 0) | (i == F.size(parts) - 1) | ~x.rlike(r"^[A-Z]\.?$"))
    return slug(F.array_join(F.when(F.size(parts) > 2, kept).otherwise(parts), " "))


def plain_name(name: Column) -> Column:
    """Without parentheses, titles and degrees; ASCII letters, apostrophes, hyphens and dots."""
    name = F.regexp_replace(_text(name), PARENTHESES, " ")
    name = F.regexp_replace(name, r"(?i)\b(?:PhD|MD|M\.D\.|Dr\.|Professor|Prof\.)\b", " ")
    return squeezed(F.regexp_replace(to_ascii(name), "[^A-Za-z .'-]+", " "))


def plain_tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(plain_name(name)), F.lit("[a-z]+"), F.lit(0))


def profile_slugs(name: Column) -> Column:
    """Addresses under which a person's profile may stand: first.last, with middle names, with the middle initial, by each alias."""
    parts = plain_tokens(name)
    first, last = F.element_at(parts, 1), F.element_at(parts, -1)
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    dotted = lambda *c: F.concat_ws(".", *c)
    aliases = F.transform(F.regexp_extract_all(_text(name), F.lit(r"\(([^)]+)\)"), F.lit(1)), lambda a: F.get(plain_tokens(a), F.lit(0)))
    found = F.concat(
        F.array(dotted(first, last), F.when(F.size(middle) > 0, dotted(first, F.array_join(middle, "."), last)), F.when(F.size(middle) > 0, dotted(first, F.substring(F.get(middle, F.lit(0)), 1, 1), last))),
        F.transform(F.filter(aliases, lambda a: a.isNotNull()), lambda a: dotted(a, last)),
    )
    return F.when(F.size(parts) >= 2, F.array_distinct(F.array_compact(found))).otherwise(F.array().cast("array<string>"))


def same_person(a: Column, b: Column) -> Column:
    """Equal names, or equal ends of which one has no middle name or both the same middle initial."""
    x, y = plain_tokens(a), plain_tokens(b)
    ends = (F.element_at(x, 1) == F.element_at(y, 1)) & (F.element_at(x, -1) == F.element_at(y, -1))
    middle = F.substring(F.get(x, F.lit(1)), 1, 1) == F.substring(F.get(y, F.lit(1)), 1, 1)
    sets = F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y))
    enough = (F.size(x) > 0) & (F.size(y) > 0)
    return enough & (sets | ((F.size(x) >= 2) & (F.size(y) >= 2) & ends & ((F.size(x) == 2) | (F.size(y) == 2) | middle)))


def names_match(a: Column, b: Column) -> Column:
    """Equal tokens, equal ends, the same first token with another in common, or equal letters."""
    x, y = plain_tokens(a), plain_tokens(b)
    first = F.element_at(x, 1) == F.element_at(y, 1)
    rest = lambda t: F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))
    found = (x == y) | (first & (F.element_at(x, -1) == F.element_at(y, -1))) | (first & F.arrays_overlap(rest(x), rest(y))) | (F.array_join(x, "") == F.array_join(y, ""))
    return (F.size(x) > 0) & (F.size(y) > 0) & F.coalesce(found, F.lit(False))


def valid_person_name(name: Column) -> Column:
    """Two to eight tokens, one before the last that is no initial, and no word of a page's furniture."""
    parts = _parts(normalized(F.regexp_replace(_text(name), PARENTHESES, "")))
    spelled = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda t: F.length(t) > 1)
    return F.size(parts).between(2, 8) & spelled & ~_text(name).rlike(NOT_A_PERSON)


def looks_like_person_name(value: Column, words: list[str], terms: list[str]) -> Column:
    """A canonical name of 5 to 70 characters in 2 to 5 words, two of them capitalised, that is none of the words and has none of the terms."""
    name = canonical_name(value)
    parts = F.array_remove(F.split(name, r"[\s-]+"), "")
    letters = F.transform(parts, lambda p: F.regexp_replace(p, "[^A-Za-zÀ-ÖØ-öø-ÿ'.]", ""))
    plausible = F.length(name).between(5, 70) & ~name.rlike(r"\p{Nd}") & F.size(parts).between(2, 5) & F.forall(letters, lambda p: p != "")
    capital = F.size(F.filter(letters, lambda p: p.rlike(r"^\p{Lu}"))) >= 2
    known = ~name.isin(words) if words else F.lit(True)
    return plausible & capital & known & ~F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(name), t)) if terms else plausible & capital & known


def legacy_initials_compatible(full: Column, legacy: Column) -> Column:
    """Whether a name of initials may be the full one: equal last tokens, and initials before them that begin the given names.

    The caller must require the same department and a single candidate; names are never made from initials.
    """
    f, o = _parts(identity_name(full)), _parts(identity_name(legacy))
    n, m = F.size(f), F.size(o)
    omitted = (F.length(F.element_at(o, 1)) == 1) & (F.slice(o, 2, F.greatest(m - 1, F.lit(0))) == f)
    most = F.least(n, m) - 1
    # the number of equal last tokens, of which the first token of the shorter name is none
    alike = F.zip_with(F.reverse(f), F.reverse(o), lambda a, b: F.coalesce(a == b, F.lit(False)))
    unlike = F.array_position(F.slice(alike, 1, F.greatest(most, F.lit(0))), F.lit(False))
    suffix = F.when(unlike > 0, unlike.cast("int") - 1).otherwise(most)
    given, initials = F.slice(f, 1, F.greatest(n - suffix, F.lit(0))), F.slice(o, 1, F.greatest(m - suffix, F.lit(0)))
    fits = F.forall(F.zip_with(given, initials, lambda a, b: a.isNull() | b.isNull() | (F.substring(a, 1, 1) == b)), lambda ok: ok)
    return (n >= 2) & (m >= 2) & (F.length(F.element_at(f, 1)) >= 2) & (omitted | ((suffix > 0) & F.forall(initials, lambda t: F.length(t) == 1) & fits))


def possible_initial_alias(full: Column, legacy: Column) -> Column:
    """A lead for review alone: the legacy name begins with the initial of the full one and ends alike."""
    f, o = _parts(identity_name(full)), _parts(identity_name(legacy))
    lead = (F.length(F.element_at(o, 1)) == 1) & (F.element_at(o, 1) == F.substring(F.element_at(f, 1), 1, 1))
    return F.coalesce((F.size(f) >= 2) & (F.size(o) >= 2) & lead & (F.element_at(o, -1) == F.element_at(f, -1)), F.lit(False))


def without_credentials(name: Column) -> Column:
    """Without degrees and memberships wherever they stand, and without a title before or a role label."""
    bare = F.regexp_replace(F.regexp_replace(_text(name), CREDENTIALS, ""), "[,​]", " ")
    return F.regexp_replace(squeezed(bare), r"^(?:Dr\.?\s+|[-–—]\s*PI\s+)", "")


def instructors(value: Column, comma_separated: bool = False) -> Column:
    """The distinct names of a timetable cell, in order; placeholders are no names."""
    value = F.regexp_replace(_text(value), r"\([^)]*\)|\([^)]*$", "")
    value = F.regexp_replace(F.regexp_replace(value, r"\b\d{3}:\s*", ""), r"\b(?:Professor|Prof\.|Dr\.)\s+", "")
    parts = F.split(value, r"\n|;|\s+&\s+|\s+/\s+|\s+and\s+" + ("|," if comma_separated else ""))
    found = F.transform(parts, lambda p: F.regexp_replace(squeezed(p), "^[* ,:.]+|[* ,:.]+$", ""))
    return F.array_distinct(F.filter(found, lambda p: (p != "") & ~p.rlike(NO_INSTRUCTOR) & p.rlike(r"^[\w\s.,'’\p{L}\p{M}-]+$")))


def last_name(name: Column) -> Column:
    """The last word, or the one before where that is an initial; a stand-in word for none."""
    parts = F.array_remove(F.transform(F.split(squeezed(name), " "), lambda p: F.regexp_replace(p, r"^[.,()]+|[.,()]+$", "")), "")
    last = F.element_at(parts, -1)
    return F.when(F.size(parts) == 0, F.lit("Research")).when((F.length(last) == 1) & (F.size(parts) > 1), F.element_at(parts, -2)).otherwise(last)
