"""Search: compile a query, match, rank, relax, correct, suggest, and count facets without their own filter.

An index is a DataFrame with the padded normal forms haystack, name, area, topics and department beside the record's columns.
A query becomes one column expression, so matching and ranking are one pass over the index.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quarry.functions.text import folded, padded, vocabulary_tokens

# Places of a term in a record and what they weigh, and the other weights of a record.
NAME_START, NAME_WORD, NAME_INSIDE, AREA, TOPIC, DEPARTMENT, HAYSTACK = 18, 14, 8, 7, 6, 5, 2
PER_TERM, PHRASE_IN_NAME, PHRASE, FUZZY = 20, 25, 8, 0.75


def fold(value: str) -> str:
    text = folded(value)
    return " ".join("".join(c if c.isalnum() or c in "@.+-" else " " for c in text).split())


def build_index(records: DataFrame, name: Column, area: Column, topics: Column, department: Column, text: Column) -> DataFrame:
    """The normal forms come out of a generator, which the optimizer neither merges with what follows nor pushes filters through:
    each is computed once a record, however many terms look into it."""
    forms = {"name_text": name, "area_text": area, "topic_text": topics, "department_text": department, "haystack": text}
    return records.select("*", F.inline(F.array(F.struct(*[padded(c).alias(n) for n, c in forms.items()]))))


@dataclass
class Term:
    raw: str
    alternatives: list[str]
    fuzzy: list[str] = field(default_factory=list)


@dataclass
class Query:
    terms: list[Term]
    phrase: str = ""


def compile_query(text: str, synonyms: dict[str, list[str]] | None = None, corrections: dict[str, list[str]] | None = None, segments: dict[str, list[str]] | None = None) -> Query:
    """segments: words of scripts without spaces, with their synonyms; a longer one in a word hides those inside it."""
    synonyms, corrections, segments = synonyms or {}, corrections or {}, segments or {}
    words = fold(text).split()
    terms = []
    for word in words:
        keys = [k for k in segments if k in word]
        keys = [k for k in keys if not any(k != o and k in o for o in keys)]
        if len(keys) > 1:
            terms += [Term(k, [*dict.fromkeys(map(fold, [k, *segments[k]]))]) for k in keys]
        else:
            own = [word, *synonyms.get(word, []), *(s for k in keys for s in segments[k])]
            terms.append(Term(word, [*dict.fromkeys(map(fold, own))], corrections.get(word, [])))
    return Query(terms, " ".join(words) if len(words) > 1 else "")


def has(text: Column, word: str, abbreviations: Sequence[str] = ()) -> Column:
    """Three characters or more anywhere; fewer at the beginning of a word, known abbreviations as whole words."""
    if len(word) > 2 or not word.isascii():
        return F.contains(text, F.lit(word))
    return F.contains(text, F.lit(f" {word} " if word in abbreviations else f" {word}"))


def term_matches(term: Term, abbreviations: Sequence[str] = ()) -> Column:
    found = F.lit(False)
    for a in term.alternatives:
        found = found | has(F.col("haystack"), a, abbreviations)
    for a in term.fuzzy:
        found = found | F.contains(F.col("haystack"), F.lit(a))
    return found


def placement(word: str, abbreviations: Sequence[str] = ()) -> Column:
    name = F.col("name_text")
    out = F.when(F.startswith(name, F.lit(f" {word}")), NAME_START).when(F.contains(name, F.lit(f" {word}")), NAME_WORD)
    if len(word) > 3:
        out = out.when(F.contains(name, F.lit(word)), NAME_INSIDE)
    for column, weight in (("area_text", AREA), ("topic_text", TOPIC), ("department_text", DEPARTMENT), ("haystack", HAYSTACK)):
        out = out.when(has(F.col(column), word, abbreviations), weight)
    return out.otherwise(0)


def score(query: Query, facts: Column, abbreviations: Sequence[str] = ()) -> Column:
    total = facts.cast("double")
    for term in query.terms:
        places = [placement(a, abbreviations).cast("double") for a in term.alternatives]
        places += [placement(a).cast("double") * FUZZY for a in term.fuzzy]
        best = F.greatest(*places) if len(places) > 1 else places[0]
        total = total + F.when(term_matches(term, abbreviations), PER_TERM + F.when(best == 0, 1.0).otherwise(best)).otherwise(0.0)
    if query.phrase:
        total = total + F.when(F.contains(F.col("name_text"), F.lit(query.phrase)), PHRASE_IN_NAME).when(F.contains(F.col("haystack"), F.lit(query.phrase)), PHRASE).otherwise(0)
    return total


def search(index: DataFrame, query: Query, facts: Column, abbreviations: Sequence[str] = (), required: int | None = None) -> DataFrame:
    """Rows that match all terms, or at least ``required``, with matched and score."""
    matched = sum((term_matches(t, abbreviations).cast("int") for t in query.terms), F.lit(0))
    need = len(query.terms) if required is None else required
    return index.withColumn("matched", matched).where(F.col("matched") >= need).withColumn("score", score(query, facts, abbreviations))


def search_relaxed(index: DataFrame, query: Query, facts: Column, abbreviations: Sequence[str] = ()) -> DataFrame:
    """All terms; where no row has all of several terms, half of them. One pass finds the rows of both, an aggregate chooses."""
    half = -(-len(query.terms) // 2)
    rows = search(index, query, facts, abbreviations, min(half, len(query.terms)))
    whole = rows.agg(F.coalesce(F.max("matched"), F.lit(0)).alias("m")).select("m").scalar() >= len(query.terms)
    return rows.where(F.when(whole, F.col("matched") >= len(query.terms)).otherwise(F.lit(True)))


def vocabulary(records: DataFrame, text: Column) -> DataFrame:
    """(token, df): how many records have each token."""
    counted = records.select(F.explode(vocabulary_tokens(text)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return counted.where(F.col("token").rlike(r"^\p{L}{3,}$"))


def _osa(words: pd.Series, term: str) -> pd.Series:
    def one(word: str | None) -> int | None:
        if word is None:
            return None
        two, before = None, list(range(len(word) + 1))
        for i, a in enumerate(term, 1):
            row = [i]
            for j, b in enumerate(word, 1):
                best = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a != b))
                if i > 1 and j > 1 and a == word[j - 2] and b == term[i - 2]:
                    best = min(best, two[j - 2] + 1)
                row.append(best)
            two, before = before, row
        return before[-1]

    return words.map(one)


def osa_distance(word: Column, term: str) -> Column:
    """Optimal string alignment: edits and transpositions of neighbours, each at most once. For the few words that a built-in distance leaves."""
    return F.pandas_udf(lambda words: _osa(words, term), IntegerType())(word)


def corrections(vocab: DataFrame, term: str, most: int = 4) -> DataFrame:
    """(text, df) of up to four corrections of a term that occurs nowhere, not even inside a token: whole words first, then beginnings, by frequency.

    A candidate shares the first or the second letter, within one edit, two from eight letters on; a transposition of neighbours is one
    edit. A transposition is at most two edits of the built-in distance, so that distance leaves few tokens for the exact one.
    """
    term = fold(term)
    nothing = vocab.limit(0).select(F.col("token").alias("text"), "df")
    if not re.fullmatch(r"[^\W\d_]{5,}", term):
        return nothing
    limit = 2 if len(term) >= 8 else 1
    token = F.col("token")
    near = vocab.where((F.substring(token, 1, 1) == term[0]) | (F.substring(token, 2, 1) == term[1]))
    start = F.substring(token, 1, len(term))
    loose = lambda c: F.levenshtein(F.lit(term), c) <= 2 * limit
    few = near.where(loose(token) | loose(start)).select("token", "df", start.alias("start"))
    exact = few.withColumns({"whole": osa_distance(F.col("token"), term), "part": osa_distance(F.col("start"), term)})
    rank = F.when(F.col("whole") <= limit, 2 * F.col("whole")).when((F.length(token) > len(term)) & (F.col("part") <= limit), 2 * limit + 1)
    text = F.when(F.col("whole") <= limit, token).otherwise(F.col("start"))
    ranked = exact.select(text.alias("text"), rank.alias("rank"), "df").where("rank is not null")
    best = ranked.select(F.min("rank")).scalar()
    known = vocab.select(F.coalesce(F.bool_or(F.contains(token, F.lit(term))), F.lit(False))).scalar()
    return ranked.where((F.col("rank") == best) & ~known).groupBy("text").agg(F.sum("df").alias("df")).orderBy(F.desc("df"), "text").limit(most)


def suggestions(entries: DataFrame, typed: str, per_group: dict[str, int], synonyms: dict[str, list[str]] | None = None, segments: dict[str, list[str]] | None = None) -> DataFrame:
    """entries (kind, label, n): the best of each kind: exact 10, beginning 8, a synonym 7, beginning of a word 6, a word of a script without
    spaces 5, inside (from three characters) 4, a word within one edit (from five letters) 3."""
    from pyspark.sql import Window

    q, label = fold(typed), padded(F.col("label"))
    ladder = F.when(F.trim(label) == q, 10).when(F.startswith(label, F.lit(f" {q}")), 8)
    for s in (synonyms or {}).get(q, []):
        ladder = ladder.when(F.contains(label, F.lit(f" {fold(s)}")), 7)
    ladder = ladder.when(F.contains(label, F.lit(f" {q}")), 6)
    for key, words in (segments or {}).items():
        for w in words if key in q else []:
            ladder = ladder.when(F.contains(label, F.lit(fold(w))), 5)
    if len(q) >= 3:
        ladder = ladder.when(F.contains(label, F.lit(q)), 4)
    if re.fullmatch(r"[^\W\d_]{5,}", q):
        ladder = ladder.when(F.exists(F.split(F.trim(label), " "), lambda w: F.levenshtein(F.lit(q), w) <= 1), 3)
    scored = entries.withColumn("rank_score", ladder).where("rank_score is not null")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("rank_score"), F.desc("n"), "label"))
    most = F.lit(0)
    for kind, k in per_group.items():
        most = F.when(F.col("kind") == kind, k).otherwise(most)
    return scored.withColumn("place", place).where(F.col("place") <= most)


def self_excluding_facets(rows: DataFrame, filters: dict[str, Column], key: str) -> DataFrame:
    """(facet, value, n): distinct keys of each value of each filtered column, under all filters but the column's own.

    One pass: each row tells which filters it fails; it counts for a facet if it fails none but that facet's.
    """
    names = list(filters)
    fails = [F.coalesce(~filters[n], F.lit(True)).cast("int") for n in names]
    marked = rows.withColumn("_fails", sum(fails[1:], fails[0])).where("_fails <= 1")
    entries = F.array(*[F.when((F.col("_fails") == 0) | (fails[k] == 1), F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value"))) for k, n in enumerate(names)])
    each = marked.select(F.col(key).alias("_key"), F.explode(F.array_compact(entries)).alias("e"))
    return each.groupBy("e.facet", "e.value").agg(F.count_distinct("_key").alias("n"))
