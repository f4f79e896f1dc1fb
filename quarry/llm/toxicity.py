"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, undoes compatibility forms, replaces homoglyphs of Latin letters and digits that stand for letters
within a word, and leaves the letter runs with one space between them and at both ends. An entry is a whole word or the
beginning of words; exception phrases (a word before or after an entry) cancel the entry's hits inside them. The weights of
the hits are summed, taken as they are and by the number of words, and a logistic function fitted to the labels turns them
into a score.

The lexicon, its exceptions and the logistic function are learned from a sample of labelled rows, at most ``sample_docs``
of each label, chosen by hash of the id: the documented bound. Entries are chosen to cover the toxic documents one after
another, so that words which merely stand in copies of a toxic document are not taken. All rows are scored.

Defined results: null, empty and wordless texts get the score of a text without hits; rows with a null label or id are not
learned from; equal labels of one id count once, as do equal texts of one label; with no toxic label to learn from all scores are 0; texts are read
whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hash_sample, pack, slices
from quarry.plans.shared import shared_table

# Cyrillic and Greek letters that look like Latin ones, and characters that stand for letters in a word.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o",
    "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n",
    "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

#: A Cyrillic or Greek word is folded only if it has a Latin letter too.
_FOLD = str.maketrans(HOMOGLYPHS)
_LETTER = r"[^\W\d_]"
_DIGIT = re.compile(rf"(?:(?<={_LETTER})|(?<={_LETTER}\d))[013457 8](?=[\w@$!])|[0134578@$](?={_LETTER})|(?<={_LETTER})[0134578](?!\w)|(?<={_LETTER})!(?={_LETTER})".replace(" ", ""))
_LATIN = re.compile(r"[a-z]")
_WORDS = re.compile(rf"{_LETTER}+")
#: Lengths of word beginnings that can become entries; least toxic documents an entry adds; entries at most.
PREFIXES, LEAST, MOST = range(4, 11), 4, 2000
#: Times that each toxic document is covered.
COVER = 3
#: Least weight (log odds ratio) of an entry, and candidates compared for it.
LEAST_WEIGHT, CANDIDATES = 2.0, 6000


def folded(text: str | None) -> str:
    """The text's letter runs, folded, with a space before and after each."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    text = _DIGIT.sub(lambda m: SUBSTITUTES[m[0]], text)
    words = _WORDS.findall(text)
    if not text.isascii():
        words = [w if w.isascii() else _folded_word(w) for w in words]
    return f" {' '.join(words)} " if words else " "


def _folded_word(word: str) -> str:
    as_latin = word.translate(_FOLD)
    return as_latin if as_latin != word and (_LATIN.search(word) or as_latin.isascii()) else word


def terms(text: str) -> set[str]:
    """Candidate entries of a folded text: " word " and " beginning"."""
    found = set()
    for w in set(text.split()):
        found.add(f" {w} ")
        found.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
    return found


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    model: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        auto = ahocorasick.Automaton()
        for k in {*self.weights, *self.exceptions}:
            auto.add_word(k, (len(k), self.weights.get(k, 0.0), k in self.exceptions))
        auto.make_automaton()
        return auto


def hits(text: str, auto: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """(start, end, weight) of each word hit in a folded text, outside exceptions; of entries in one word the heaviest counts."""
    if auto is None:
        return []
    best: dict[int, tuple[int, int, float]] = {}
    spared: list[tuple[int, int]] = []
    for at, (size, weight, exception) in auto.iter(text):
        start = at - size + 1
        if exception:
            spared.append((start, at + 1))
        if weight and (start not in best or weight > best[start][2]):
            best[start] = (start, at + 1, weight)
    if spared and best:
        inside = {s for s, e, _ in best.values() for a, b in spared if a <= s and e <= b}
        return [h for s, h in best.items() if s not in inside]
    return list(best.values())


def features(text: str, auto: ahocorasick.Automaton | None) -> tuple[float, float, float, float]:
    """1, whether there is a hit, the logarithm of the weights' sum, and the sum by the root of the number of words."""
    total = sum(h[2] for h in hits(text, auto))
    return (1.0, float(total > 0), float(np.log1p(total)), float(total / np.sqrt(max(1, text.count(" ") - 1))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Newton steps on the penalised log likelihood; the penalty leaves the constant alone."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def choose(counts: dict[str, tuple[int, int]], found: list[list[str]], toxic: int, clean: int) -> dict[str, float]:
    """Entries by greedy cover of the toxic documents, COVER times each (found: the candidates in each), with their weights.

    Of beginnings of one another that stand in nearly as many toxic documents, the longest is taken.
    """
    weight = {t: float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1))) for t, (a, b) in counts.items()}
    holders: dict[str, set[int]] = {}
    for k, own in enumerate(found):
        for t in own:
            holders.setdefault(t, set()).add(k)
    left = np.full(len(found), COVER)
    least = max(LEAST, toxic // 200)
    chosen: dict[str, float] = {}
    while len(chosen) < MOST and holders:
        top = max(holders, key=lambda t: (len(holders[t]) * weight[t], t))
        if len(holders[top]) < least:
            break
        longer = [t for t in holders if t.startswith(top) and len(holders[t]) >= 0.97 * len(holders[top])]
        top = max(longer, key=lambda t: (len(t.strip()), t))
        chosen[top] = weight[top]
        own = holders.pop(top)
        left[list(own)] -= 1
        over = {k for k in own if left[k] <= 0}
        for t in list(holders):
            # what begins like the entry says nothing more about the same documents
            holders[t] -= own if t.startswith(top.rstrip()) or top.startswith(t) else over
            if len(holders[t]) < least:
                del holders[t]
    return chosen


def learn_lexicon(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = 6000) -> Lexicon:
    """learn_from: which rows of docs may be learned from. What reaches the driver is bounded by the sample and by CANDIDATES."""
    marked = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    rows = docs.where(learn_from).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    # the rank is over labels whose document may be learned from
    able = marked.join(rows.select("id").distinct(), "id", "left_semi")
    chosen = shared_table(hash_sample(able, "y", "id", sample_docs))
    # at most 2 sample_docs ids, whatever the input: the texts stay where they are until the sample is picked
    sample = shared_table(rows.where("text is not null").join(F.broadcast(chosen), "id").select("y", "text").distinct())
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic:
        return Lexicon()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for y, t in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found[y].update(terms(folded(t)))
                every = list({*found[0], *found[1]})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(every, pa.string()), *(pa.array([found[y][t] for t in every], pa.int64()) for y in (1, 0))], ["term", "a", "b"]
                )

    counted = sample.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    weight = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (clean + 1))
    best = counted.where((F.col("a") >= LEAST) & (weight >= LEAST_WEIGHT)).orderBy((F.col("a") * weight).desc(), "term").limit(CANDIDATES)
    counts = {r["term"]: (r["a"], r["b"]) for r in best.collect()}
    if not counts:
        return Lexicon()
    candidates = set(counts)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = [sorted(candidates & terms(folded(t))) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], ["own"])

    found = [r["own"] for r in sample.where("y = 1").select("text").mapInArrow(hold, "own array<string>").collect()]
    lexicon = Lexicon(choose(counts, found, toxic, clean))
    lexicon.exceptions = _exceptions(sample, lexicon, toxic, clean)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = lexicon.automaton()
        for batch in batches:
            for part in slices(batch):
                own = [features(folded(t), auto) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(own, pa.list_(pa.float64()))], ["y", "x"])

    seen = sample.mapInArrow(measure, "y int, x array<double>").collect()
    seen = sorted((r["y"], r["x"]) for r in seen)
    lexicon.model = tuple(fit_logistic(np.array([x for _, x in seen]), np.array([y for y, _ in seen], float)).tolist())
    return lexicon


def _exceptions(sample: DataFrame, lexicon: Lexicon, toxic: int, clean: int) -> set[str]:
    """Phrases of an entry's word and a neighbour that stand in clean documents, relatively, at least as often as in toxic ones."""
    if not lexicon.weights:
        return set()

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Lexicon(lexicon.weights).automaton()
        for batch in batches:
            phrases, ys = [], []
            for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text, own = folded(t), set()
                for start, end, _ in hits(text, auto):
                    stop = text.find(" ", max(end - 1, start + 1)) + 1  # the end of the word
                    before = text.rfind(" ", 0, start) if start else -1
                    after = text.find(" ", stop)
                    own |= {text[before:stop]} if before >= 0 else set()
                    own |= {text[start : after + 1]} if after >= 0 else set()
                phrases += sorted(own)
                ys += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(ys, pa.int32())], ["phrase", "y"])

    seen = sample.mapInArrow(around, "phrase string, y int").groupBy("phrase").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    kept = seen.where((F.col("b") >= 3) & (F.col("b") * toxic >= F.col("a") * clean)).orderBy(F.desc("b"), "phrase").limit(MOST)
    return {r["phrase"] for r in kept.collect()}


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Returns _row (the row of docs, without its text unless keep_text), score, n_hits and hits (the folded words hit). A map over rows."""
    rows = pack(docs, _text=text)
    if not keep_text:
        rows = rows.withColumn("_row", F.col("_row").dropFields(text))
    kind = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, model = lexicon.automaton(), np.array(lexicon.model)
        for batch in batches:
            for part in slices(batch):
                texts = [folded(t) for t in part.column("_text").to_pylist()]
                x = np.array([features(t, auto) for t in texts]).reshape(-1, 4)
                score = 1 / (1 + np.exp(-np.clip(x @ model, -30, 30)))
                if auto is None:
                    score[:] = 0.0
                own = [[t[s:e].strip() for s, e, _ in hits(t, auto)] for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_row"), pa.array(score), pa.array([len(h) for h in own], pa.int64()), pa.array(own, pa.list_(pa.string()))],
                    ["_row", "score", "n_hits", "hits"],
                )

    return rows.mapInArrow(run, f"_row {kind}, score double, n_hits long, hits array<string>")
