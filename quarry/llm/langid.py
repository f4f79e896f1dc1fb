"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary (byte strings). The probability of a word is the
sum, over all ways to cut it into pieces, of the product of the pieces' probabilities; a forward pass over its bytes sums
them. A text's score in a language is the sum over its words; the prediction is the best language, and its score the
posterior among the languages at a tempered scale.

Words are runs of letters, lower-cased, with a leading space, as the vocabulary's own pieces begin. Probabilities are
learned by expectation-maximisation over all segmentations of the words of a sample: at most ``sample_docs`` labelled
documents a language, chosen by hash of their id and whole. That bound is the documented parameter; all else covers all rows.

Defined results: null texts and texts without a letter get ``und`` with score 0; rows with a null language are never
learned from; equal scores go to the language first in order; with nothing to learn from, every text is ``und``; a very
long word is scored whole; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import begin, hash_sample, pack, slices
from quarry.plans.shared import shared_table

LETTERS = regex.compile(r"\p{L}+")
#: Longest piece in bytes that is used, EM rounds, smoothing mass of each single byte, and least expected count kept.
MAX_PIECE, ROUNDS, BYTE_FLOOR = 12, 4, 1e-7
#: Words of one forward pass, and entries of a worker's word table.
BLOCK, MAX_WORDS = 4096, 400_000
#: Words whose lattices are held at once while learning.
LEARN_BLOCK = 512
#: Scores are divided by this share of the number of words, to the power 1/2, before the posterior is taken.
TEMPER = 0.5


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, list[bytes]]:
    """Hashes of the pieces, sorted, and the pieces in that order; every single byte is a piece."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    pieces = {p for p in pieces if len(p) <= MAX_PIECE} | {bytes([b]) for b in range(256)}
    hashes = {p: _hash(p) for p in pieces}
    ordered = sorted(pieces, key=hashes.__getitem__)
    keys = np.array([hashes[p] for p in ordered], np.uint64)
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two pieces share a hash")
    return keys, ordered


_MULT = np.uint64(0x9E3779B97F4A7C15)


def _hash(piece: bytes) -> int:
    h = 0
    for b in piece:
        h = (h * 0x9E3779B97F4A7C15 + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _lattice(words: list[bytes], keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(end, length, rows, piece): for each end and piece length, the rows of words in which a piece lies there.

    words are ordered by length, the longest first, so that those still running are the first rows.
    """
    lengths = np.array([len(w) for w in words])
    longest = int(lengths[0])
    grid = np.zeros((longest, len(words)), np.uint64)
    flat = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(words)), lengths)
    grid[np.arange(len(flat)) - np.repeat(starts, lengths), row] = flat + np.uint64(1)
    recent: list[np.ndarray] = []  # hashes of the pieces that begin at each recent start, up to here
    for i in range(longest):
        n = int(np.searchsorted(-lengths, -i, "left"))  # words longer than i
        byte = grid[i, :n]
        recent = [h[:n] * _MULT + byte for h in recent[-(MAX_PIECE - 1) :]] + [byte]
        for back, h in enumerate(reversed(recent), 1):
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            rows = np.flatnonzero(keys[at] == h)
            if len(rows):
                yield i + 1, back, rows, at[rows]


def forward(words: list[bytes], keys: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations. probs: (pieces, languages)."""
    out = np.empty((len(words), probs.shape[1]))
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    k = 0
    while k < len(order):
        size = max(16, min(BLOCK, (1 << 18) // max(1, len(words[order[k]]))))
        some = order[k : k + size]
        k += size
        own = [words[j] for j in some]
        lengths = np.array([len(w) for w in own])
        ring = np.zeros((MAX_PIECE + 1, len(own), probs.shape[1]))
        ring[0] = 1.0
        scale = np.zeros((len(own), probs.shape[1]))
        total = np.zeros_like(scale)

        def close(end: int, ring: np.ndarray = ring, scale: np.ndarray = scale, total: np.ndarray = total, lengths: np.ndarray = lengths) -> None:
            now = ring[end % (MAX_PIECE + 1)]
            done = np.flatnonzero(lengths == end)
            with np.errstate(divide="ignore"):
                total[done] = np.log(now[done]) + scale[done]
            small = np.flatnonzero((now.min(1) < 1e-100) & (lengths > end))
            if len(small):  # rescale each language before it runs below the smallest number
                by = np.where((now[small] < 1e-100) & (now[small] > 0), now[small], 1.0)
                ring[:, small] /= by[None]
                scale[small] += np.log(by)

        last = 0
        for end, back, rows, piece in _lattice(own, keys):
            if end != last:
                if last:
                    close(last)
                ring[end % (MAX_PIECE + 1)] = 0
                last = end
            ring[end % (MAX_PIECE + 1), rows] += ring[(end - back) % (MAX_PIECE + 1), rows] * probs[piece]
        close(last)
        out[some] = total
    return out


def expected(words: list[bytes], counts: np.ndarray, keys: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected count of each piece over all segmentations of the words; probs: (pieces,)."""
    got = np.zeros(len(keys))
    order = sorted(range(len(words)), key=lambda k: -len(words[k]))
    for k in range(0, len(order), LEARN_BLOCK):
        some = order[k : k + LEARN_BLOCK]
        own = [words[j] for j in some]
        lengths = np.array([len(w) for w in own])
        arcs = list(_lattice(own, keys))
        alpha = np.zeros((lengths[0] + 1, len(own)))
        beta = np.zeros_like(alpha)
        alpha[0] = 1.0
        beta[lengths, np.arange(len(own))] = 1.0
        for end, back, rows, piece in arcs:
            alpha[end, rows] += alpha[end - back, rows] * probs[piece]
        for end, back, rows, piece in reversed(arcs):
            beta[end - back, rows] += beta[end, rows] * probs[piece]
        whole = beta[0]
        weight = np.where(whole > 0, counts[some] / np.maximum(whole, 1e-300), 0)
        for end, back, rows, piece in arcs:
            np.add.at(got, piece, alpha[end - back, rows] * probs[piece] * beta[end, rows] * weight[rows])
    return got


def learn(words: list[bytes], counts: np.ndarray, path: str) -> np.ndarray:
    """Piece probabilities of one language from its words. Words over 48 bytes are cut for learning alone, so that no product vanishes."""
    keys, pieces = vocabulary(path)
    cut: dict[bytes, float] = {}
    for w, c in zip(words, counts, strict=True):
        for k in range(0, len(w), 48):
            cut[w[k : k + 48]] = cut.get(w[k : k + 48], 0) + c
    words, counts = list(cut), np.array(list(cut.values()), float)
    single = np.array([len(p) == 1 for p in pieces])
    probs = np.array([0.02 ** max(1, len(p) - 1) for p in pieces])
    probs /= probs.sum()
    for _ in range(ROUNDS):
        got = expected(words, counts, keys, probs)
        probs = got / max(got.sum(), 1e-300)
        probs[single] += BYTE_FLOOR
        probs /= probs.sum()
    return probs


def word_bytes(text: str) -> list[bytes]:
    return [b" " + w.encode() for w in LETTERS.findall(text.lower())]


def learn_languages(docs: DataFrame, path: str, id_col: str, text: str, lang: str, learn_from: Column, sample_docs: int = 600) -> dict[str, np.ndarray]:
    """Piece probabilities by language. learn_from: which rows may be learned from.

    Of each language the documents with the least hashes of their ids are chosen (no task ranks a whole language), where repeated
    rows count once, and only their words are counted. One group a language, of bounded size, is learned in one task; the result is one
    vector a language.
    """
    rows = docs.where(learn_from).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("digest", F.xxhash64("text"))
    chosen = shared_table(hash_sample(rows.select("id", "lang", "digest"), "lang", "id", sample_docs).select("lang", "digest").distinct())
    # at most sample_docs texts a language, whatever the input: the texts stay where they are, and each counts once
    sample = rows.join(F.broadcast(chosen), ["lang", "digest"], "left_semi").groupBy("lang", "digest").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, bytes], int] = {}
            for g, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w in word_bytes(t):
                    found[g, w] = found.get((g, w), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in found], pa.string()), pa.array([w for _, w in found], pa.binary()), pa.array(list(found.values()), pa.int64())],
                ["lang", "word", "n"],
            )

    counts = sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("word")
        probs = learn([bytes(w) for w in group["word"]], group["n"].to_numpy(float), path)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "probs": [probs.astype("<f8").tobytes()]})

    fitted = counts.groupBy("lang").applyInPandas(fit, "lang string, probs binary").collect()
    return {r["lang"]: np.frombuffer(bytes(r["probs"]), "<f8") for r in sorted(fitted, key=lambda r: r["lang"])}


class Scorer:
    """Sums word scores of texts; word scores are kept in a table of bounded size."""

    def __init__(self, languages: list[str], probs: np.ndarray, path: str):
        self.languages, self.probs, self.keys = languages, probs, vocabulary(path)[0]
        self.kept: dict[str, int] = {}
        self.table = np.empty((MAX_WORDS, len(languages)))

    def _rows(self, words: set[str]) -> tuple[dict[str, int], np.ndarray]:
        new = [w for w in words if w not in self.kept]
        if len(self.kept) + len(new) > MAX_WORDS:
            self.kept.clear()
            new = list(words)
        scored = forward([b" " + w.encode() for w in new], self.keys, self.probs) if new else np.empty((0, len(self.languages)))
        if len(new) > MAX_WORDS:
            return {w: k for k, w in enumerate(new)}, scored
        at = len(self.kept)
        self.table[at : at + len(new)] = scored
        self.kept.update(zip(new, range(at, at + len(new)), strict=True))
        return self.kept, self.table

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        found = [LETTERS.findall((t or "").lower()) for t in texts]
        where, table = self._rows(set().union(*found))
        langs, scores = [], []
        for words in found:
            if not words:
                langs.append("und")
                scores.append(0.0)
                continue
            total = table[np.fromiter(map(where.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            langs.append(self.languages[best])
            scores.append(float(1 / np.exp((total - total[best]) * TEMPER / np.sqrt(len(words))).sum()))
        return langs, scores


def identify(
    docs: DataFrame, path: str, learn_from: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
    keep_text: bool = False, sample_docs: int = 600,
) -> DataFrame:
    """Returns _row (the row of docs, without its text unless keep_text), lang_pred and score. Predictions read the text alone."""
    fitted = learn_languages(docs, path, id_col, text, lang, learn_from, sample_docs)
    languages = list(fitted)
    probs = np.stack([fitted[g] for g in languages], 1) if fitted else np.empty((len(vocabulary(path)[0]), 0))
    shared = docs.sparkSession.sparkContext.broadcast(probs)  # pieces x languages
    rows = pack(docs, _text=text)
    if not keep_text:
        rows = rows.withColumn("_row", F.col("_row").dropFields(text))
    kind = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("langid")
        scorer = Scorer(languages, shared.value, path)
        for batch in batches:
            for part in slices(batch, 256):
                pred, score = scorer.predict(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["_row", "lang_pred", "score"])

    return rows.mapInArrow(run, f"_row {kind}, lang_pred string, score double")
