"""Byte-level BPE by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens by merge gadgets (Berglund, Martens and van der
Merwe, 2024). It begins with one state that has a loop for every byte. The gadget of merge (u, v) with product t looks
at the state q to which arcs labelled u lead. If q has an arc v, then u no longer leads to q but to a new state, which is
q without its arc v, and every state that has an arc u gets an arc t to where v led. All arcs of a label lead to one
state, so a state is kept as its parent q, the label it lost and the merge that made it; whether it has an arc t made
with or after itself is whether it has t's left part, and otherwise whether t is not the lost label and the parent has it.
The automaton has at most one state for each merge and accepts exactly the token sequences that BPE gives.

A pre-split word is encoded by one pass over its bytes. The prefixes of a word have one accepted token sequence each, so
the pass keeps one state a position and looks for the one token that ends there and leaves the state at its start.
Answers to "does state s have arc t" are kept in a table of bounded size. Decoding emits the arcs' labels.

Defined results: a null text is encoded as the empty text, which has no tokens; a text of any length is encoded whole;
repeated rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import begin, pack, slices

# The pre-tokenization pattern of byte-level BPE, and Unicode white space.
SPACES = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
BEFORE_SPACE = regex.compile(rf"[{SPACES}] ")
#: Entries of the arc table and of the word table of one worker; a full table is emptied.
MAX_ARCS, MAX_WORDS = 1 << 20, 600_000
#: Words longer than this are not kept in the word table.
MAX_KEPT_WORD = 64


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself if it prints in Latin-1, else the next free letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Automaton:
    """Compiled merges. arcs: which labels leave a state; target: the state where each label leads."""

    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocabulary
        self.labels = {i: b for b, i in vocabulary.items()}
        size = max(self.labels) + 1
        self.left = [-1] * size  # left part of a product
        self.made = [-1] * size  # merge that made a label; -1: a byte
        self.target = [0] * size
        self.parent, self.lost, self.born = [-1], [-1], [-1]
        self.known = [False] * size  # labels of which an arc exists
        for b in range(256):
            if bytes([b]) in vocabulary:
                self.known[vocabulary[bytes([b])]] = True
        self.table: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        for k, (a, b) in enumerate(merges):
            u, v, t = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if not (self.known[u] and self.known[v]) or self.known[t]:
                continue
            q = self.target[u]
            if not self.has(q, v):
                continue
            self.parent.append(q)
            self.lost.append(v)
            self.born.append(k)
            self.target[t] = self.target[v]
            self.target[u] = len(self.parent) - 1
            self.left[t], self.made[t], self.known[t] = u, k, True
        self.longest = max((len(b) for b, i in vocabulary.items() if self.known[i]), default=1)
        self.table.clear()

    def has(self, state: int, label: int) -> bool:
        """Whether state has an arc label."""
        asked = state << 20 | label
        if (found := self.table.get(asked)) is not None:
            return found
        s, t = state, label
        while s and self.known[t]:
            if self.made[t] >= self.born[s]:
                t = self.left[t]
            elif t == self.lost[s]:
                break
            else:
                s = self.parent[s]
        found = not s and self.known[t]
        if len(self.table) >= MAX_ARCS:
            self.table.clear()
        self.table[asked] = found
        return found

    def encode(self, word: bytes) -> bytes:
        """Ids of a pre-split word, as little-endian unsigned 32-bit integers."""
        n, get, target, arcs, longest = len(word), self.ids.get, self.target, self.table.get, self.longest
        states, start, token = [0], [0], [0]
        for i in range(1, n + 1):
            for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
                t = get(word[j:i])
                if t is not None:
                    ok = arcs(states[j] << 20 | t)
                    if ok or (ok is None and self.has(states[j], t)):
                        states.append(target[t])
                        start.append(j)
                        token.append(t)
                        break
            else:
                raise ValueError(f"no arc for byte {word[i - 1]:#x}")
        out = []
        while n:
            out.append(token[n])
            n = start[n]
        return pack_ids(f"<{len(out)}I", *out[::-1])


class ByteBPE:
    """A byte-level BPE tokenizer file of the tokenizers library, read as data."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        as_bytes = lambda s: b"".join(byte_of[c] for c in s)
        special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        vocabulary = {as_bytes(s): i for s, i in model["vocab"].items() if s not in special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.automaton = Automaton(vocabulary, [(as_bytes(a), as_bytes(b)) for a, b in pairs])
        self.special = special
        self.labels = self.automaton.labels | {i: s.encode() for s, i in special.items()}
        alternatives = "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))
        self.spaced: dict[str, bytes] = {}
        self.split = regex.compile(f"({alternatives})") if special else None

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(pack_ids("<I", self.special[part]))
            elif BEFORE_SPACE.search(part):
                out += map(self._word, PIECES.findall(part))
            else:
                # no white space stands before a space, so each space begins a piece, whatever stands before it
                first, *rest = part.split(" ")
                out.append(self._chunk(first))
                found = list(map(self.spaced.get, rest))
                if None in found:
                    found = [self._spaced(w) if f is None else f for w, f in zip(rest, found, strict=True)]
                out += found
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        kept = self.automaton.words
        ids = kept.get(word)
        if ids is None:
            ids = self.automaton.encode(word.encode())
            if len(word) <= MAX_KEPT_WORD:
                if len(kept) >= MAX_WORDS:
                    kept.clear()
                kept[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self._word, PIECES.findall(chunk)))

    def _spaced(self, chunk: str) -> bytes:
        pieces = PIECES.findall(" " + chunk)
        if len(pieces) == 1:  # kept here, not among the words too
            ids = self.automaton.encode(pieces[0].encode())
        else:
            ids = b"".join(map(self._word, pieces))
        if len(chunk) <= MAX_KEPT_WORD and "\n" not in chunk:
            if len(self.spaced) >= MAX_WORDS:
                self.spaced.clear()
            self.spaced[chunk] = ids
        return ids

    def forget(self) -> None:
        """Empty the word tables."""
        self.spaced.clear()
        self.automaton.words.clear()
        self.automaton.table.clear()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.labels.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    """Compiled once for each worker."""
    return ByteBPE(path)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", as_bytes: bool = False) -> DataFrame:
    """Returns _row (the row of docs without its text, where it has other columns), ids and decoded string.

    path: the tokenizer file, which every executor must have; the workers compile it. ids: array<int>, or with as_bytes
    binary, four bytes an id, the least first. A map over rows: no shuffle.
    """
    rows = pack(docs, _text=text)
    if len(docs.columns) > 1:
        rows = rows.withColumn("_row", F.col("_row").dropFields(text))
    kind = rows.schema["_row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        begin("bpe", bpe.forget)
        for batch in batches:
            for part in slices(batch):
                ids = [bpe.encode(t or "") for t in part.column("_text").to_pylist()]
                flat = np.frombuffer(b"".join(ids), "<u4").astype("i4")
                ends = np.cumsum([0, *(len(i) >> 2 for i in ids)])
                decoded = [bpe.decode(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                column = pa.array(ids, pa.binary()) if as_bytes else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("_row"), column, pa.array(decoded, pa.string())], ["_row", "ids", "decoded"])

    return rows.mapInArrow(run, f"_row {kind}, ids {'binary' if as_bytes else 'array<int>'}, decoded string")
