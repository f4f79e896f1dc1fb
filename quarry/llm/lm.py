"""LM scoring by online logistic context mixing.

A text is its words (A-Z lower-cased) and an end. Each word is coded by its class, then within the class. The SINGLES most
frequent words are classes of their own, the others share one by their last two bytes. The class is coded by binary decisions
along a prefix code. Within its class, one of the HEAVY most frequent words is found by binary decisions down a tree of the class's words; any
other word is an escape in this tree, and the rest of it is spelled byte by byte from its end, along prefix codes of bytes by the byte before, closed by a gap. Every decision
is predicted by several models, one for each hashed context: for classes, and for words together with the class, the word before (its class where it is not frequent
itself), the last of the LANDMARKS most frequent words before it, which tell language and subject, and a hash of the last two of these; for spelled words the byte before, the last three and five bytes and the whole word so far, which
frequent words teach once each. A model holds how often a decision went either way in the training texts, smoothed towards
the decision's own frequency, as log odds. A gate (how much the contexts have been seen; for bytes, how many models know the
decision and whether the word's is sure) selects the weights by which the log odds are mixed; further weights that follow the text
multiply these, and an adaptive probability map refines the result. Classes, words and bytes have weights and maps of their own, which move
along the error after each STRIDE decisions. They begin anew after SEGMENT decisions (about two thousand words), so that many
segments of many texts are read side by side; the contexts run on. The sum of the log probabilities is the score; bits per byte are given too.

What is learned: counts of (context, symbol) pairs of all training texts, merged in two rounds of bounded tasks, then broken
up into decisions. Class contexts have rows, whose number grows with the training tokens up to 2^ROW_BITS hashed ones. The decisions of
bytes and those of words are each kept in a hash table with an eight-bit tag an entry, where of decisions that meet the most frequent stays; it
grows with the number of different words, or of tokens, up to 2^MAX_BITS entries, the memory that a worker is given. A word's decision that a
context does not know has the odds that it has in the class.

Base: unigram log probabilities with add-one smoothing. Word counts are aggregated by a shuffle. The HEAVY most frequent
words are broadcast, a table of bounded size; the other words of the texts meet their counts in a join, where no word is
hot any more.

Defined results: null and empty texts are the end alone; rows are kept apart by an id of the scan, so repeated and null ids
are scored one by one; with no training text, N and V are zero and the tables empty; texts are scored whole, in parts of about
PART bytes, and a word of more bytes is spelled in parts; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, word_bytes
from quarry.plans.shared import shared_table

#: Words in the trees of their classes, words that are a class, suffixes that are a class, words that are a context of their own, words that tell
#: language and subject.
HEAVY, SINGLES, SUFFIXES, PREVIOUS, LANDMARKS = 400_000, 160, 80, 4096, 256
#: Bytes of context in a spelled word; 0 stands for the word so far (WORD_BYTES bytes of it).
ORDERS, WORD_BYTES = (3, 5, 0), 16
#: Rows of hashed class contexts and entries of the table of bytes: two to these powers at most. Places that a table is built in, likewise.
ROW_BITS, LEAST_BITS, MAX_BITS, PLACE_BITS, WORD_PLACE_BITS = 12, 12, 24, 6, 9
#: Strength of the smoothing, for classes, for bytes and for words.
STRENGTH = (20.0, 0.6, 8.0)
#: Decisions of a segment, of those read side by side, and of a step; bytes of a part of a text, symbols whose decisions are made together.
SEGMENT, TOGETHER, STRIDE, PART, BLOCK = 16_384, 6_000_000, 8, 1 << 20, 2048
#: Weights at the beginning of a segment. Classes: a row for each confidence of the word before (seen less than SEEN[0], SEEN[1] times, more)
#: times that of the hashed pair; bytes: a row for each number of known contexts, and one for a sure word so far (log odds of SURE or more).
SEEN = (100, 3000)
CLASS_GATES = ((0.1, 0.8, 0.1), (0.1, 0.6, 0.3), (0.1, 0.3, 0.6), (0.3, 0.6, 0.1), (0.3, 0.4, 0.3), (0.3, 0.2, 0.5), (0.4, 0.5, 0.1), (0.4, 0.3, 0.3), (0.4, 0.1, 0.5))
BYTE_GATES = ((1.0, 0.0, 0.0, 0.0), (0.3, 0.8, 0.4, 0.4), (0.1, 0.4, 0.5, 0.3), (0.0, 0.25, 0.45, 0.4), (0.0, 0.1, 0.25, 0.75))
SURE = 3.0
#: Words: a row for each number of known contexts.
WORD_GATES = ((1.0, 0.0, 0.0, 0.0), (0.4, 0.2, 0.2, 0.2), (0.2, 0.2, 0.3, 0.3), (0.0, 0.2, 0.4, 0.4))
RATE, MAP_RATE = 0.004, 0.02
STEP = 16.0  # log odds are kept in sixteenths
END = b"\n"
#: What END is in joined words (no byte of UTF-8 and no white space); bytes of a word that are compared as numbers; bits of a word's number.
MARK, WIDE, NUMBER_BITS = b"\xff", 15, 20
LEAF_BITS, WORD_LEAF_BITS, CELLS, MERGE, HELD = 18, 20, 33, 16, 6_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_D, _E = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return (x ^ (x >> np.uint64(29))) * _C


def code_lengths(weights: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code; weights far below the sum are raised, which keeps lengths under 31."""
    least = max(1, int(weights.sum()) >> 20)
    heap = [(max(least, int(w)), k) for k, w in enumerate(weights.tolist())]
    heapq.heapify(heap)
    parent, new = np.zeros(2 * len(heap), np.int64), len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = new
        heapq.heappush(heap, (a[0] + b[0], new))
        new += 1
    depth = np.zeros(new, np.uint8)
    for k in range(new - 2, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[: len(weights)]


class Packed:
    """Pickled with its large arrays compressed, since a broadcast lies on several disks."""

    def __getstate__(self) -> dict:
        large = lambda v: isinstance(v, np.ndarray) and v.nbytes > 1 << 16
        return {k: (v.dtype.str, v.shape, zstandard.ZstdCompressor(level=1).compress(v.tobytes())) if large(v) else v for k, v in self.__dict__.items()}

    def __setstate__(self, state: dict) -> None:
        for k, v in state.items():
            packed = isinstance(v, tuple) and len(v) == 3 and isinstance(v[2], bytes)
            self.__dict__[k] = np.frombuffer(zstandard.decompress(v[2]), v[0]).reshape(v[1]) if packed else v


class Code(Packed):
    """A canonical prefix code, or one for each row of weights. Leaves are in order of their codes; order[leaf] is the symbol."""

    def __init__(self, weights: np.ndarray):
        rows = np.atleast_2d(weights)
        self.order, self.lengths, self.codes = (np.empty(rows.size, t) for t in (np.int64, np.int64, np.uint64))
        for r, own in enumerate(rows):
            lengths = code_lengths(own)
            order = np.lexsort((np.arange(len(own)), lengths))
            at = r * len(own)
            self.order[at : at + len(own)] = order + at
            self.lengths[at : at + len(own)] = lengths[order]
            value, before = 0, int(lengths[order[0]]) if len(own) else 0
            for k, n in enumerate(lengths[order].tolist()):
                value <<= n - before
                self.codes[at + k] = value << (32 - n)  # aligned to the left of 32 bits
                value, before = value + 1, n
        self.where = np.empty(rows.size, np.int64)
        self.where[self.order] = np.arange(rows.size)  # leaf of each symbol
        every = np.repeat(np.arange(rows.size), self.lengths)
        self.first = np.cumsum(self.lengths) - self.lengths
        depth = (np.arange(len(every)) - self.first[every]).astype(np.uint64)
        path = self.codes[every]
        row = (every // max(1, rows.shape[1])).astype(np.uint64)
        self.nodes = (path >> (np.uint64(32) - depth)) | (np.uint64(1) << depth)
        self.bits = ((path >> (np.uint64(31) - depth)) & np.uint64(1)).astype(np.int8)
        self.prior = np.full(len(every), 0.5, np.float32)  # of a one, by leaf and depth
        leaf = np.arange(rows.size)
        for depth, at, group, zero, one, _ in self.levels((leaf // max(1, rows.shape[1])).astype(np.uint64), leaf, rows.ravel()[self.order].astype(np.float64)):
            self.prior[self.first[at] + depth] = ((one + 0.05) / (zero + one + 0.1))[group]
        self.odds = quantised(self.prior)
        self.nodes += row << np.uint64(32)

    def levels(self, context: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By depth: rows that reach it, their group (context and node), and each group's counts of zeros and ones and first row.

        Rows are sorted by context and leaf; a context's leaves are of one row of weights.
        """
        for depth in range(int(self.lengths.max()) if len(self.lengths) else 0):
            at = np.flatnonzero(self.lengths[leaf] > depth)
            if not len(at):
                return
            code, c = self.codes[leaf[at]], context[at]
            node = code >> np.uint64(32 - depth)
            new = np.concatenate([[True], (node[1:] != node[:-1]) | (c[1:] != c[:-1])])
            start = np.flatnonzero(new)
            bit = (code >> np.uint64(31 - depth)) & np.uint64(1)
            both, one = np.add.reduceat(n[at], start), np.add.reduceat(n[at] * bit, start)
            yield depth, at, np.cumsum(new) - 1, both - one, one, at[start]


    def decisions(self, context: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """By depth: context, node, prior of a one, and counts of zeros and ones of each decision. Rows as for levels."""
        for depth, _, _, zero, one, first in self.levels(context, leaf, n):
            at = self.first[leaf[first]] + depth
            yield context[first], self.nodes[at], self.prior[at], zero, one


class Tree(Packed):
    """Binary trees over the words of each class, halved by weight. A node is the first leaf of its right half, 0 is none."""

    def __init__(self, owner: np.ndarray, weight: np.ndarray, classes: int):
        order = np.lexsort((-weight, owner))
        self.leaf = np.empty(len(order), np.int32)  # of each item
        self.leaf[order] = np.arange(len(order))
        sums = np.concatenate([[0], np.cumsum(weight[order])]).astype(np.int64).tolist()
        ends = np.searchsorted(owner[order], np.arange(classes + 1)).tolist()
        left, right, root, depth = [0] * len(order), [0] * len(order), [0] * classes, [0] * len(order)
        prior = [0.5] * len(order)
        for k in range(classes):
            waiting = [(ends[k], ends[k + 1], 0, root, k)] if ends[k + 1] > ends[k] else []
            while waiting:
                a, b, deep, into, at = waiting.pop()
                if b - a == 1:
                    depth[a] = deep
                    continue
                half = (sums[a] + sums[b]) / 2
                m = min(max(bisect(sums, half, a, b), a + 1), b - 1)
                if m - 1 > a and half - sums[m - 1] < sums[m] - half:
                    m -= 1
                into[at] = m
                prior[m] = (sums[b] - sums[m] + 0.05) / (sums[b] - sums[a] + 0.1)
                waiting += [(a, m, deep + 1, left, m), (m, b, deep + 1, right, m)]
        self.below = np.array([left, right], np.int32)
        self.root, self.depth = np.array(root, np.int32), np.array(depth, np.int32)
        self.start = self.root[owner[order]]  # the root above each leaf
        self.prior = np.array(prior, np.float32)
        self.odds = quantised(self.prior)

    def path(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes and bits of the decisions to leaves, and the number of each leaf's."""
        size = self.depth[leaf]
        first = np.cumsum(size) - size
        node, bit = np.empty(int(size.sum()), np.int32), np.empty(int(size.sum()), np.int8)
        at = np.flatnonzero(size)
        leaf, first, now = leaf[at], first[at], self.start[leaf[at]]
        while len(now):
            one = leaf >= now
            node[first], bit[first] = now, one
            now = self.below[one.view(np.int8), now]
            going = np.flatnonzero(now)
            leaf, first, now = leaf[going], first[going] + 1, now[going]
        return node, bit, size

    def decisions(self, context: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """As of a code."""
        now = self.start[leaf]
        while True:
            at = np.flatnonzero(now)
            if not len(at):
                return
            context, leaf, n, now = context[at], leaf[at], n[at], now[at]
            start = np.flatnonzero(np.concatenate([[True], (now[1:] != now[:-1]) | (context[1:] != context[:-1])]))
            bit = leaf >= now
            both, one = np.add.reduceat(n, start), np.add.reduceat(n * bit, start)
            yield context[start], now[start].astype(np.uint64), self.prior[now[start]], both - one, one
            now = self.below[bit.view(np.int8), now]


def quantised(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log(p / (1 - p)) * STEP), -127, 127).astype(np.int8)


def short(context: np.ndarray) -> np.ndarray:
    """Contexts of 46 bits folded to 32."""
    return (context ^ context >> np.uint64(23)).astype(np.uint32)


def scattered(node: np.ndarray) -> np.ndarray:
    """Nodes as they are hashed, 32 bits."""
    return (node.astype(np.uint64) * _A >> np.uint64(32)).astype(np.uint32)


def slots(context: np.ndarray, node: np.ndarray, bits: int, places: int = PLACE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Table entry and tag of a decision. A context's decisions lie in one of the table's places."""
    h = hashed(short(context), scattered(node))
    inner = bits - places
    return (context >> np.uint64(46 - places) << np.uint64(inner)) + (h >> np.uint32(32 - inner)), (h >> np.uint32(24 - inner)).astype(np.uint8).astype(np.uint16)


def hashed(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Numbers of 32 bits alone, which are multiplied several at once; in place of the context."""
    context ^= node
    context *= _D
    context ^= context >> np.uint32(15)
    context *= _E
    context ^= context >> np.uint32(16)
    context *= _D
    return context


@dataclass
class Cut:
    """The words of joined parts by their places. tokens: of each part; longer words may be in pieces, and whole in long with their part."""

    data: bytes
    start: np.ndarray
    size: np.ndarray
    count: np.ndarray
    tokens: np.ndarray
    piece: np.ndarray
    long: list[tuple[int, bytes]]

    def words(self, at: np.ndarray) -> list[bytes]:
        start = self.start[at]
        return [self.data[a:b] for a, b in zip(start.tolist(), (start + self.size[at]).tolist())]


def cut(parts: list[bytes], most: int = 0) -> Cut:
    """most: bytes of a piece, if words are to be in pieces."""
    data = b" ".join([b"", *parts, bytes(32)])  # words are read up to 24 bytes on
    own = np.frombuffer(data, np.uint8)[:-32]
    space = own - np.uint8(9) < 5
    space |= own == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    count = tokens = np.diff(np.searchsorted(start, ends), prepend=0)
    piece, long = np.zeros(len(start), bool), []
    if most and len(size) and size.max() > most:
        part, n = np.repeat(np.arange(len(parts)), count), -(-size // most)
        long = [(int(part[k]), data[start[k] : start[k] + size[k]]) for k in np.flatnonzero(n > 1)]
        count = np.bincount(part, n, len(parts)).astype(np.int64)
        before = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * most
        start, size, piece = np.repeat(start, n) + before, np.minimum(np.repeat(size, n) - before, most), np.repeat(n > 1, n)
    return Cut(data, start, size, count, tokens, piece, long)


class Lexicon(Packed):
    """Numbers of words, found side by side. Words of up to WIDE bytes are in a hash table with linear probing, whose entries hold the
    top of a hash and the number; what is found is compared whole. Longer words, and those whose hash another has, are in a dictionary."""

    def __init__(self, names: list[bytes]):
        found = cut([b" ".join([MARK if w == END else w for w in names])])
        self.keys, h = self.keyed(found)
        bits = max(4, (2 * len(names)).bit_length())
        self.table = np.full(1 << bits, self.empty, np.uint64)
        own = np.flatnonzero(found.size <= WIDE)
        own = np.sort(own[np.unique(h[own] >> self.low, return_index=True)[1]])  # the more frequent first
        apart = np.ones(len(names), bool)
        apart[own] = False
        self.others = {names[k]: k for k in np.flatnonzero(apart).tolist()}
        slot = (h[own] & np.uint64(len(self.table) - 1)).astype(np.int64)
        while len(own):
            free = np.flatnonzero(self.table[slot] == self.empty)
            into, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.table[into] = h[own[put]] >> self.low << self.low | own[put].astype(np.uint64)
            left = np.ones(len(own), bool)
            left[put] = False
            own, slot = own[left], slot[left] + 1 & len(self.table) - 1

    low, empty = np.uint64(NUMBER_BITS), np.uint64((1 << NUMBER_BITS) - 1)
    kept = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    @classmethod
    def keyed(cls, words: Cut) -> tuple[np.ndarray, np.ndarray]:
        """Words as pairs of numbers, of their first WIDE bytes and their size, and their hashes."""
        every, at = np.frombuffer(words.data, "<u8", len(words.data) // 8), words.start >> 3
        right = ((words.start & 7) << 3).view(np.uint64)
        left = np.uint64(64) - right  # a shift by 64 gives zero
        one, two, three = (every.take(at + k) for k in range(3))
        keys = np.empty((len(at), 2), np.uint64)
        head, tail = one >> right | two << left, two >> right | three << left
        keys[:, 0] = head & cls.kept.take(words.size, mode="clip")
        keys[:, 1] = tail & cls.kept.take(np.clip(words.size - 8, 0, 7)) | np.minimum(words.size, WIDE + 1).astype(np.uint64) << np.uint64(56)
        return keys, mixed(keys[:, 0] ^ keys[:, 1] * _A)

    def find(self, words: Cut) -> np.ndarray:
        """The number of each word, or -1."""
        keys, h = self.keyed(words)
        out = np.full(len(h), -1, np.int64)
        at, slot = np.arange(len(h)), (h & np.uint64(len(self.table) - 1)).view(np.int64)
        h >>= self.low
        h <<= self.low
        while len(at):
            entry = self.table.take(slot, mode="clip")
            number = entry ^ h
            hit = number < self.empty
            out[at[hit]] = number[hit]
            going = np.flatnonzero(~hit & (entry != self.empty))
            at, h, slot = at[going], h[going], slot[going] + 1 & len(self.table) - 1
        own = self.keys.take(out, axis=0, mode="wrap")
        own ^= keys
        wrong = np.flatnonzero((out >= 0) & ((own[:, 0] | own[:, 1]) != 0) | (words.size > WIDE))
        out[wrong] = [self.others.get(w, -1) for w in words.words(wrong)]
        return out


class Words(Packed):
    """Classes, codes and contexts. counts: of the heavy words; suffixes: (tokens, words seen once) of all words by their last two bytes."""

    def __init__(self, counts: dict[bytes, int], suffixes: dict[bytes, tuple[int, int]], tokens: int):
        names = sorted({*counts, END}, key=lambda w: (w != END, -counts.get(w, 0), w))  # the end, then by frequency
        own = np.array([counts.get(w, 0) for w in names], np.int64)
        self.word = {w: k for k, w in enumerate(names)}
        self.lexicon = Lexicon(names)
        self.log = np.log10(own + 1.0)
        left = {x: n for x, (n, _) in suffixes.items()}
        for w, n in counts.items():
            left[w[-2:]] = left.get(w[-2:], n) - n
        rare = {x: max(0, n) + suffixes.get(x, (0, 0))[1] for x, n in left.items()}
        mass = Counter(rare)
        for w, n in zip(names[SINGLES:], own[SINGLES:].tolist()):
            mass[w[-2:]] += n
        self.suffix = {x: SINGLES + k for k, (x, _) in enumerate(sorted(mass.items(), key=lambda m: (-m[1], m[0]))[:SUFFIXES])}
        self.classes = SINGLES + SUFFIXES + 16
        self.of = np.array([k if k < SINGLES else self.class_of(w) for k, w in enumerate(names)], np.int64)
        escaped = np.zeros(self.classes)
        for x, n in rare.items():
            escaped[self.class_of(x)] += n
        escaped[SINGLES:] = np.maximum(escaped[SINGLES:], 1)  # words that are still to come
        whole = escaped + np.bincount(self.of, own, self.classes)
        self.share = np.append(np.log10(np.maximum(own, 0.5) / np.maximum(whole[self.of], 1)), 0.0)
        self.share[:SINGLES] = 0.0
        self.escape = np.log10(np.maximum(escaped, 1) / np.maximum(whole, 1))
        self.code = Code(np.maximum(whole, 1).astype(np.int64))
        self.leaf = np.empty(self.classes, np.int64)
        self.leaf[self.code.order] = np.arange(self.classes)
        # words that are no class of their own, then the escape of each class
        owner = np.concatenate([self.of[SINGLES:], np.arange(SINGLES, self.classes)])
        self.tree = Tree(owner, np.concatenate([own[SINGLES:], escaped[SINGLES:].astype(np.int64)]), self.classes)
        self.before = np.where(np.arange(len(names)) < PREVIOUS, np.arange(len(names)), PREVIOUS + self.of)
        self.landmark = np.where(np.arange(len(names)) < LANDMARKS, np.arange(len(names)), -1)
        self.landmark[0] = -1
        self.rows = 1 << max(4, min(ROW_BITS, int(np.log2(max(2, tokens))) - 8))
        self.firsts = np.cumsum([0, PREVIOUS + self.classes + 1, LANDMARKS + 1, self.rows])  # rows of each class context
        pairs = np.ones((256, 256))
        pairs[:, 32] += 1
        for w in names[1:]:
            b = np.frombuffer(b" " + w[::-1] + b" ", np.uint8)
            np.add.at(pairs, (b[:-1], b[1:]), 16)
        self.bytes = Code(pairs.astype(np.int64))
        self.below = []  # by depth: nodes, and the leaves below each, from and to
        for depth in range(int(self.code.lengths.max())):
            at = np.flatnonzero(self.code.lengths > depth)
            node = self.code.nodes[self.code.first[at] + depth]
            own, start = np.unique(node, return_index=True)
            self.below.append((own, np.stack([at[start], at[np.append(start[1:], len(at)) - 1] + 1], 1)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in super().__getstate__().items() if k != "word"}  # tasks look words up side by side

    def class_of(self, word: bytes) -> int:
        found = self.suffix.get(word[-2:])
        return SINGLES + SUFFIXES + (word[-1] >> 4 if word else 0) if found is None else found


def word_symbols(code: Words, s: Symbols) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words lie in a tree, their leaves, and their contexts (n, 3), of 46 bits of which the last two are zero."""
    at = np.flatnonzero(s.kind >= SINGLES)
    word, kind = s.word[at], s.kind[at]
    item = np.where(word >= 0, word - SINGLES, len(code.tree.leaf) - code.classes + kind)
    rows = s.rows[at] * code.classes + kind[:, None]
    return at, code.tree.leaf[item], mixed(rows.astype(np.uint64) + _A) >> np.uint64(WORD_LEAF_BITS) << np.uint64(WORD_LEAF_BITS - LEAF_BITS)


NOTHING = (-1, LANDMARKS, LANDMARKS)  # contexts at the beginning of a text: no word before, no landmarks


@dataclass
class Symbols:
    """The words of parts of texts. word: number of a heavy word, or -1; rows: of the class contexts."""

    word: np.ndarray
    kind: np.ndarray
    rows: np.ndarray
    rare: list[bytes]
    after: tuple[int, int, int]


def symbols(code: Words, parts: Cut | list[list[bytes]], states: list[tuple[int, int, int]]) -> Symbols:
    """states: before each part; a part's first words see what came before in their text alone."""
    words = parts if isinstance(parts, Cut) else cut([b" ".join([MARK if w == END else w for w in p]) for p in parts])
    sizes = words.count
    word = code.lexicon.find(words)
    word[words.piece] = -1  # the whole word is what was counted
    unknown = np.flatnonzero(word < 0)
    rare = words.words(unknown)
    kind, before, mark = code.of[word], code.before[word], code.landmark[word]
    if rare:
        kind[unknown] = [code.class_of(w) for w in rare]
        before[unknown] = PREVIOUS + kind[unknown]
        mark[unknown] = -1
    state = np.array(states, np.int64)
    filled = np.flatnonzero(sizes)
    begin = (np.cumsum(sizes) - sizes)[filled]
    shifted = np.empty(len(word), np.int64)
    shifted[1:] = before[:-1]
    shifted[begin] = np.where(state[filled, 0] < 0, PREVIOUS + code.classes, state[filled, 0])
    is_mark = mark >= 0
    so_far = np.cumsum(is_mark) - is_mark  # landmarks before each word
    own = so_far - np.repeat(so_far[begin], sizes[filled])  # within the part
    seen = np.concatenate([[0, 0], mark[is_mark]])  # two ahead, so that no index is negative
    part = np.repeat(np.arange(len(sizes)), sizes)
    last = np.where(own >= 1, seen[so_far + 1], state[part, 1])
    other = np.where(own >= 2, seen[so_far], np.where(own == 1, state[part, 1], state[part, 2]))
    pair = mixed((last * 1000 + other + 1).astype(np.uint64)) >> np.uint64(20)
    rows = np.stack([shifted, code.firsts[1] + last, code.firsts[2] + (pair % np.uint64(code.rows)).astype(np.int64)], 1)
    after = states[-1] if states else NOTHING
    if len(sizes) and sizes[-1]:
        after = (int(before[-1]), *((int(mark[-1]), int(last[-1])) if is_mark[-1] else (int(last[-1]), int(other[-1]))))
    return Symbols(word, kind, rows, rare, after)


def byte_contexts(code: Words, words: list[bytes], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf and contexts (n, 3) of the bytes of spelled words, from the last on, a gap after each; and their number by word.

    kinds: the words' classes. A class that is a suffix tells the last two bytes.
    """
    lead = b" " * WORD_BYTES
    data = np.frombuffer(b"".join([lead + w[::-1] + b" " for w in words]) or lead, np.uint8)
    told = np.where((kinds >= SINGLES) & (kinds < SINGLES + SUFFIXES), 2, 0)
    length = np.fromiter(map(len, words), np.int64, len(words))
    told = np.minimum(told, length)
    sizes = length + 1 - told
    total = int(sizes.sum())
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes - told, sizes)  # in the word
    begin = np.cumsum(length + 1 + WORD_BYTES) - length - 1
    here = place + np.repeat(begin, sizes)
    kind = np.repeat(kinds, sizes).astype(np.uint64) + np.uint64(1)
    out = np.empty((total, len(ORDERS)), np.uint64)
    before = [data[here - k].astype(np.uint64) + np.uint64(1) for k in range(1, WORD_BYTES + 1)]
    for k, order in enumerate(ORDERS):
        # a context that reaches the word's beginning has the class there
        h = (np.where(place < order, kind, np.uint64(0)) if order else kind) * _B + np.uint64(k + 1)
        for back, byte in enumerate(before[: order or WORD_BYTES]):
            inside = place > back
            if not inside.any():
                break
            h = np.where(inside, h * _A + byte, h)
        out[:, k] = mixed(h) >> np.uint64(18)
    return code.bytes.where[data[here - 1].astype(np.int64) << 8 | data[here]], out, sizes


@dataclass
class Model(Packed):
    words: Words
    rows: np.ndarray  # int8: log odds of each row of class contexts, by class and depth
    seen: np.ndarray  # uint8: confidence of each row
    table: np.ndarray  # uint16: tag and log odds of decisions of bytes
    tokens: int = 0
    types: int = 0
    inner: np.ndarray | None = None  # uint16: as table, of decisions of words; without it words have their share of the class

    @cached_property
    def weighted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weighted log odds of classes, words and bytes, by model, gate and unweighted ones (as unsigned bytes)."""
        every = np.arange(256).astype(np.uint8).view(np.int8).astype(np.float32)
        all_of = lambda gates: np.clip(np.rint(np.array(gates, np.float32).T[:, :, None] * every), -127, 127).astype(np.int8)
        return tuple(all_of(g).reshape(len(g[0]), -1) for g in (CLASS_GATES, WORD_GATES, BYTE_GATES))

    def classes(self, s: Symbols) -> tuple[np.ndarray, np.ndarray]:
        """A row for each decision of the classes: weighted log odds by model, and the bit; and the number of each word's."""
        code = self.words.code
        leaf = self.words.leaf[s.kind]
        size, width = code.lengths[leaf], len(code.odds)
        x = np.empty((4, int(size.sum())), np.int8)
        gates = (3 * self.seen[s.rows[:, 0]] + self.seen[s.rows[:, 2]]).astype(np.int16) << 8
        firsts = (s.rows * width).T.astype(np.int32)
        done = 0
        for a in range(0, len(leaf), BLOCK):
            n = size[a : a + BLOCK]
            total = int(n.sum())
            path = (np.repeat(code.first[leaf[a : a + BLOCK]] - (np.cumsum(n) - n), n) + np.arange(total)).astype(np.int32)
            gate = np.repeat(gates[a : a + BLOCK], n)
            rows = x[:, done : done + total]
            for k, own in enumerate(self.weighted[0]):
                at = np.repeat(firsts[k, a : a + BLOCK], n)
                at += path
                odds = self.rows.take(at, mode="clip")
                rows[k] = own.take(gate | odds.view(np.uint8), mode="clip")
            rows[3] = code.bits.take(path, mode="clip")
            done += total
        return x.T, size

    def inside(self, leaf: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A row for each decision within the classes: weighted log odds by model, and the bit; and the number of each word's."""
        tree = self.words.tree
        size = tree.depth[leaf]
        x = np.empty((5, int(size.sum())), np.int8)
        there = np.zeros(len(tree.leaf), bool)
        there[leaf] = True
        once = np.flatnonzero(there)  # words occur many times
        nodes, bits, depth = tree.path(once)
        firsts = np.empty(len(there), np.int64)
        firsts[once] = np.cumsum(depth) - depth
        done = 0
        for a in range(0, len(leaf), BLOCK):
            n = size[a : a + BLOCK]
            path = np.repeat(firsts[leaf[a : a + BLOCK]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            node = nodes.take(path, mode="clip")
            rows = x[:, done : done + len(node)]
            rows[0], rows[4] = tree.odds.take(node, mode="clip"), bits.take(path, mode="clip")
            gate = known_odds(self.inner, WORD_PLACE_BITS, contexts[a : a + BLOCK], n, scattered(node), rows[1:4], rows[0])
            for k, own in enumerate(self.weighted[1]):
                rows[k] = own.take(gate | rows[k].view(np.uint8), mode="clip")
            done += len(node)
        return x.T, size

    def spelled(self, leaf: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """A row for each decision of the bytes: weighted log odds by model, and the bit."""
        code = self.words.bytes
        size = code.lengths[leaf]
        x = np.empty((5, int(size.sum())), np.int8)
        done = 0
        for a in range(0, len(leaf), BLOCK):
            n = size[a : a + BLOCK]
            total = int(n.sum())
            path = np.repeat(code.first[leaf[a : a + BLOCK]] - (np.cumsum(n) - n), n) + np.arange(total)
            rows = x[:, done : done + total]
            rows[0], rows[4] = code.odds.take(path, mode="clip"), code.bits.take(path, mode="clip")
            gate = known_odds(self.table, PLACE_BITS, contexts[a : a + BLOCK], n, scattered(code.nodes.take(path, mode="clip")), rows[1:4], np.int8(0))
            gate[np.abs(rows[3]) >= SURE * STEP] = 4 << 8
            for k, own in enumerate(self.weighted[2]):
                rows[k] = own.take(gate | rows[k].view(np.uint8), mode="clip")
            done += total
        return x.T


def known_odds(table: np.ndarray, places: int, contexts: np.ndarray, n: np.ndarray, node: np.ndarray, odds: np.ndarray, unknown: np.ndarray) -> np.ndarray:
    """Fill in what a table says of decisions in each context, as slots has them; 256 times the number of contexts that know each. node: scattered."""
    inner = len(table).bit_length() - 1 - places
    place, own = (contexts >> np.uint64(46 - places) << np.uint64(inner)).astype(np.uint32), short(contexts)
    count = np.zeros(len(node), np.int16)
    for k in range(odds.shape[0]):
        h = hashed(np.repeat(own[:, k], n), node)
        slot = np.repeat(place[:, k], n)
        slot += h >> np.uint32(32 - inner)
        entry = table.take(slot, mode="clip")
        h >>= np.uint32(24 - inner)
        low = entry.astype(np.uint8)
        entry >>= np.uint16(8)
        known = entry.astype(np.uint8) == h.astype(np.uint8)
        known &= low != 0
        count += known
        low ^= np.uint8(128)
        odds[k] = np.where(known, low.view(np.int8), unknown)
    count <<= 8
    return count


def pieces(text: str | None) -> Iterator[tuple[bytes, bool]]:
    """A text in parts of about PART bytes, and whether it ends there, which MARK tells."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at = 0
    while len(data) - at > PART:
        stop = min((k for k in (data.find(s, at + PART) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if k >= 0), default=len(data))
        yield data[at:stop], False
        at = stop
    yield data[at:] + b" " + MARK, True


def mix(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log probability of each segment of x, one segment's decisions after another's; all are read side by side.

    Odds are turned to those of the decision as it went, so that an error is what is missing to one. The segments are laid out in blocks
    of STRIDE decisions, by step, so that a step takes one block of each; a step is a run of memory for each model.
    """
    count, width = len(sizes), x.shape[1] - 1
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order].tolist()
    sizes = sizes[order]  # the longest first
    steps = np.arange(0, int(sizes[0]) if count else 0, STRIDE)
    active = np.searchsorted(-sizes, -steps, "left")
    whole = np.searchsorted(-sizes, -steps - STRIDE, "right")  # segments that fill the step
    blocks = -(-sizes // STRIDE)
    first = np.cumsum(blocks) - blocks
    sign = x.T[width] * np.int8(2)
    sign -= np.int8(1)
    laid = np.empty((width + 1, int(blocks.sum()), STRIDE), np.int8)
    after = np.cumsum(active) - active
    come = np.empty(laid.shape[1], np.int64)  # the block of each place
    come[after[np.arange(laid.shape[1]) - np.repeat(first, blocks)] + np.repeat(np.arange(count), blocks)] = np.arange(laid.shape[1])
    for k in range(width + 1):
        own = np.multiply(x.T[k], sign) if k < width else sign
        padded = np.zeros(laid.shape[1] * STRIDE, np.int8)
        for a, at, n in zip(begin, (first * STRIDE).tolist(), sizes.tolist()):
            padded[at : at + n] = own[a : a + n]
        padded.view(f"u{STRIDE}").take(come, out=laid[k].view(f"u{STRIDE}")[:, 0], mode="clip")
    # the segments are the last axis, so that each operation runs over many neighbours in memory. Log odds are in units of a half, p is (1 + tanh) / 2,
    # and what a decision is given, 0.7 p + 0.3 of the map's, is held as a multiple of 0.35, with the map's part as it is added. It is 2.6e-4 to 1 less 2.6e-4
    weights = np.full((width, count), 0.5 / STEP, np.float32)
    refine = np.tile((0.15 / 0.35 * (2 / (1 + np.exp(-(np.arange(CELLS) - 16) / 2.0)) - 1)).astype(np.float32), count + 1)  # of a one, less that of a zero
    cell = np.arange(count, dtype=np.int64) * CELLS + 16
    out, product, since = sizes * np.log(0.35), np.ones(count), count
    most, four, middle, stay, rest, rate = (np.float32(v) for v in (3.95, 4, 0.5 / 0.35, 1 - MAP_RATE, MAP_RATE * 0.15 / 0.35, RATE * (0.5 / STEP) ** 2))
    room, places = np.empty(4 * STRIDE * count, np.float32), np.empty(STRIDE * count, np.int64)
    inputs = np.empty((width + 1) * STRIDE * count, np.float32)
    for k, (t, n, full) in enumerate(zip(after.tolist(), active.tolist(), whole.tolist())):
        every = inputs[: (width + 1) * STRIDE * n].reshape(width + 1, STRIDE, n)
        every[...] = laid[:, t : t + n].transpose(0, 2, 1)
        own, bit = every[:width], every[width]
        dot, q, a, gain = room[: 4 * STRIDE * n].reshape(4, STRIDE, n)
        near = places[: STRIDE * n].reshape(STRIDE, n)
        np.einsum("kn,kjn->jn", weights[:, :n], own, out=dot)
        np.minimum(dot, most, out=dot)
        np.maximum(dot, -most, out=dot)
        np.multiply(dot, four, out=q)
        np.rint(q, out=q)
        q *= bit
        near[...] = q
        near += cell[:n]
        p = np.tanh(dot, out=dot)
        if full < n:  # a segment's last step
            past = bit[:, full:] == 0
            near[:, full:][past] = count * CELLS
        refine.take(near, out=a, mode="clip")
        np.multiply(a, bit, out=gain)
        gain += p
        gain += middle
        if full < n:
            gain[:, full:][past] = 1
        for half in (STRIDE // 2, STRIDE // 4, STRIDE // 8):  # products of eight and, of double precision, of sixty-four are far from the least number
            gain[:half] *= gain[half : 2 * half]
        product[:n] *= gain[0]
        if k % 8 == 7:
            out[:since] += np.log(product[:since])
            product[:since], since = 1, n
        np.subtract(1, p, out=p)
        move = np.einsum("kjn,jn->kn", own, p)
        move *= rate
        weights[:, :n] += move
        bit *= rest
        a *= stay
        a += bit
        refine[near] = a
    out[:since] += np.log(product[:since])
    back = np.empty(count)
    back[order] = out
    return back


def score_texts(texts: list[str | None], model: Model) -> dict[str, list]:
    """Columns of the texts: tokens, bytes, score and, as far as words are heavy, known and base; the rare words."""
    out: dict[str, list] = {k: [] for k in ("n_tokens", "known", "base", "score", "n_bytes", "rare")}
    floor = float(np.log10(model.tokens + model.types + 1))
    held: tuple[list, ...] = ([], [], [])  # of classes, of bytes and of words: decisions, and the text of each segment with its size
    waiting: list[tuple[int, bytes, tuple[int, int, int]]] = []

    def hold(which: int, x: np.ndarray, owner: np.ndarray, size: np.ndarray) -> None:
        if not len(x):
            return
        at = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))  # texts follow one another
        n = np.add.reduceat(size, at)
        segments = [(k, min(SEGMENT, m - a)) for k, m in zip(owner[at].tolist(), n.tolist()) for a in range(0, m, SEGMENT)]
        held[which].append((x, np.array(segments, np.int64).reshape(-1, 2)))

    def read() -> tuple[int, int, int]:
        """Turn the waiting parts into decisions."""
        if not waiting:
            return NOTHING
        words = cut([p for _, p, _ in waiting], PART)
        s = symbols(model.words, words, [s for _, _, s in waiting])
        part = np.repeat(np.arange(len(waiting)), words.count)
        text = np.array([k for k, _, _ in waiting], np.int64)[part]
        rare, heavy = np.flatnonzero(s.word < 0), s.word >= 0
        x, n = model.classes(s)
        hold(0, x, text, n)
        if len(rare):
            leaf, contexts, sizes = byte_contexts(model.words, s.rare, s.kind[rare])
            n = np.add.reduceat(model.words.bytes.lengths[leaf], np.cumsum(sizes) - sizes)
            hold(1, model.spelled(leaf, contexts), text[rare], n)
        if model.inner is None:
            inside = np.where(heavy, model.words.share[s.word], model.words.escape[s.kind])
        else:
            at, leaf, contexts = word_symbols(model.words, s)
            x, n = model.inside(leaf, contexts)
            hold(2, x, text[at], n)
            inside = np.zeros(len(part))
        log = np.where(heavy, model.words.log[s.word], 0)
        sums = [np.bincount(part, v, len(waiting)).tolist() for v in (inside, log > 0, log, words.size)]
        for (k, _, _), share, n, log, size, tokens in zip(waiting, *sums, words.tokens.tolist()):
            out["n_tokens"][k] += tokens
            out["n_bytes"][k] += int(size) + tokens
            out["score"][k] += share
            out["known"][k] += int(n)
            out["base"][k] += log
        for k, w, piece in zip(text[rare].tolist(), s.rare, words.piece[rare].tolist()):
            if not piece:
                out["rare"][k].append(w)
        for k, w in words.long:  # spelled in pieces, counted as one
            out["rare"][waiting[k][0]].append(w)
        waiting.clear()
        if sum(len(x) for of in held for x, _ in of) >= TOGETHER:
            flush()
        return s.after

    def flush() -> None:
        """All that is held, side by side: what a class has no model for is zero."""
        every = [(x, segments) for of in held for x, segments in of]
        for of in held:
            of.clear()
        if not every:
            return
        x, segments, at = np.zeros((5, sum(len(x) for x, _ in every)), np.int8), np.concatenate([s for _, s in every]), 0
        for own, _ in every:
            x[: own.shape[1] - 1, at : at + len(own)], x[4, at : at + len(own)] = own.T[:-1], own.T[-1]
            at += len(own)
        every.clear()
        for k, gain in zip(segments[:, 0].tolist(), (mix(x.T, segments[:, 1]) / np.log(10)).tolist()):
            out["score"][k] += gain

    size = 0
    for k, t in enumerate(texts):
        for c, zero in (("n_tokens", 0), ("known", 0), ("base", 0.0), ("score", 0.0), ("n_bytes", -1)):
            out[c].append(zero)
        out["rare"].append([])
        state = NOTHING
        for own, ends in pieces(t):
            waiting.append((k, own, state))
            size += len(own)
            if not ends or size >= PART:
                state, size = read(), 0
    read()
    flush()
    out["base"] = [base - n * floor for base, n in zip(out["base"], out["n_tokens"])]
    return out


# Learning.


class Pairs:
    """Counts of (context, leaf) pairs, compacted as they grow."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> None:
        """n: one of each where it is not given."""
        self.held.append(_counted(keys) if n is None else _summed(keys, n, "quicksort"))
        self.size += len(self.held[-1][0])
        if self.size > HELD:
            self.compact()

    def append(self, keys: np.ndarray, n: np.ndarray) -> None:
        """Keys that are sorted and distinct."""
        self.held.append((keys, n))
        self.size += len(keys)
        if self.size > HELD:
            self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.held) != 1:
            self.held = [_summed(np.concatenate([k for k, _ in self.held] or [np.empty(0, np.uint64)]), np.concatenate([n for _, n in self.held] or [np.empty(0, np.float32)]))]
        self.size = len(self.held[0][0])
        return self.held[0]

    def blocks(self, first: int, group: int, places: int = PLACE_BITS) -> Iterator[pa.RecordBatch]:
        """The pairs by place, from the number first on, and forget them."""
        keys, n = self.compact()
        place = (keys >> np.uint64(64 - places)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(keys) else []
        for a, b in zip(start, [*start[1:], len(keys)]):
            yield block(first + int(place[a]), group, keys[a:b], n[a:b])
        self.held, self.size = [], 0


def _summed(keys: np.ndarray, n: np.ndarray, kind: str = "stable") -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their sums; the stable kind is quick with parts that are sorted already."""
    order = np.argsort(keys, kind=kind)
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.add.reduceat(n[order].astype(np.float64), start).astype(np.float32) if len(keys) else n


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As _summed with ones; sorting alone takes a part of the time that finding places does."""
    keys = np.sort(keys)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[start], np.diff(start, append=len(keys)).astype(np.float32)


def block(place: int, part: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Sorted keys by their differences, with the bytes of the same rank together, which zstd shortens well."""
    steps, own = np.diff(keys, prepend=np.uint64(0)), n.astype(np.float32).view(np.uint32)
    ranks = [(steps >> np.uint64(8 * k)).astype(np.uint8) for k in range(8)] + [(own >> np.uint32(8 * k)).astype(np.uint8) for k in range(4)]
    data = zstandard.ZstdCompressor(level=1).compress(np.concatenate(ranks))
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["place", "part", "data"])


def unblocked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    own = zstandard.decompress(data)
    n = len(own) // 12
    steps = np.ascontiguousarray(np.frombuffer(own, np.uint8, 8 * n).reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(np.frombuffer(own, np.uint8, 4 * n, 8 * n).reshape(4, n).T).view("<f4").ravel()


def place_table(keys: np.ndarray, n: np.ndarray, code: Code | Tree, strength: float, bits: int, places: int = PLACE_BITS, leaf_bits: int = LEAF_BITS) -> np.ndarray:
    """A place's part of a table, from its sorted pairs. Of decisions that meet in an entry the most frequent stays."""
    inner = 1 << (bits - places)
    best, out = np.zeros(inner, np.float32), np.zeros(inner, np.uint16)
    context, leaf = keys >> np.uint64(leaf_bits) << np.uint64(leaf_bits - LEAF_BITS), (keys & np.uint64((1 << leaf_bits) - 1)).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.empty(0, np.int64)
    cuts = [0]  # whole contexts together, up to a million pairs
    for b in [*begin[1:].tolist(), len(keys)]:
        if b - cuts[-1] > 1_000_000 or b == len(keys):
            cuts.append(b)
    for a, b in zip(cuts, cuts[1:]):
        for c, node, prior, zero, one in code.decisions(context[a:b], leaf[a:b], n[a:b].astype(np.float64)):
            slot, tag = slots(c, node, bits, places)
            slot &= np.uint64(inner - 1)
            odds = quantised((one + strength * prior) / (zero + one + strength)).astype(np.int16)
            both = (zero + one).astype(np.float32)
            better = np.flatnonzero(both > best[slot])
            better = better[np.argsort(both[better], kind="stable")]
            best[slot[better]] = both[better]
            out[slot[better]] = tag[better] << np.uint16(8) | (odds[better] + 128).astype(np.uint16)
    return out


def class_rows(keys: np.ndarray, n: np.ndarray, words: Words, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Log odds by class and depth of the rows first to last, from their sorted pairs, and how often each was seen."""
    code, width = words.code, len(words.code.odds)
    out = np.tile(code.odds, (last - first, 1))
    row, leaf = (keys // np.uint64(words.classes)).astype(np.int64) - first, (keys % np.uint64(words.classes)).astype(np.int64)
    n = n.astype(np.float64)
    for depth, at, group, zero, one, start in code.levels(row.astype(np.uint64), leaf, n):
        prior = code.prior[code.first[leaf[start]] + depth]
        odds = quantised((one + STRENGTH[0] * prior) / (zero + one + STRENGTH[0]))
        # a node's odds go to all leaves below it, seen in this row or not
        node = code.nodes[code.first[leaf[start]] + depth]
        below = words.below[depth]
        for k in range(0, len(start), 1 << 16):
            ends = below[1][np.searchsorted(below[0], node[k : k + (1 << 16)])]
            size = ends[:, 1] - ends[:, 0]
            leaves = np.repeat(ends[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            out[np.repeat(row[start[k : k + (1 << 16)]], size), code.first[leaves] + depth] = np.repeat(odds[k : k + (1 << 16)], size)
    return out, np.bincount(row, n, last - first)


KIND = "place int, part int, data binary"


def _word_counts(rows: DataFrame) -> DataFrame:
    """(word, n) of the training rows; the end of a text is the word END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch):
                for t in part.column("text").to_pylist():
                    found.update(word_bytes(t))
                found[END] += part.num_rows
                if len(found) > 500_000:
                    yield out()
                    found.clear()
        yield out()

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


ROWS_PLACE = 256  # rows of class contexts to a place


def _tables(texts: DataFrame, counts: DataFrame, words: Words, tokens: int, types: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of class contexts, their confidence, and the tables of bytes and of words: pairs counted in tasks, merged for each place by MERGE
    tasks at once and then whole. Places of bytes come first, then those of rows, then those of words."""
    spark = texts.sparkSession
    bits = max(LEAST_BITS, min(MAX_BITS, int(np.ceil(np.log2(max(2, 64 * types))))))
    word_bits = max(LEAST_BITS, min(MAX_BITS, int(np.ceil(np.log2(max(2, 64 * tokens))))))
    rows, places = int(words.firsts[-1]), 1 << PLACE_BITS
    last_row = places + -(-rows // ROWS_PLACE)
    shared = spark.sparkContext.broadcast(words)

    def group() -> int:
        from pyspark import TaskContext

        return TaskContext.get().partitionId() // MERGE

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = shared.value
        seen, inner = np.zeros(rows * code.classes, np.float32), Pairs()

        def add(waiting: list) -> tuple[int, int, int]:
            s = symbols(code, cut([p for p, _ in waiting], PART), [s for _, s in waiting]) if waiting else None
            waiting.clear()
            if s is None:
                return NOTHING
            np.add.at(seen, (s.rows * code.classes + code.leaf[s.kind][:, None]).ravel(), np.float32(1))
            _, leaf, contexts = word_symbols(code, s)
            keys = (contexts << np.uint64(LEAF_BITS) | leaf.astype(np.uint64)[:, None]).T.ravel()
            inner.add(keys)
            return s.after

        for batch in batches:
            for part in slices(batch, 256):
                waiting, size, state = [], 0, NOTHING
                for t in part.column("text").to_pylist():
                    state = NOTHING
                    for own, ends in pieces(t):
                        waiting.append((own, state))
                        size += len(own)
                        if not ends or size >= PART:
                            state, size = add(waiting), 0
                add(waiting)
                if inner.size > HELD // 2:
                    yield from inner.blocks(last_row, group(), WORD_PLACE_BITS)
        yield from inner.blocks(last_row, group(), WORD_PLACE_BITS)
        for p in range(0, rows, ROWS_PLACE):
            own = seen[p * code.classes : (p + ROWS_PLACE) * code.classes]
            at = np.flatnonzero(own)
            if len(at):
                yield block(places + p // ROWS_PLACE, group(), (at + p * code.classes).astype(np.uint64), own[at])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, code = Pairs(), shared.value
        for batch in batches:
            for part in slices(batch, 20_000):
                own = [(w, n) for w, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()) if w != END]
                heavy = code.lexicon.find(cut([b" ".join([w for w, _ in own])])) >= 0
                own = [(w, 1 if h else n) for (w, n), h in zip(own, heavy.tolist())]
                own = [(w[k : k + PART], n) for w, n in own for k in range(0, len(w), PART)]
                while own:  # up to PART bytes at once
                    size, some = 0, 0
                    while some < len(own) and (not some or size + len(own[some][0]) <= PART):
                        size += len(own[some][0])
                        some += 1
                    now, own = own[:some], own[some:]
                    leaf, contexts, sizes = byte_contexts(code, [w for w, _ in now], np.array([code.class_of(w) for w, _ in now]))
                    times = np.repeat(np.array([n for _, n in now], np.float32), sizes)
                    keys = (contexts << np.uint64(LEAF_BITS) | leaf.astype(np.uint64)[:, None]).T.ravel()
                    pairs.add(keys, np.tile(times, len(ORDERS)))
                if pairs.size > HELD // 2:
                    yield from pairs.blocks(0, group())
        yield from pairs.blocks(0, group())

    def merged(last: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, now, code = Pairs(), None, shared.value

            def out() -> Iterator[pa.RecordBatch]:
                nonlocal pairs
                if now is None:
                    return
                keys, n = pairs.compact()
                pairs = Pairs()
                place, part = now
                if not last:
                    yield block(place, part, keys, n)
                    return
                if place < places:
                    data = place_table(keys, n, code.bytes, STRENGTH[1], bits).astype("<u2").tobytes()
                elif place >= last_row:
                    data = place_table(keys, n, code.tree, STRENGTH[2], word_bits, WORD_PLACE_BITS, WORD_LEAF_BITS).astype("<u2").tobytes()
                else:
                    first = (place - places) * ROWS_PLACE
                    odds, seen = class_rows(keys, n, code, first, min(rows, first + ROWS_PLACE))
                    data = odds.tobytes() + np.searchsorted(SEEN, seen, "right").astype(np.uint8).tobytes()
                data = zstandard.ZstdCompressor(level=1).compress(data)
                yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([0], pa.int32()), pa.array([data], pa.binary())], ["place", "part", "data"])

            for batch in batches:
                for place, part, data in zip(*(batch.column(c) for c in ("place", "part", "data"))):
                    key = place.as_py(), 0 if last else part.as_py()
                    if key != now:
                        yield from out()
                        now = key
                    pairs.append(*unblocked(data.as_py()))
            yield from out()

        return run

    both = texts.mapInArrow(follow, KIND).unionByName(counts.mapInArrow(spell, KIND))
    first = both.repartition("place", "part").sortWithinPartitions("place", "part").mapInArrow(merged(False), KIND)
    done = first.repartition("place").sortWithinPartitions("place").mapInArrow(merged(True), KIND)
    odds, seen, table, inner = np.tile(words.code.odds, (rows, 1)), np.zeros(rows, np.uint8), np.zeros(1 << bits, np.uint16), np.zeros(1 << word_bits, np.uint16)
    made = done.select("place", "data").toArrow()  # the tables' bounded size at most, compressed
    for place, data in zip(made.column("place").to_pylist(), made.column("data")):
        own = zstandard.decompress(data.as_py())
        if place < places:
            part = np.frombuffer(own, "<u2")
            table[place * len(part) : (place + 1) * len(part)] = part
        elif place >= last_row:
            part = np.frombuffer(own, "<u2")
            inner[(place - last_row) * len(part) : (place - last_row + 1) * len(part)] = part
        else:
            at = (place - places) * ROWS_PLACE
            n = min(rows, at + ROWS_PLACE) - at
            odds[at : at + n] = np.frombuffer(own, np.int8, n * odds.shape[1]).reshape(n, -1)
            seen[at : at + n] = np.frombuffer(own, np.uint8, n, n * odds.shape[1])
    shared.destroy(blocking=True)
    return odds.ravel(), seen, table, inner


def _heavy(counts: DataFrame) -> DataFrame:
    """The most frequent words, HEAVY at most: those above a count, which is found from the sizes of classes of like counts."""
    grade = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["g"], r["k"]) for r in counts.groupBy(grade.alias("g")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, held = 1 << 20, 0
    for g, k in sizes:  # about a thousand grades at most
        if held + k > HEAVY:
            break
        least, held = g, held + k
    return counts.where(grade >= least)


def learn(rows: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the training rows (text), and their word counts."""
    counts = shared_table(_word_counts(rows))
    size = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    found = _heavy(counts).toArrow()  # columns, which take a small part of the driver's memory that rows would
    top = dict(zip(found.column("word").to_pylist(), found.column("n").to_pylist()))
    del found
    ends = counts.groupBy(F.substring("word", -2, 2).alias("x")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once"))
    suffixes = {bytes(r["x"]): (r["n"], r["once"]) for r in ends.collect()}  # two bytes, so 2^16 at most
    words = Words(top, suffixes, size["n"])
    del top
    odds, seen, table, inner = _tables(rows, counts, words, size["n"], size["v"])
    return Model(words, odds, seen, table, size["n"], size["v"], inner), counts


def lm_score(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10) and bits_per_byte for each row of docs."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), learn_from.alias("learn"))
    model, counts = learn(rows.where("learn").select("text"))
    tokens = model.tokens
    shared = docs.sparkSession.sparkContext.broadcast(model)
    del model
    kinds = {"n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64(), "rare": pa.list_(pa.binary())}
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, rid long, n_tokens long, known long, base double, score double, n_bytes long, rare array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048):
                found = score_texts(part.column("text").to_pylist(), shared.value)
                columns = [part.column("doc_id"), part.column("rid"), *(pa.array(found[c], k) for c, k in kinds.items())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rid", *kinds])

    scored = shared_table(rows.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text").mapInArrow(run, out))
    shared.destroy()  # scored is written, and its disk is free for the join
    rare = scored.select("rid", F.explode("rare").alias("word"))
    met = rare.join(counts.hint("merge"), "word").groupBy("rid").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count("*").alias("also"))
    return scored.drop("rare").join(met, "rid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
