"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are compared as folded code points: lower case, each run of white space one space, trimmed. An item of m
code points that stands in a text with at most e edits shares at least m + 1 - q - q e of its q-grams with the text,
and those lie on diagonals (text position less item position) at most e apart to either side. So the shared q-grams
are counted in bands of diagonals, each 2 (e + 1) wide and starting every e + 1, which hold every e + 1 neighbouring
diagonals whole; bands that reach the count are the regions kept, and each is verified by an alignment of the item
within the band, free at both ends of the region. Any distance of at most e is a leak.

Items are cut into overlapping passages of ``passage`` code points (shorter items are one passage), and into ``short`` ones
of 64 that begin every 16, so that a part of an item is found as well: any run of RUN code points or more (about 13 words)
that stands in a text verbatim holds a whole short passage, and so does one with edits that leave a short passage with at
most e. e is ``edit_rate`` of a passage, lowered where the lemma would ask for fewer than LEAST_GRAMS.

The benchmark is broadcast: its size is checked, and an index takes about 150 bytes a code point in each worker. Up to
MAX_ITEM_CHARS there is no shuffle. A larger benchmark is taken in parts of that size, dealt out by hash of the item: each part is one
more pass over the texts, of which only the leaks found are kept, and these meet their rows in a join at the end.

Defined results: null and empty texts have no leak; null and empty items are ignored; items shorter than q are found as
exact substrings between word ends; equal items each name their id; ids may repeat; texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import begin, pack, slices
from quarry.plans.shared import shared_table

MAX_ITEM_CHARS = 1_000_000
LEAST_GRAMS = 4
#: Code points of a short passage and from one's beginning to the next; the least verbatim run of an item that is always found.
SHORT, STRIDE = 64, 16
RUN = SHORT + STRIDE - 1
#: Most counters of diagonals by passage, before the diagonals are sorted.
STRIPS = 256
_MULT, _HALF = np.uint64(0x9E3779B97F4A7C15), np.uint32(0x9E3779B1)


def folded(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(points: np.ndarray, q: int, at: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of each q-gram, or of those at some positions."""
    at = np.arange(max(0, len(points) - q + 1)) if at is None else at
    h = np.zeros(len(at), np.uint64)
    for k in range(q):
        h = h * _MULT + points[at + k].astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(29))


def slots(points: np.ndarray, q: int, bits: int) -> np.ndarray:
    """A slot of 2^bits for each q-gram, q a power of two: q-grams are put together from halves."""
    h = points.astype(np.uint32)
    width = 1
    while width < q:
        h = h[:-width] * _HALF + h[width:]
        width *= 2
    h ^= h >> np.uint32(15)
    h *= _HALF
    h >>= np.uint32(32 - bits)
    return h


def exact_within(item: np.ndarray, region: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """The item without edits on one of the diagonals."""
    for at in range(max(0, low), min(high, len(region) - len(item)) + 1):
        if region[at] == item[0] and np.array_equal(region[at : at + len(item)], item):
            return 0, at, at + len(item)
    return None


def distance_within(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Least edits of the whole item against any part of region, on diagonals low..high (region less item position).

    Returns (edits, start, end) in region, or None if over most. One row of the band a code point of the item; a row's
    insertions are closed by a running minimum.
    """
    width = high - low + 1
    offsets = np.arange(width)
    big = len(item) + len(region) + 1
    at = offsets + low  # region position of column 0..
    row = np.where((at >= 0) & (at <= len(region)), 0, big)
    came = at.copy()
    for i in range(1, len(item) + 1):
        at = offsets + low + i
        inside = (at >= 0) & (at <= len(region))
        look = np.clip(at - 1, 0, max(0, len(region) - 1))
        same = (region[look] == item[i - 1]) & (at >= 1) if len(region) else np.zeros(width, bool)
        best = row + np.where(same, 0, 1)
        best[at < 1] = big
        from_up = np.append(row[1:], big) + 1  # the item's code point has no partner
        new_came = np.where(from_up < best, np.append(came[1:], 0), came)
        best = np.minimum(best, from_up)
        best = np.where(inside, best, big)
        key = best - offsets  # running minimum over insertions
        run = np.minimum.accumulate(key)
        first = np.maximum.accumulate(np.where(key == run, offsets, 0))
        row = np.minimum(run + offsets, big)
        came = new_came[first]
        if row.min() > most:
            return None
    end = int(row.argmin())
    if row[end] > most:
        return None
    return int(row[end]), int(came[end]), int(end + low + len(item))


@dataclass
class Index:
    """Passages of the benchmark. items: (id, folded text)."""

    items: list[tuple[object, str]]
    q: int = 8
    edit_rate: float = 0.1
    passage: int = 200

    def __post_init__(self) -> None:
        if self.q & (self.q - 1) or self.q < 2:
            raise ValueError("q must be a power of two")

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("items", "q", "edit_rate", "passage")}

    @cached_property
    def built(self) -> tuple:
        passages: list[tuple[int, int, np.ndarray, int]] = []  # item, offset, points, edits
        tiny: list[tuple[int, str]] = []
        for k, (_, text) in enumerate(self.items):
            points = code_points(text)
            if len(points) < self.q:
                if text:
                    tiny.append((k, text))
                continue
            step = max(1, self.passage // 2)
            starts = range(0, max(1, len(points) - self.passage + step), step) if len(points) > self.passage else [0]
            for s in starts:
                part = points[s : s + self.passage] if len(points) > self.passage else points
                if s and len(part) < self.passage:
                    s, part = len(points) - self.passage, points[-self.passage :]
                able = (len(part) + 1 - self.q - LEAST_GRAMS) // self.q
                passages.append((k, s, part, max(0, min(int(self.edit_rate * len(part)), able))))
            # a run is found by its short passages; the last one ends with the item
            able = (SHORT + 1 - self.q - LEAST_GRAMS) // self.q
            last = len(points) - SHORT
            for s in [*range(0, last, STRIDE), last] if min(len(points), self.passage) > SHORT else []:
                passages.append((k, s, points[s : s + SHORT], max(0, min(int(self.edit_rate * SHORT), able))))
        hashes = [grams(p[2], self.q) for p in passages]
        sizes = np.array([len(h) for h in hashes], np.int64)
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(passages)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        order = np.argsort(flat, kind="stable")
        keys, first, times = np.unique(flat[order], return_index=True, return_counts=True)
        # a filter with sixteen slots a q-gram before the exact look-up
        mask = np.zeros(1 << min(28, max(16, (16 * len(keys)).bit_length())), bool)
        for p in passages:
            mask[slots(p[2], self.q, len(mask).bit_length() - 1)] = True
        edits = np.array([p[3] for p in passages], np.int64)
        need = np.maximum(1, np.array([len(p[2]) for p in passages], np.int64) + 1 - self.q - self.q * edits)
        return passages, tiny, keys, first, times, owner[order], place[order], mask, edits, need

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) in a folded text; of overlapping finds of an item, the one with fewest edits."""
        passages, tiny, keys, first, times, owner, place, mask, edits, need = self.built
        found = []
        padded = f" {text} "
        for k, item in tiny:
            at = padded.find(f" {item} ")
            while at >= 0:
                found.append((k, at, at + len(item), 0))
                at = padded.find(f" {item} ", at + 1)
        points = code_points(text)
        near = np.empty(0, np.int64)
        if len(points) >= self.q and len(keys):
            bits = len(mask).bit_length() - 1
            # in parts that stay in the caches
            parts = [np.flatnonzero(mask[slots(points[a : a + (1 << 15) + self.q - 1], self.q, bits)]) + a for a in range(0, len(points) - self.q + 1, 1 << 15)]
            near = np.concatenate(parts)
        if len(near):
            own = grams(points, self.q, near)
            slot = np.searchsorted(keys, own)
            slot[slot == len(keys)] = 0
            hit = keys[slot] == own
            near, slot = near[hit], slot[hit]
        if len(near):
            found += self._regions(points, near, slot)
        return self._merged(found)

    def _regions(self, points: np.ndarray, near: np.ndarray, slot: np.ndarray) -> list[tuple[int, int, int, int]]:
        passages, _, _, first, times, owner, place, _, edits, need = self.built
        n = times[slot]
        take = np.repeat(first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        passage = owner[take]
        # a passage with fewer shared q-grams in the whole text than a band of it needs has no such band
        enough = np.bincount(passage, minlength=len(need)) >= need
        able = np.flatnonzero(enough[passage])
        if not len(able):
            return []
        passage, position = passage[able], place[take[able]]
        diagonal = np.repeat(near, n)[able] - position
        # each diagonal lies in two overlapping bands, its own strip of diagonals with the next one and with the one before
        band = np.floor_divide(diagonal, edits[passage] + 1)
        # likewise for two strips, counted by the remainders of their numbers: those that agree in them are counted together
        some = int(enough.sum())
        strips = max(2, min(STRIPS, (1 << 20) // some))
        first_of = (np.cumsum(enough) - 1)[passage] * strips
        own, before = first_of + band % strips, first_of + (band - 1) % strips
        counts = np.bincount(own, minlength=some * strips).reshape(-1, strips)
        reach = (counts + np.roll(counts, -1, 1) >= need[enough][:, None]).ravel()
        upper, lower = reach[own], reach[before]
        who = np.concatenate([passage[upper], passage[lower]])
        if not len(who):
            return []
        bands = np.concatenate([band[upper], band[lower] - 1])
        at = np.concatenate([position[upper], position[lower]])
        order = np.lexsort((at, bands, who))
        who, bands, at = who[order], bands[order], at[order]
        new = np.concatenate([[True], (who[1:] != who[:-1]) | (bands[1:] != bands[:-1])])
        distinct = new | np.concatenate([[True], at[1:] != at[:-1]])  # a q-gram of the item counts once a band
        starts = np.flatnonzero(new)
        count = np.add.reduceat(distinct.astype(np.int64), starts)
        out = []
        enough = starts[count >= need[who[starts]]]
        found = (-1, 0)  # passage and band of the last find: the next band holds the same diagonals again
        for w, b in zip(who[enough].tolist(), bands[enough].tolist(), strict=True):
            if found == (w, b - 1):
                continue
            item, _, part, e = passages[w]
            low = b * (e + 1)
            high = low + 2 * (e + 1) - 1
            got = exact_within(part, points, low, high) or distance_within(part, points, low, high, e)
            if got:
                out.append((item, got[1], got[2], got[0]))
                found = (w, b)
        return out

    @staticmethod
    def _merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        out: list[tuple[int, int, int, int]] = []
        for item, a, b, e in sorted(set(found)):
            if out and out[-1][0] == item and a < out[-1][2]:
                last = out.pop()
                out.append((item, min(last[1], a), max(last[2], b), min(last[3], e)))
            else:
                out.append((item, a, b, e))
        return out


def benchmark_items(benchmark: DataFrame, id_col: str = "item_id", text: str = "text") -> tuple[DataFrame, int]:
    """The items that have a text, and into how many parts they must be dealt."""
    rows = benchmark.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    return rows, max(1, -(-size // MAX_ITEM_CHARS))


def benchmark_index(rows: DataFrame, **options: float) -> Index:
    items = sorted({(r["id"], folded(r["text"])) for r in rows.collect()}, key=lambda x: (x[0] is None, str(x[0]), x[1]))
    return Index(items, **options)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep_text: bool = False, **options: float) -> DataFrame:
    """Returns _row (the row of docs, without its text unless keep_text) and leaks: array of (item_id, start, end, edits).

    start and end are code points of the folded text. Every row of docs is returned; leaks is empty for clean ones.
    """
    items, parts = benchmark_items(benchmark, item_id, item_text)
    if parts > 1:
        return _leaks_in_parts(docs, items, parts, text, keep_text, options)
    return _scan(docs, items, text, keep_text, options)


def _scan(docs: DataFrame, items: DataFrame, text: str, keep_text: bool, options: dict) -> DataFrame:
    index = docs.sparkSession.sparkContext.broadcast(benchmark_index(items, **options))
    rows = pack(docs, _text=text)
    if not keep_text:
        rows = rows.withColumn("_row", F.col("_row").dropFields(text))
    id_kind = items.schema["id"].dataType.simpleString()
    kind = rows.schema["_row"].dataType.simpleString()
    leak = pa.list_(pa.struct([("item_id", pa.int64() if id_kind in ("bigint", "int") else pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
    leak_kind = f"array<struct<item_id:{'bigint' if id_kind in ('bigint', 'int') else 'string'},start:bigint,end:bigint,edits:bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("decontaminate")
        own = index.value
        for batch in batches:
            for part in slices(batch):
                found = [
                    [{"item_id": own.items[k][0], "start": a, "end": b, "edits": e} for k, a, b, e in own.search(folded(t))]
                    for t in part.column("_text").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array(found, leak)], ["_row", "leaks"])

    return rows.mapInArrow(run, f"_row {kind}, leaks {leak_kind}")


def _leaks_in_parts(docs: DataFrame, items: DataFrame, parts: int, text: str, keep_text: bool, options: dict) -> DataFrame:
    """As leaks, a pass for each part of the items."""
    rows = shared_table(pack(docs).withColumn("rid", F.monotonically_increasing_id()))
    texts = rows.select("rid", F.col("_row").getField(text).alias("text"))
    found = None
    for k in range(parts):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == k)
        part = shared_table(_scan(texts, own, "text", False, options).where("size(leaks) > 0").select("_row.rid", "leaks"))
        found = part if found is None else found.unionByName(part)
    whole = found.groupBy("rid").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    kept = F.col("_row") if keep_text else F.col("_row").dropFields(text)
    return rows.join(whole, "rid", "left").select(kept.alias("_row"), F.coalesce("leaks", F.array().cast(found.schema["leaks"].dataType)).alias("leaks"))
