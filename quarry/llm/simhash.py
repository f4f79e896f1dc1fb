"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints that differ in at most three bits have a
segment in which they differ in at most one, and then agree on that segment with the bit that differs left out. Each
distinct fingerprint is indexed under its 64 one-wildcard segment variants; an equality join on the variants gives the
candidates, whose full distance is verified.

A variant that many fingerprints share is not expanded into pairs. Fingerprints of a variant with at most MAX_BUCKET
members are compared with each other; those of a larger one take an exact way round: two fingerprints differ in at most
d bits if and only if the balls of radius ceil(d / 2) and floor(d / 2) round them meet, so for d = 2 the members are
grouped by the 65 values of the ball of radius one, in which all members of a group are linked, and one link a member
to the group's least says so. No link is lost, and work grows with the number of fingerprints, not of pairs.

Links of two or three bits stand for a similarity of about 0.95 or more. ``similar_groups`` is for a given similarity of the
sets of shingles: it verifies the SimHash links, and further candidates from bands of minimum hashes, since no number of bits
that deletion variants can reach holds all pairs of similarity 0.8. Buckets of a band of up to MAX_BUCKET members pair all. In
a larger one, members are paired with two of them first, the one that shares most buckets with others and the first, then, where that leaves several groups, with one more a
round. Where the links so found leave a bucket's members in several groups, a similarity join with a prefix filter on rare shingles finds all
similar pairs of these members across the groups, so no pair that shares a bucket is lost.

Defined results: null, empty and wordless texts have fingerprint zero, linked like any other; a text of fewer words than
a shingle is one shingle; repeated rows share their class; rows with a null id are fingerprinted and never name a class
unless no other member has an id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quarry.llm.common import begin, pack, slices, word_bytes
from quarry.plans.components import connected_components
from quarry.plans.shared import drop_shared, release, shared_table

SEED = 42
#: Members of a variant up to which its members are compared with each other.
MAX_BUCKET = 4


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased words, repeats included."""
    words = word_bytes(text)
    if len(words) <= size:
        joined = [b" ".join(words)] if words else []
    else:
        joined = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]
    return np.fromiter((xxh64_intdigest(s, SEED) for s in joined), np.uint64, len(joined))


def majority_bits(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """Returns doc_id and fp, a long with the fingerprint's 64 bits. A map over rows."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for batch in batches:
            for part in slices(batch):
                bits = np.array([majority_bits(shingle_hashes(t, shingle)) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """64 rows for each fp: which segment and wildcard, and the segment without that bit, as one long."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    rows = fps.select("fp", bit)
    segment = F.expr("case when bit < 32 then fp & 4294967295L else shiftrightunsigned(fp, 32) end")
    return rows.select("fp", F.expr("cast(bit as long) << 32").bitwiseOR(F.expr("shiftleft(1L, bit % 32)").bitwiseXOR(F.lit(-1)).bitwiseAND(segment)).alias("variant"))


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """fps: distinct fp. Returns (u, v), links whose connected components are those of all pairs within max_bits bits.

    max_bits up to 2: the members of a large variant are then linked by balls of radius one.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2")
    variants = _variants(fps)
    sizes = variants.groupBy("variant").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    sizes = shared_table(sizes)
    close = F.expr("bit_count(u ^ v)") <= max_bits
    two = sizes.where("n = 2").select("u", "v").where(close)
    # a merge join at every size: what is shuffled is then in proportion to the fingerprints
    more = variants.join(sizes.where("n > 2").select("variant", "n").hint("merge"), "variant")
    some = more.where(F.col("n") <= MAX_BUCKET).groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = some.select(F.posexplode("fps").alias("i", "u"), "fps").select("u", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("v")).where(close)
    hot = more.where(F.col("n") > MAX_BUCKET).select("fp").distinct()
    radius = 1 if max_bits == 2 else 0
    if max_bits == 1:  # linked at one bit: the pair's values with that bit left out agree
        keys = hot.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select("fp", "bit", F.expr("fp & ~shiftleft(1L, bit)").alias("ball"))
        by = ["bit", "ball"]
    else:
        flips = F.sequence(F.lit(-1), F.lit(63)) if radius else F.array(F.lit(-1))
        keys = hot.select("fp", F.explode(flips).alias("bit")).select("fp", F.expr("case when bit < 0 then fp else fp ^ shiftleft(1L, bit) end").alias("ball"))
        by = ["ball"]
    least = keys.groupBy(*by).agg(F.min("fp").alias("v"), F.count("*").alias("k")).where("k > 1").drop("k")
    meets = keys.join(least, by).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return two.unionByName(pairs).unionByName(meets).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """Returns doc_id, fp and component_id, the least doc_id reachable over links of at most max_bits bits.

    Fingerprints are computed once and written as a shared table. Copies meet in their fingerprint, so only distinct
    ones are indexed. The last join is between two written tables, so a hot fingerprint's rows are split at run time.
    """
    marked = shared_table(fingerprints(docs, id_col, text, shingle))
    least = shared_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = links(least.select("fp"), max_bits)
    roots = connected_components(edges)
    placed = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    classes = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = shared_table(placed.select("fp", "root").join(classes, "root").select("fp", "component_id"))
    return marked.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: Bands and hashes a band; a pair of similarity 0.8 shares one with probability 1 - 7e-5. Hashes of a set that are kept to verify.
BANDS, ROWS, SKETCH = 24, 5, 256
#: What a sketch may fall short of the similarity before its pair is left out without comparing the whole sets: five of its standard errors,
#: so about one similar pair in ten million.
MARGIN = 0.15


#: Rounds in which the members of buckets that hold several groups are compared with one of them each, before the join on rare shingles.
STAR_ROUNDS = 3


def band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of ROWS minimum hashes for each band."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[k : k + 2048, None] * a + b).min(0))
    return np.array([xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(low.reshape(BANDS, ROWS))], np.uint64)


def sketches(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """docs has rid, id and text. Returns rid, id, fp, sig (a hash of the set of shingles), keys of the bands, and the upper halves of the SKETCH least
    hashes, which tell two shingles apart but once in millions of pairs."""

    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        random = np.random.default_rng(SEED)
        a = random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch):
                fps, sigs, keys, least = [], [], [], []
                for t in part.column("text").to_pylist():
                    hashes = shingle_hashes(t, shingle)
                    own = np.unique(hashes)
                    fps.append(majority_bits(hashes))
                    sigs.append(xxh64_intdigest(own.tobytes(), SEED))
                    keys.append(band_keys(own, a, b).view(np.int64))
                    least.append((own[: 2 * SKETCH] >> np.uint64(32)).astype("<u4")[:SKETCH].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("rid"), part.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(sigs, np.uint64).view(np.int64)),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(least, pa.binary())],
                    ["rid", "id", "fp", "sig", "keys", "least"],
                )

    return docs.select("rid", "id", "text").mapInArrow(run, f"rid long, id {kind}, fp long, sig long, keys array<long>, least binary")


def jaccard(x: bytes, y: bytes) -> float:
    """Similarity of two sets from their SKETCH least hashes: exact for sets of fewer, else an estimate from the least of their union."""
    a, b = np.unique(np.frombuffer(x, "<u4")), np.unique(np.frombuffer(y, "<u4"))
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)
    if max(len(a), len(b)) >= SKETCH:
        union = union[:SKETCH]
    return float(np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).size / len(union))


def _sketched(pairs: DataFrame, sets: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs (u, v) of sig with the least hashes x and y of both; only the sets in pairs bring their hashes."""
    wanted = pairs.select(F.col("u").alias("sig")).unionByName(pairs.select(F.col("v").alias("sig"))).distinct()
    least = shared_table(marked.select("rid", "least").join(sets.select("sig", "rid").join(wanted, "sig", "left_semi"), "rid").select("sig", "least"))
    return pairs.join(least.select(F.col("sig").alias("u"), F.col("least").alias("x")), "u").join(least.select(F.col("sig").alias("v"), F.col("least").alias("y")), "v")


def _verified(pairs: DataFrame, sets: DataFrame, marked: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of sig that are similar. Sets of which one is larger than a sketch are compared whole."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            large = np.array([max(len(x), len(y)) >= 4 * SKETCH for x, y in zip(xs, ys, strict=True)], bool)
            near = np.array([jaccard(x, y) for x, y in zip(xs, ys, strict=True)])
            good = pa.array(near >= np.where(large, similarity - MARGIN, similarity))
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(good), batch.column("v").filter(good), pa.array(large).filter(good)], ["u", "v", "large"])

    judged = shared_table(_sketched(pairs, sets, marked).select("u", "v", "x", "y").mapInArrow(judge, "u long, v long, large boolean"))
    sure, unsure = judged.where("not large").select("u", "v"), judged.where("large").select("u", "v")
    if unsure.isEmpty():
        return sure
    wanted = unsure.select(F.col("u").alias("sig")).unionByName(unsure.select(F.col("v").alias("sig"))).distinct()
    return sure.unionByName(_compared(unsure, shared_table(_whole(sets, wanted, texts, shingle)), similarity))


def _compared(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) of sig whose whole sets are similar. whole: sig, hashes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = np.intersect1d(a, b, assume_unique=True).size
                good.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good, pa.bool_())) for c in ("u", "v")], ["u", "v"])

    own = pairs.join(whole.select(F.col("sig").alias("u"), F.col("hashes").alias("x")), "u").join(whole.select(F.col("sig").alias("v"), F.col("hashes").alias("y")), "v")
    return own.select("u", "v", "x", "y").mapInArrow(compare, "u long, v long")


def _whole(sets: DataFrame, wanted: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """sig and hashes, all distinct hashes of the set, of the sets in wanted (sig). texts: rid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                own = [np.unique(shingle_hashes(t, shingle)).astype("<u8").tobytes() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("sig"), pa.array(own, pa.binary())], ["sig", "hashes"])

    rids = sets.select("sig", "rid").join(wanted, "sig", "left_semi")
    return texts.join(rids, "rid").select("sig", "text").mapInArrow(run, "sig long, hashes binary")


def _prefix_pairs(unsettled: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """Pairs (u, v) among the sets of unsettled (sig, root) that may reach the similarity s and have different roots; none that does is left out.

    A set of n shingles shares at least s n of them with one that is similar and no larger, and at least 2 s n / (1 + s) with one that is no
    smaller. So two similar sets share one of the first n + 1 less so many of each, in any order common to all. Shingles are
    ordered by the number of sets they are in, so those of a passage that many sets share come last. Shingles of one set alone come
    first and are counted only.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sig, data in zip(batch.column("sig").to_pylist(), batch.column("hashes").to_pylist(), strict=True):
                own = np.frombuffer(data, "<u8").view(np.int64)
                for k in range(0, len(own), 1 << 16):
                    part = own[k : k + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), sig)), pa.array(np.full(len(part), len(own))), pa.array(part)], ["sig", "n", "h"])

    own = whole.join(unsettled.select("sig"), "sig", "left_semi")
    spelled = shared_table(own.mapInArrow(spread, "sig long, n long, h long"))
    often = spelled.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ranked = spelled.join(often.hint("merge"), "h").groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own"))
    prefix = lambda share: F.greatest(F.lit(0), F.size("own") - (F.ceil(F.col("n") * share - 1e-9) - 1)).cast("int")
    short = prefix(2 * similarity / (1 + similarity))
    placed = ranked.select("sig", "n", F.size("own").alias("c"), short.alias("short"), F.posexplode(F.slice("own", 1, prefix(similarity))).alias("i", "s"))
    first = shared_table(placed.select("sig", "n", "c", "i", (F.col("i") < F.col("short")).alias("inner"), F.col("s.h").alias("h")).join(unsettled, "sig"))
    other = first.where("inner").select("h", F.col("sig").alias("v"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("i").alias("j"), F.col("root").alias("r"))
    # what two sets with a shingle at places i and j can share at most: as much before and after it as the shorter side has
    most = F.least("i", "j") + 1 + F.least(F.col("c") - F.col("i") - 1, F.col("d") - F.col("j") - 1)
    enough = most >= (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-9
    larger = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("sig") > F.col("v")))
    alike = larger & (F.col("root") != F.col("r")) & (F.col("m") >= F.col("n") * similarity - 1e-9) & enough
    met = first.join(other.hint("merge"), (first["h"] == other["h"]) & alike)
    return met.select(F.least("sig", "v").alias("u"), F.greatest("sig", "v").alias("v")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, max_bits: int = 2) -> DataFrame:
    """Returns _row (the row of docs), component_id (the least id of the row's group) and stays (one row of each group).

    Rows with the same set of shingles meet in its hash, so only distinct sets are compared. Ids may repeat or be null: rows are
    told apart by an id of the written copy of docs.
    """

    def kept(df: DataFrame) -> DataFrame:
        """A shared table; the shuffle files behind it go."""
        made = shared_table(df)
        release(docs.sparkSession)
        return made

    rows = shared_table(pack(docs).withColumn("rid", F.monotonically_increasing_id()))
    texts = rows.select("rid", F.col("_row").getField(text).alias("text"))
    marked = shared_table(sketches(rows.select("rid", F.col("_row").getField(id_col).alias("id"), F.col("_row").getField(text).alias("text")), shingle))
    first_row = F.min_by("rid", F.struct(F.col("id").isNull(), "id", "rid")).alias("head")
    sets = kept(marked.groupBy("sig").agg(F.min("rid").alias("rid"), F.min("id").alias("id"), first_row, F.min_by(F.struct("fp", "keys"), "rid").alias("s")).select("sig", "rid", "id", "head", "s.*"))
    bands = sets.select("sig", F.explode("keys").alias("key"))  # a key tells its band
    sizes = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("sig").alias("first")).where("n > 1")
    members = kept(bands.join(sizes.hint("merge"), "key"))
    degree = shared_table(members.groupBy("sig").agg(F.sum("n").alias("degree")))
    hubs = kept(members.join(degree.hint("merge"), "sig").groupBy("key").agg(F.max_by("sig", F.struct("degree", "sig")).alias("hub")))
    stars = members.join(hubs.hint("merge"), "key").select("sig", F.explode(F.array("hub", "first")).alias("other"))
    small = members.where((F.col("n") > 2) & (F.col("n") <= MAX_BUCKET)).groupBy("key").agg(F.collect_list("sig").alias("sigs"))
    few = small.select(F.explode("sigs").alias("sig"), "sigs").select("sig", F.explode("sigs").alias("other"))
    by_fp = kept(sets.groupBy("fp").agg(F.min("sig").alias("first")))
    near = kept(links(by_fp.select("fp"), max_bits))
    same_fp = sets.select("sig", "fp").join(by_fp, "fp").select("sig", F.col("first").alias("other"))
    first = by_fp.select(F.col("fp").alias("f"), F.col("first").alias("s"))
    near = near.join(first, F.col("u") == F.col("f")).select("v", F.col("s").alias("sig")).join(first, F.col("v") == F.col("f")).select("sig", F.col("s").alias("other"))
    met = stars.unionByName(few).unionByName(same_fp).unionByName(near).where("sig <> other")
    pairs = kept(met.select(F.least("sig", "other").alias("u"), F.greatest("sig", "other").alias("v")).distinct())
    found = kept(_verified(pairs, sets, marked, texts, shingle, similarity))
    roots = shared_table(connected_components(found))
    # buckets whose members these links do not make one group: their members are compared whatever the buckets' size
    by_fp_too = sets.select("sig", F.xxhash64("fp", F.lit(-1)).alias("key"))
    large = shared_table(members.where(F.col("n") > MAX_BUCKET).select("sig", "key").unionByName(by_fp_too))

    def still_open(roots: DataFrame) -> DataFrame:
        """key, sig, root of the buckets that hold several groups."""
        rooted = shared_table(large.join(roots, F.col("sig") == F.col("node"), "left").select("sig", "key", F.coalesce("root", "sig").alias("root")))
        apart = shared_table(rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key"))
        found = kept(rooted.join(apart.hint("merge"), "key"))
        drop_shared(rooted, apart)
        return found

    left = still_open(roots)
    if not left.isEmpty():
        whole = kept(_whole(sets, left.select("sig").distinct(), texts, shingle))
        for k in range(STAR_ROUNDS):
            one = shared_table(left.groupBy("key").agg(F.max_by(F.struct("sig", "root"), F.xxhash64("sig", F.lit(k))).alias("h")))
            apart = left.join(one.hint("merge"), "key").where(F.col("root") != F.col("h.root"))
            some = shared_table(apart.select(F.least("sig", "h.sig").alias("u"), F.greatest("sig", "h.sig").alias("v")).distinct())
            found = found.unionByName(shared_table(_compared(some, whole, similarity)))
            roots = shared_table(connected_components(found))
            drop_shared(left)
            left = still_open(roots)
            if left.isEmpty():
                break
        unsettled = kept(left.select("sig", "root").distinct())
        if not unsettled.isEmpty():
            more = kept(_prefix_pairs(unsettled, whole, similarity))
            found = found.unionByName(kept(_compared(more, whole, similarity)))
            roots = shared_table(connected_components(found))
        drop_shared(whole)
    grouped = sets.select("sig", "id", "head").join(roots.hint("merge"), F.col("sig") == F.col("node"), "left").select("sig", "id", "head", F.coalesce("root", "sig").alias("root"))
    heads = shared_table(grouped.groupBy("root").agg(F.min("id").alias("component_id"), F.min_by("head", F.struct(F.col("id").isNull(), "id", "head")).alias("head")))
    told = shared_table(grouped.select("sig", "root").join(heads.hint("merge"), "root").select("sig", "component_id", "head"))
    chosen = kept(marked.select("rid", "sig").join(told.hint("merge"), "sig").select("rid", "component_id", (F.col("rid") == F.col("head")).alias("stays")))
    drop_shared(marked, sets, members, degree, hubs, by_fp, pairs, large, left, heads, told)
    # dealt out at every size alike: what this costs is in proportion to the texts
    return rows.join(chosen.hint("merge"), "rid").select("_row", "component_id", "stays")
