"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import gzip
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, chat, decontaminate, langid, lm, quality, simhash, toxicity, warc, wrappers
from quarry.llm.common import unpack
from quarry.plans.components import connected_components

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, _row string, ids string, sig string, text2 string"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b", "en", "a"), (4, LONG, "en", "a"), (5, "one two three four five six seven eight nine ten", "en", "b"),
    (5, "one two three four five six seven eight nine ten", "en", "b"), (None, "eins zwei drei vier acht", "de", None), (None, None, None, "b"), (7, "ß é x 漢字 <|endoftext|> 😀", "fr", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0, "k", "s", "r", "i", "g", "t") for r in ODD], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(odd, none):
    rows = quality.quality_rules(odd)
    out = {r["_row"]["doc_id"]: r for r in rows.collect()}
    assert rows.count() == len(ODD) and unpack(rows.where("kept")).columns == odd.columns
    assert out[1]["n_words"] == 0 and out[1]["base_failed"] and out[5]["n_words"] == 10
    assert out[4]["n_repeat_words"] == out[4]["n_words"] and out[4]["base_failed"]
    assert quality.quality_rules(none).count() == 0


def test_quality_rejects_a_failing_host(spark):
    good = " ".join(f"w{k}" for k in range(30))
    rows = [(k, good if k % 20 == 0 else "bad", "bad.org") for k in range(200)] + [(1000 + k, good, f"h{k % 9}") for k in range(180)] + [(5000, "x", "h1"), (5001, good, None)]
    out = {r["_row"]["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not out[0]["kept"] and not out[0]["base_failed"] and out[1000]["kept"] and not out[5000]["kept"] and out[5001]["kept"]


def covered(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


def test_repeated_windows_by_brute_force(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    for r in quality.quality_rules(rows).collect():
        assert r["n_repeat_words"] == covered(r["_row"]["text"].split())


def test_bpe_edges(odd, none):
    t = Tokenizer.from_file(BPE)
    rows = bpe.bpe_encode(odd, BPE).collect()
    assert len(rows) == len(ODD)
    texts = sorted(t.decode(t.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in ODD)
    assert sorted(r["decoded"] for r in rows) == texts
    assert bpe.bpe_encode(none, BPE).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\ttheain's12")), max_size=40))
def test_bpe_is_the_library(text):
    own, t = bpe.tokenizer(BPE), Tokenizer.from_file(BPE) if not hasattr(test_bpe_is_the_library, "t") else test_bpe_is_the_library.t
    test_bpe_is_the_library.t = t
    ids = np.frombuffer(own.encode(text), "<u4")
    want = t.encode(text, add_special_tokens=False).ids
    # letters that are newer than one side's Unicode tables may be cut elsewhere; the text comes back all the same
    assert own.decode(ids) == text
    if all(ord(c) < 0x3000 for c in text):
        assert ids.tolist() == want


def test_small_automaton_follows_the_merges():
    letters = {bytes([b]): b for b in range(256)}
    merges = [(b"a", b"a"), (b"aa", b"b"), (b"b", b"a"), (b"aa", b"aa"), (b"aab", b"ba"), (b"c", b"aa"), (b"ba", b"c")]
    vocab = dict(letters)
    for u, v in merges:
        vocab[u + v] = len(vocab)
    auto = bpe.Automaton(vocab, merges)

    def plain(word):
        parts = [bytes([b]) for b in word]
        for u, v in merges:
            i = 0
            while i < len(parts) - 1:
                if parts[i] == u and parts[i + 1] == v:
                    parts[i : i + 2] = [u + v]
                i += 1
        return [vocab[p] for p in parts]

    rnd = random.Random(2)
    for _ in range(2000):
        word = bytes(rnd.choice(b"aabc") for _ in range(rnd.randint(1, 14)))
        assert np.frombuffer(auto.encode(word), "<u4").tolist() == plain(word)


def test_lm_edges(odd, none):
    rows = lm.lm_score(odd, F.lit(True)).collect()
    assert len(rows) == len(ODD) and min(r["n_tokens"] for r in rows) == 1
    assert lm.lm_score(none, F.lit(True)).count() == 0
    untaught = lm.lm_score(odd, F.lit(False)).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0 for r in untaught)


def _plain_symbols(text, words):
    """(spelled, leaf, contexts) of each symbol, and the log10 shares within the classes."""
    out, share, before, marks = [], 0.0, lm.PREVIOUS + words.classes, [lm.LANDMARKS, lm.LANDMARKS]
    for w in [*(text or "").encode().lower().split(), b"\n"]:
        k = words.word.get(w)
        kind = words.class_of(w) if k is None else int(words.of[k])
        pair = int(lm.mixed(np.array([marks[-1] * 1000 + marks[-2] + 1], np.uint64))[0]) >> 20
        out.append((0, int(words.leaf[kind]), [before, words.firsts[1] + marks[-1], words.firsts[2] + pair % words.rows]))
        share += float(words.escape[kind] if k is None else words.share[k])
        if k is None:
            out += _spelled(words, w, kind)
        before = lm.PREVIOUS + kind if k is None or k >= lm.PREVIOUS else k
        if k and k < lm.LANDMARKS:
            marks.append(k)
    return out, share


def _spelled(words, w, kind):
    back, out = w[::-1], []
    for k in range(min(2, len(w)) if lm.SINGLES <= kind < lm.SINGLES + lm.SUFFIXES else 0, len(w) + 1):
        contexts = [(o, back[k - o : k]) if k >= o else (o, back[:k], kind) for o in lm.ORDERS[:2]] + [(0, back[max(0, k - lm.WORD_BYTES) : k], kind)]
        out.append((1, int(words.bytes.where[(back[k - 1] if k else 32) << 8 | (back + b" ")[k]]), contexts))
    return out


def _path(code, leaf):
    n, bits = int(code.lengths[leaf]), int(code.codes[leaf])
    return [(d, bits >> (32 - d), (bits >> (31 - d)) & 1) for d in range(n)]


def _plain_model(texts, words):
    """Counts of every (context, depth, path) in dictionaries, and of the rows."""
    seen, rows, counts = collections.defaultdict(lambda: [0, 0]), collections.Counter(), collections.Counter()
    for t in texts:
        counts.update((t or "").encode().lower().split())
        for spelled, leaf, contexts in _plain_symbols(t, words)[0]:
            if not spelled:
                rows.update(contexts)
                for c in contexts:
                    for d, node, bit in _path(words.code, leaf):
                        seen[0, c, d, node][bit] += 1
    for w, n in counts.items():
        for _, leaf, contexts in _spelled(words, w, words.class_of(w)):
            for c in contexts:
                for d, node, bit in _path(words.bytes, leaf):
                    seen[1, c, leaf >> 8, d, node][bit] += 1 if w in words.word else n
    return seen, rows


def _plain_score(text, words, seen, rows):
    step = lambda p: max(-127, min(127, round(math.log(p / (1 - p)) * lm.STEP)))
    symbols, total = _plain_symbols(text, words)
    decisions = ([], [])
    for spelled, leaf, contexts in symbols:
        code = words.bytes if spelled else words.code
        for d, node, bit in _path(code, leaf):
            prior = float(code.prior[code.first[leaf] + d])
            own, known = [step(prior)] if spelled else [], []
            for c in contexts:
                zero, one = seen.get((1, c, leaf >> 8, d, node) if spelled else (0, c, d, node), (0, 0))
                known.append(zero + one > 0)
                own.append(step((one + lm.STRENGTH[spelled] * prior) / (zero + one + lm.STRENGTH[spelled])) if known[-1] else 0 if spelled else step(prior))
            if spelled:
                gates = lm.BYTE_GATES[4 if known[2] and abs(own[3]) >= lm.SURE * lm.STEP else sum(known)]
            else:
                gates = lm.CLASS_GATES[3 * sum(rows[contexts[0]] >= n for n in lm.SEEN) + sum(rows[contexts[2]] >= n for n in lm.SEEN)]
            decisions[spelled].append((bit, [max(-127, min(127, round(o * g))) / lm.STEP for o, g in zip(own, gates)]))
    for own in decisions:
        weights, cells = [1.0] * (len(own[0][1]) if own else 0), [1 / (1 + math.exp(-(k - 16) / 2)) for k in range(lm.CELLS)]
        for t in range(0, len(own), lm.STRIDE):
            moves = []
            for bit, x in own[t : t + lm.STRIDE]:
                dot = max(-7.9, min(7.9, sum(w * v for w, v in zip(weights, x))))
                p = 1 / (1 + math.exp(-dot))
                near = round(dot * 2) + 16
                q = min(1 - 1e-5, max(1e-5, 0.7 * p + 0.3 * cells[near]))
                total += math.log10(q if bit else 1 - q)
                moves.append((near, cells[near] + lm.MAP_RATE * (bit - cells[near]), [v * (bit - p) * lm.RATE for v in x]))
            for near, cell, move in moves:
                cells[near] = cell
                weights = [w + v for w, v in zip(weights, move)]
    return total


def test_lm_is_its_plain_version(spark, monkeypatch):
    """Classes, tables, contexts, mixing and the map by dictionaries and loops."""
    for name, value in (("HEAVY", 60), ("SINGLES", 12), ("SUFFIXES", 9), ("PREVIOUS", 30), ("LANDMARKS", 8), ("LEAST_BITS", 22), ("SEEN", (20, 60))):
        monkeypatch.setattr(lm, name, value)
    monkeypatch.setattr(lm, "NOTHING", (-1, 8, 8))
    rnd = random.Random(5)
    stems = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6))) for _ in range(90)]
    texts = [" ".join(rnd.choice(stems[: rnd.choice((6, 30, 90))]) for _ in range(rnd.randint(1, 60))) for _ in range(120)] + ["", None]
    words, rows, seen, table = _learned(spark, texts, monkeypatch)
    model = lm.Model(words, rows, seen, table)
    counted, often = _plain_model(texts, model.words)
    fresh = ["", texts[3], "zz " + texts[4] + " qqabcabc", "x" * 50, " ".join(stems)]
    got = lm.score_texts(fresh, model)["score"]
    want = [_plain_score(t, model.words, counted, often) for t in fresh]
    assert np.allclose(got, want, rtol=2e-3, atol=0.02)


def _learned(spark, texts, monkeypatch):
    """As lm.learn, in one process (the workers do not see what a test sets)."""
    counts = collections.Counter()
    for t in texts:
        counts.update([*lm.word_bytes(t), lm.END])
    top = dict(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[: lm.HEAVY])
    suffixes = {}
    for w, n in counts.items():
        a, b = suffixes.get(w[-2:], (0, 0))
        suffixes[w[-2:]] = (a + n, b + (n == 1))
    words = lm.Words(top, suffixes, sum(counts.values()))
    s = lm.symbols(words, [[*lm.word_bytes(t), lm.END] for t in texts], [lm.NOTHING] * len(texts))
    keys, n = lm._summed((s.rows * words.classes + words.leaf[s.kind][:, None]).ravel().astype(np.uint64), np.ones(s.rows.size, np.float32))
    rows, seen = lm.class_rows(keys, n, words, 0, int(words.firsts[-1]))
    pairs = lm.Pairs()
    for w, k in counts.items():
        if w != lm.END:
            leaf, contexts, _ = lm.byte_contexts(words, [w], np.array([words.class_of(w)]))
            pairs.add((contexts << np.uint64(lm.LEAF_BITS) | leaf.astype(np.uint64)[:, None]).T.ravel(), np.full(3 * len(leaf), 1 if w in words.word else k, np.float32))
    keys, n = pairs.compact()
    place = (keys >> np.uint64(64 - lm.PLACE_BITS)).astype(int)
    table = np.concatenate([lm.place_table(keys[place == p], n[place == p], words.bytes, lm.STRENGTH[1], lm.LEAST_BITS) for p in range(1 << lm.PLACE_BITS)])
    return words, rows.ravel(), np.searchsorted(lm.SEEN, seen, "right").astype(np.uint8), table


def test_lm_learns_the_same_in_tasks(spark):
    """Tables of several tasks and two rounds of merging are those of one process."""
    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 5))) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "LEAST_BITS", int(np.ceil(np.log2(64 * len({w for t in texts for w in t.split()} | {"end"})))))
        words, rows, seen, table = _learned(spark, texts, patch)
    model, _ = lm.learn(spark.createDataFrame([(t,) for t in texts], "text string").repartition(40))
    assert (model.words.share == words.share).all() and (model.rows == rows).all() and (model.seen == seen).all()
    assert len(model.table) == len(table) and (model.table == table).mean() > 0.999  # of decisions that meet and are as frequent, either stays


def test_lm_is_a_distribution(spark):
    """Over all classes, over all words of a class and over what may follow, probabilities add up to one."""
    model, _ = lm.learn(spark.createDataFrame([("a b a c a b ab cab abb ba bab",)] * 9 + [("b a xy",)], "text string"))
    words = model.words
    assert (2.0 ** -words.code.lengths.astype(float)).sum() == pytest.approx(1)
    assert (2.0 ** -words.bytes.lengths.astype(float)).reshape(256, 256).sum(1) == pytest.approx(1)
    inside = np.bincount(words.of[words.log > 0], 10 ** words.share[:-1][words.log > 0], words.classes)
    shared = np.arange(words.classes) >= lm.SINGLES
    assert (inside[shared] + 10 ** words.escape[shared])[inside[shared] > 0] == pytest.approx(1)
    total = 0.0
    for k in range(words.classes):
        s = lm.Symbols(np.array([0]), np.array([k]), np.array([[0, words.firsts[1], words.firsts[2]]]), [], lm.NOTHING)
        x = model.classes(s)[0]
        total += math.exp(lm.mix(x, np.array([len(x)]))[0])
    assert total == pytest.approx(1, abs=0.05)
    one = lm.score_texts(["a b"], model)["score"][0]
    assert lm.score_texts(["x" * 10, "a b", "q"], model)["score"][1] == pytest.approx(one)


def test_links_in_small_and_large_buckets(spark, monkeypatch):
    rnd = random.Random(3)
    fps = {rnd.getrandbits(64) for _ in range(20)}
    for base in list(fps)[:4]:
        for _ in range(40):
            fps.add(base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3))))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for bits in (0, 1, 2):
        root = {x: x for x in signed}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in signed:
            for b in signed:
                if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= bits:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        got = {r["node"]: r["root"] for r in connected_components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bits)).collect()}
        assert all(got.get(x, x) == find(x) for x in signed)


def test_near_duplicates_edges(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1} and {r["component_id"] for r in rows if r["doc_id"] == 5} == {5}
    assert simhash.near_duplicates(none).count() == 0


def test_similar_groups(spark, odd, none):
    out = simhash.similar_groups(odd)
    assert unpack(out).columns == odd.columns and out.count() == len(ODD) and simhash.similar_groups(none).count() == 0
    rnd = random.Random(4)
    texts, base = [], [[f"w{rnd.randrange(5000)}" for _ in range(120)] for _ in range(12)]
    for k in range(150):
        words = list(base[k % 12])
        for _ in range(rnd.randint(0, 6)):
            words[rnd.randrange(len(words))] = f"v{rnd.randrange(9999)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["_row"]["doc_id"]: r["component_id"] for r in rows} == {k: find(k) for k in range(len(texts))}
    assert {r["_row"]["doc_id"] for r in rows if r["stays"]} == {find(k) for k in range(len(texts))}


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_by_brute_force():
    rnd = random.Random(5)
    word = lambda n: decontaminate.folded("".join(rnd.choice("abcdefgh ijkl") for _ in range(n)))
    index = decontaminate.Index([(k, word(n)) for k, n in enumerate([4, 30, 60, 90, 150, 210, 430])])
    for _ in range(60):
        k = rnd.randrange(1, 7)
        s = list(index.items[k][1])
        for _ in range(rnd.randint(0, len(s) // 7)):
            at = rnd.randrange(len(s))
            s[at : at + rnd.randint(0, 1)] = rnd.choice(["", "z", "y"])
        text = decontaminate.folded(word(rnd.randint(0, 150)) + "".join(s) + word(rnd.randint(0, 150)))
        got = {f[0] for f in index.search(text)}
        want = {p[0] for p in index.built[0] if distance("".join(map(chr, p[2].tolist())), text) <= p[3]}
        assert got - {0} == want


def test_decontamination_edges(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five"), (3, "one two three four five"), (4, "x")], "item_id long, text string")
    rows = {r["_row"]["doc_id"]: r["leaks"] for r in decontaminate.leaks(odd, items).collect()}
    assert {x["item_id"] for x in rows[5]} == {3} and rows[1] == [] and rows[2] == []
    assert decontaminate.leaks(none, items).count() == 0
    assert all(not r["leaks"] for r in decontaminate.leaks(odd, items.limit(0)).collect())


def test_forward_sums_all_segmentations():
    keys, pieces = langid.vocabulary(PIECES)
    rnd = np.random.default_rng(6)
    probs = rnd.random((len(keys), 2))
    probs /= probs.sum(0)
    at = {p: k for k, p in enumerate(pieces)}

    def brute(word, g):
        total = [1.0] + [0.0] * len(word)
        for end in range(1, len(word) + 1):
            total[end] = sum(total[s] * probs[at[word[s:end]], g] for s in range(end) if word[s:end] in at)
        return np.log(total[-1])

    words = [b" the", b" nation", "été".encode(), b" a", b" und", b" thethethethe"]
    got = langid.forward(words, keys, probs)
    assert np.allclose(got, [[brute(w, g) for g in range(2)] for w in words])
    assert np.isfinite(langid.forward([b"ab" * 5000], keys, probs)).all()


def test_language_edges(odd, none):
    rows = {r["_row"]["doc_id"]: r for r in langid.identify(odd, PIECES, F.lit(True), keep_text=True).collect()}
    assert rows[1]["lang_pred"] == "und" and rows[2]["lang_pred"] == "und" and rows[2]["score"] == 0 and rows[5]["lang_pred"] == "en"
    assert langid.identify(none, PIECES, F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, PIECES, F.lit(False)).collect()} == {"und"}


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_warc_ranges(spark, size):
    rnd = random.Random(7)
    noise = lambda n: "".join(chr(rnd.randrange(32, 1000)) for _ in range(n))
    rows = [(1, "http://a", "x" * 10), (2, "http://b", "x" * 10), (2, "http://b", "x" * 10), (3, None, None), (4, "u v", ""), (None, "http://c", "x" * 10), (5, "d", noise(3000)), (6, "e", "\x1f\x8b\x08 plain")]
    folder = warc.archive_folder(spark)
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = warc.read_warc(spark, folder, size).collect()
    kinds = sorted((r["page"] or 0, r["type"], r["refers_to"], r["size"]) for r in got if r["page"] not in (3, 4, 5))
    assert kinds == [(0, "revisit", 2, 10), (1, "revisit", 2, 10), (2, "response", None, 10), (2, "response", None, 10), (6, "response", None, len("\x1f\x8b\x08 plain".encode()))]
    assert {(r["page"], r["type"], r["refers_to"]) for r in got if r["page"] in (3, 4)} == {(3, "revisit", 4), (4, "response", None)}
    assert next(bytes(r["payload"]) for r in got if r["page"] == 5).decode() == rows[6][2]
    for path in {r["file"] for r in got}:
        data = gzip.open(path.removeprefix("file:").replace("//", "/"), "rb").read()
        assert data.count(b"WARC/1.1\r\n") == sum(r["file"] == path for r in got)
    assert {tuple(r)[1:8] for r in warc.read_warc(spark, folder, whole=True).collect()} == {tuple(r)[1:8] for r in got}


def test_warc_empty(spark):
    folder = warc.archive_folder(spark)
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_warc(spark, folder).count() == 0


def test_chat(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 5000, "ann", "bye"), (1, 5000, "ann", "bye"), (2, None, None, "x"), (3, 1, "system", "only")]
    out = chat.perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    own = sorted((r for r in out if r["conv_id"] == 1 and r["perspective"] == "ann"), key=lambda r: r["seq"])
    whole = "".join(r["rendered"] for r in own)
    assert whole.startswith("<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user\nbob: <|im_end|>\n")
    assert [r["seq"] for r in own] == list(range(5))
    assert [whole[r["train_start"] : r["train_end"]] for r in own if r["train_start"] is not None] == ["hi<|im_end|>", "bye<|im_end|>", "bye<|im_end|>"]
    assert {r["perspective"] for r in out if r["conv_id"] == 2} == {"unknown"} and not [r for r in out if r["conv_id"] == 3]
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


PAGE = """<html><head><title>t</title><style>x</style></head><body><header><a href=/>Site</a></header><div class="cookie-notice">We use cookies</div><nav><ul><li><a>A</a></ul></nav>
<div id="content"><h1>T &amp; {0}</h1><p>One  {0}<br>three<p>Four <b>bold</b> <a href=q>link</a>.<ul><li>a<li>b</ul><p>Share this</p><div class="comments"><p>bad {0}</div></div>
<ul><li><a href=1>Next {0}</a></li><li><a href=2>More</a></li><li><a href=3>Else</a></li></ul><aside>side</aside><form><p>sub</form><script>var a="<p>no</p>"</script><footer>f</footer></body>"""


def test_wrappers(spark):
    rows = [(k, f"http://h.org/{k}", PAGE.format(f"w{k}")) for k in range(8)] + [(100, "http://one.org", "plain &lt;text&gt;"), (101, None, None), (102, "http://e.org", "")]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, wrapper string")
    got = {r["_row"]["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert got[3] == "T & w3\nOne w3 three\nFour bold link.\na\nb\nShare this" or got[3] == "T & w3\nOne w3 three\nFour bold link.\na\nb"
    assert got[100] == "plain <text>" and got[101] == "" and got[102] == ""
    assert wrappers.main_text(pages.limit(0)).count() == 0


def test_wrapper_is_union_free():
    items = wrappers.infer(["<ul><li>a</li></ul><p>same</p>", "<ul><li>b</li><li>c</li></ul><h2>x</h2><p>same</p>"])[3]
    assert [(i[0], i[1], i[2]) for i in items] == [("ul", False, False), ("h2", True, False), ("p", False, False)]
    assert items[0][3][0][:3] == ["li", False, True] and items[0][3][0][3][0][3] is None and items[2][3][0][3] == wrappers.xxh32_intdigest("same")


def test_toxicity_folds_and_exceptions():
    assert toxicity.folded("1d10t m0r0n5 idiоt ｉｄｉｏｔ $cum THE!!") == " idiot morons idiot idiot scum the "
    auto = toxicity.Lexicon({" idiot ": 3.0, " low": 2.0}, {" village idiot "}).automaton()
    assert [t[2] for t in toxicity.hits(" an idiot ", auto)] == [3.0] and toxicity.hits(" village idiot ", auto) == [] and toxicity.hits(" slow ", auto) == []


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (4, None), (5, 1), (5, 1), (None, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(odd, labels, F.lit(True))
    rows = toxicity.score_toxicity(odd, lexicon).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_toxicity(none, toxicity.learn_lexicon(none, labels, F.lit(True))).count() == 0


def grouped(texts):
    """Least position of each text's group, by brute force over five-word shingles at a similarity of 0.8."""
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in range(len(texts))}


def test_similar_groups_of_a_template_family(spark):
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**6)}"
    template = [word() for _ in range(80)]
    texts = []
    for _ in range(100):
        own = [word() for _ in range(20)]
        texts.append(" ".join(template + own))
        texts.append(" ".join(template + own[:10] + [word() for _ in range(10)]))
    want = grouped(texts)
    assert len(set(want.values())) == 100
    rows = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["_row"]["doc_id"]: r["component_id"] for r in rows} == want


def test_similar_groups_of_long_texts(spark):
    rnd = random.Random(9)
    texts = []
    for k in range(24):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(1500)]
        other = list(words)
        for at in rnd.sample(range(0, 1500, 5), 29 + k // 4):
            other[at] = "x"
        texts += [" ".join(words), " ".join(other)]
    want = grouped(texts)
    assert 24 < len(set(want.values())) < 48
    rows = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["_row"]["doc_id"]: r["component_id"] for r in rows} == want


def test_decontamination_finds_runs_of_items():
    rnd = random.Random(10)
    word = lambda n: decontaminate.folded("".join(rnd.choice("abcdefghijkl mnopqrstu") for _ in range(n)))
    index = decontaminate.Index([(k, word(n)) for k, n in enumerate([90, 150, 200, 250, 400, 700])])
    for k, (_, item) in enumerate(index.items):
        for size in {decontaminate.RUN, 85, 150, 220}:
            for start in range(0, len(item) - size + 1, 7):
                text = decontaminate.folded(f"{word(100)} {item[start : start + size]} {word(100)}")
                assert k in {f[0] for f in index.search(text)}, (k, size, start)
    assert not any(index.search(word(400)) for _ in range(20))


def test_wrappers_of_hosts_with_copies(spark):
    page = "<body><section><p>Words of the host</p></section><div><h1>Title {0}</h1><p>Body {0}</p></div></body>"
    pages = spark.createDataFrame([(20 * k + c, f"http://h.org/{k}", page.format(k)) for k in range(8) for c in range(20)], "page_id long, url string, html string")
    got = {r["_row"]["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert got == {20 * k + c: f"Title {k}\nBody {k}" for k in range(8) for c in range(20)}


def test_lm_long_texts_in_parts(spark, monkeypatch):
    rnd = random.Random(11)
    texts = ["a b", "x" * 9000, " ".join("".join(rnd.choice("abcdef") for _ in range(40)) for _ in range(700)), "a " + "yz" * 3000 + " b", ""]
    model, _ = lm.learn(spark.createDataFrame([("a b xx yz abc",), ("a c",)], "text string"))
    want = lm.score_texts(texts, model)
    monkeypatch.setattr(lm, "PART", 1000)
    monkeypatch.setattr(lm, "TOGETHER", 10_000)
    got = lm.score_texts(texts, model)
    for k in (0, 4):
        assert got["score"][k] == pytest.approx(want["score"][k])
    assert got["score"] == pytest.approx(want["score"], rel=0.1)  # segments begin anew with each part
    for c in ("n_tokens", "n_bytes", "known"):
        assert got[c] == want[c]
    assert list(map(sorted, got["rare"])) == list(map(sorted, want["rare"]))
    assert got["base"] == pytest.approx(want["base"])


def test_lm_words_are_found_as_in_a_dictionary():
    """Short and long words, such as end with zero bytes, and many that are not there, side by side; blocks come back as they were."""
    rnd = random.Random(12)
    word = lambda: bytes(rnd.choice(b"ab\0\x0f\x10\xc3") for _ in range(rnd.randint(1, 20)))
    names = [lm.END, *{word() for _ in range(5000)}]
    number = {w: k for k, w in enumerate(names)}
    asked = [*names, *(word() for _ in range(20_000)), b"\0", b"a\0", b"\0" * 16, b"x" * 40]
    joined = [b"  ".join([lm.MARK if w == lm.END else w for w in asked]), b"", b"\n \t", b"a"]
    found = lm.Lexicon(names).find(lm.cut(joined))
    assert found.tolist() == [number.get(w, -1) for w in [*asked, b"a"]]
    keys, n = np.array([3, 1 << 40, (1 << 64) - 1], np.uint64), np.array([1, 2.5, 1e9], np.float32)
    back = lm.unblocked(lm.block(0, 0, keys, n).column("data")[0].as_py())
    assert (back[0] == keys).all() and (back[1] == n).all()


def test_lm_long_words_that_end_with_a_frequent_one(spark, monkeypatch):
    """A word that is spelled in pieces counts as a whole, whatever its last piece is."""
    model, _ = lm.learn(spark.createDataFrame([("a b xx yz abc " + "x" * 1001,), ("a c",)], "text string"))
    monkeypatch.setattr(lm, "PART", 1000)
    texts = ["y" * 1000 + "a b", "x" * 1001 + " b"]
    got = lm.score_texts(texts, model)
    assert got["n_tokens"] == [3, 3]
    assert got["rare"] == [[b"y" * 1000 + b"a"], [b"x" * 1001]]  # which meet their counts in the join
    assert got["known"] == [2, 2]  # b and the end


SOUP = "<body><div><div><a href=/>Home</a> <a href=/x>More {0}</a></div></div><div>Buy {1} now</div><div><div><h1>Title {0}</h1><div>One {0} of the text, and it goes on for a while &amp; more.</div><div>Two {0} likewise a longer block of words.</div></div></div><div>Host words</div></body>"


@pytest.mark.parametrize("most", [wrappers.BROADCAST, 0])
def test_wrappers_find_the_article_without_names(spark, most):
    """No article element and no class: what varies between the pages tells."""
    rows = [(k, f"http://s.org/{k}", SOUP.format(k, k % 3)) for k in range(12)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["_row"]["page_id"]: r["text"] for r in wrappers.main_text(pages, broadcast_bytes=most).collect()}
    assert got == {k: f"Title {k}\nOne {k} of the text, and it goes on for a while & more.\nTwo {k} likewise a longer block of words." for k in range(12)}
    assert "Host words" in wrappers.extract(rows[0][2], None)  # one page alone does not tell


def test_wrappers_of_tagged_pages_do_without_their_tags(spark, sf):
    """The test pages with article elements made into nameless ones: the wrappers still find the text of nearly all."""
    def plain(page):
        for tag, new in (("article", "div"), ("nav", "div"), ("footer", "div"), ("aside", "div")):
            page = page.replace(f"<{tag}>", f"<{new}>").replace(f"</{tag}>", f"</{new}>")
        return re.sub(r' class="[^"]*"', "", page)

    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    few = collections.Counter(r["url"].split("/")[2] for r in rows)
    many = [r for r in rows if few[r["url"].split("/")[2]] >= 3]
    want = {r["page_id"]: wrappers.extract(r["html"], None) for r in many}
    pages = spark.createDataFrame([(r["page_id"], r["url"], plain(r["html"])) for r in many], "page_id long, url string, html string")
    got = {r["_row"]["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert len(many) >= 10 and sum(got[k] == want[k] for k in want) >= 0.8 * len(want)


def test_wrappers_of_deep_long_and_repeated_pages(spark):
    deep = "<div>" * 5000 + "<p>In the deep</p>" + "</div>" * 5000 + "<p>After</p>"
    long = "<article>" + "".join(f"<p>P {k}</p><h2>H {k}</h2>" for k in range(4000)) + "</article>"
    rows = [(k, "http://d.org/a", deep) for k in range(7)] + [(10 + k, "http://l.org/a", long) for k in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["_row"]["page_id"]: r["text"] for r in wrappers.main_text(pages).collect()}
    assert all("In the deep" in got[k] for k in range(7))
    assert all(got[10 + k] == "\n".join(f"P {j}\nH {j}" for j in range(4000)) for k in range(3))


def test_wrappers_keep_what_a_word_in_a_class_does_not_mean():
    page = '<article><h1>T</h1><div class="share-price">Price 3</div><p title="a hidden gem">Gem</p><div class="share-buttons">Tweet</div><div hidden>no</div><p>End</p></article>'
    assert wrappers.extract(page, None) == "T\nPrice 3\nGem\nEnd"


def test_wrappers_of_near_copies_keep_their_text(spark):
    """Pages of a host that differ in a word: their common text is no notice of the host."""
    rows = [(k, f"http://c.org/{k}", f"<body><article><p>A text that all of them have.</p><h2>More</h2><div>And this {k}</div></article></body>") for k in range(9)]
    got = {r["_row"]["page_id"]: r["text"] for r in wrappers.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"A text that all of them have.\nMore\nAnd this {k}" for k in range(9)}


def test_warc_of_others_and_damaged(spark, tmp_path):
    """An archive without a manifest: a length that is no number, bytes that only look like a member, a cut member at the end."""
    good = warc.record("response", 1, "http://a", b"one", 3, warc.digest(b"one"), None)
    odd = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:quarry:page:2>\r\nContent-Length: many\r\n\r\nHTTP/1.1 200 OK\r\n\r\ntwo")
    other = gzip.compress(b"no record")
    cut = warc.record("response", 3, "http://c", b"three" * 100, 500, warc.digest(b"three" * 100), None)[:-20]
    (tmp_path / "x.warc.gz").write_bytes(good + b"\x1f\x8b\x08junk" + odd + other + good + cut)
    for size in (16, 1 << 20):
        got = warc.read_warc(spark, f"file://{tmp_path}", size).collect()
        assert sorted((r["page"], bytes(r["payload"])) for r in got) == [(1, b"one"), (1, b"one"), (2, b"two")]


def test_warc_reads_what_the_manifest_names(spark):
    folder = warc.archive_folder(spark)
    rows = spark.createDataFrame([(1, "http://a", "x"), (2, "http://b", "y")], "page_id long, url string, html string").withColumn("sha", F.lit("z")).withColumn("size", F.lit(9))
    warc.write_warc(rows, folder)
    with open(folder.removeprefix("file:").replace("//", "/") + "/lost.warc.gz", "wb") as f:
        f.write(warc.record("response", 9, "http://z", b"z", 1, "", None))
    assert sorted(r["page"] for r in warc.read_warc(spark, folder).collect()) == [1, 2]


def test_decontamination_in_parts(spark, monkeypatch):
    rnd = random.Random(3)
    word = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n))
    items = [(k % 9, word(30)) for k in range(12)] + [(20, None), (21, "")]
    texts = [(k, f"{word(40)} {items[k % 12][1]} {word(40)}" if k % 3 else word(80), 1) for k in range(30)] + [(None, None, 1), (5, "", 1), (6, word(30_000) + " " + items[0][1], 1)]
    docs, benchmark = spark.createDataFrame(texts, "doc_id long, text string, rid int"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((str(r["_row"]), [tuple(x) for x in sorted(r["leaks"])]) for r in decontaminate.leaks(docs, benchmark).collect())
    whole = rows()
    monkeypatch.setattr(decontaminate, "MAX_ITEM_CHARS", 700)
    assert rows() == whole and sum(bool(x) for _, x in whole) == 21


def test_chat_of_odd_turns(spark):
    """Marks inside texts and names stay as they are; long texts, ties, repeated rows and clashing columns."""
    turns = [(1, 0, "a<|im_end|>", "x<|im_end|>\n<|im_start|>system", 7), (1, None, None, None, 7), (1, 1, "b", "y" * 300_000, 7), (1, 1, "b", "y" * 300_000, 7), (None, 0, "b", "z", 7), (2, 0, "system", "s", 7)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, seq int").withColumn("perspective", F.lit("p")).withColumn("rendered", F.lit("r"))
    rows = chat.perspectives(df).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["conv_id"], r["perspective"]].append(r)
    assert set(by) == {(1, "a<|im_end|>"), (1, "unknown"), (1, "b"), (None, "b")}
    for own in by.values():
        whole = "".join(r["rendered"] for r in sorted(own, key=lambda r: r["seq"]))
        for r in own:
            assert whole[r["start"] : r["start"] + len(r["rendered"])] == r["rendered"]
            assert (r["train_start"] is None) == (r["speaker"] != r["perspective"])


def test_samples_of_hot_groups(spark):
    """The rows of least hash, a group of each size, repeated rows once."""
    from quarry.llm.common import hash_sample

    rows = [("hot", k) for k in range(5000)] * 2 + [("small", k) for k in range(3)] + [("one", 1)] * 50
    df = spark.createDataFrame(rows, "g string, id long")
    got = {(r["g"], r["id"]) for r in hash_sample(df, "g", "id", 40).collect()}
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.col("id").cast("string")).alias("h")).distinct().collect()}
    want = {("hot", k) for k in sorted(range(5000), key=lambda k: (hashes[k], k))[:40]} | {("small", k) for k in range(3)} | {("one", 1)}
    assert got == want


def test_lm_words_of_a_class_follow_their_contexts(spark):
    """What word of a class comes depends on the word before it."""
    few = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}th" for k in range(40)]
    texts = [" ".join([*(f"z{(12 * k + j) % 170}" for j in range(12)), "aa" if k % 2 else "bb", few[k % 40]]) for k in range(4000)]
    model, _ = lm.learn(spark.createDataFrame([(t,) for t in texts], "text string"))
    words = [w for w in few if model.words.of[model.words.word[w.encode()]] >= lm.SINGLES]
    assert len(words) > 20
    for w in words[:20]:
        right, wrong = ("aa", "bb") if few.index(w) % 2 else ("bb", "aa")
        a, b, c, d = lm.score_texts([f"{right} {w}", f"{wrong} {w}", right, wrong], model)["score"]
        assert (a - c) - (b - d) > 0.2


def test_lm_words_within_classes_are_their_plain_version(spark):
    """Trees that reach every word, probabilities that add up to one, and odds from counts in dictionaries."""
    rnd = random.Random(8)
    stems = ["".join(rnd.choice("abcdef") for _ in range(rnd.randint(2, 4))) for _ in range(500)]
    texts = [" ".join(rnd.choices(stems[: rnd.choice((200, 500))], k=rnd.randint(0, 40))) for _ in range(800)]
    model, _ = lm.learn(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    words, tree = model.words, model.words.tree

    def leaf_of(w):
        k = words.word.get(w)
        return int(tree.leaf[k - lm.SINGLES if k is not None else len(tree.leaf) - words.classes + words.class_of(w)])

    def path(leaf):
        out, now = [], int(tree.start[leaf])
        while now:
            out.append((now, int(leaf >= now)))
            now = int(tree.below[int(leaf >= now), now])
        return out

    def inside(text):
        """(leaf, contexts) of each word that is in a tree."""
        out = []
        s = lm.symbols(words, [[*lm.word_bytes(text), lm.END]], [lm.NOTHING])
        for w, kind, rows in zip([*lm.word_bytes(text), lm.END], s.kind.tolist(), s.rows.tolist()):
            if kind >= lm.SINGLES:
                out.append((leaf_of(w), [(r, kind) for r in rows]))
        return out

    counts = collections.defaultdict(lambda: [0, 0])
    for t in texts:
        for leaf, contexts in inside(t):
            for node, bit in path(leaf):
                for c in contexts:
                    counts[c, node][bit] += 1
    step = lambda p: max(-127, min(127, round(math.log(p / (1 - p)) * lm.STEP)))
    same = whole = 0
    for t in [*texts[:40], "zzz " + texts[50] + " qqabcabc", ""]:
        s = lm.symbols(words, [[*lm.word_bytes(t), lm.END]], [lm.NOTHING])
        _, leaf, contexts = lm.word_symbols(words, s)
        got, want = model.inside(leaf, contexts)[0].tolist(), []
        for leaf, contexts in inside(t):
            for node, bit in path(leaf):
                prior = float(tree.prior[node])
                own, known = [step(prior)], 0
                for c in contexts:
                    zero, one = counts[c, node]
                    known += zero + one > 0
                    own.append(step((one + lm.STRENGTH[2] * prior) / (zero + one + lm.STRENGTH[2])))
                want.append([*(max(-127, min(127, round(o * g))) for o, g in zip(own, lm.WORD_GATES[known])), bit])
        assert len(got) == len(want) and [r[-1] for r in got] == [r[-1] for r in want]
        same += sum(max(abs(a - b) for a, b in zip(x, y)) <= 1 for x, y in zip(got, want))
        whole += len(want)
    assert same > 0.99 * whole > 0  # of decisions that meet in an entry one stays
    kind = int(np.bincount(words.of[lm.SINGLES :]).argmax())
    leaves = np.flatnonzero(np.isin(np.arange(len(tree.leaf)), tree.leaf[np.concatenate([np.flatnonzero(words.of[lm.SINGLES :] == kind), [len(tree.leaf) - words.classes + kind]])]))
    total = 0.0
    for leaf in leaves:
        x, n = model.inside(np.array([leaf]), np.zeros((1, 3), np.uint64))
        total += math.exp(lm.mix(x, n)[0])
    assert len(leaves) > 3 and total == pytest.approx(1, abs=0.1)


def test_lm_white_space_of_more_than_a_part(spark, monkeypatch):
    model, _ = lm.learn(spark.createDataFrame([("a b",)], "text string"))
    want = lm.score_texts(["a"], model)["score"]
    monkeypatch.setattr(lm, "PART", 100)
    assert lm.score_texts([" " * 1000 + "a"], model)["score"] == pytest.approx(want, rel=0.01)  # the end may be a segment of its own


def test_lm_reads_all_kinds_of_decisions_side_by_side(spark, monkeypatch):
    """Classes, words and bytes are mixed in one call, and a model that says nothing changes nothing."""
    rnd = np.random.default_rng(1)
    x, sizes = rnd.integers(-127, 128, (5000, 5)).astype(np.int8), np.array([2990, 1, 2009])
    x[:, 3], x[:, 4] = 0, rnd.integers(0, 2, 5000)
    assert lm.mix(x, sizes) == pytest.approx(lm.mix(x[:, [0, 1, 2, 4]], sizes), rel=1e-6)
    model, _ = lm.learn(spark.createDataFrame([("a b a c a b ab cab abb ba bab",)] * 9 + [("b a xy",)], "text string"))
    calls, mix = [], lm.mix
    monkeypatch.setattr(lm, "mix", lambda *a: calls.append(1) or mix(*a))
    lm.score_texts(["a b xyz", None, "cab"], model)
    assert len(calls) == 1


def test_decontamination_sorts_only_what_can_reach_a_count(monkeypatch):
    """Common phrases make no sort; with few counters for diagonals the finds are the same."""
    rnd = random.Random(5)
    word = lambda n: decontaminate.folded("".join(rnd.choice("abcdefghijkl mnopqrstu") for _ in range(n)))
    index = decontaminate.Index([(k, f"{word(80)} in the course {word(80)}") for k in range(5)])
    texts = [decontaminate.folded(f"{word(60)} {item[:90]} {word(400)} {item[20:]} {word(20)}") for _, item in index.items]
    found = [index.search(t) for t in texts]
    assert all(k in {f[0] for f in got} for k, got in enumerate(found))
    monkeypatch.setattr(decontaminate, "STRIPS", 2)
    assert [index.search(t) for t in texts] == found
    monkeypatch.setattr(decontaminate.np, "lexsort", None)
    assert index.search(decontaminate.folded(f"{word(300)} in the course {word(300)}")) == []
