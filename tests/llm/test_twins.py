"""Language ID and toxicity against plain versions: dictionaries and loops in place of lattices, automata and tables."""

import base64
import collections
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import langid, toxicity
from quarry.llm.queries import QUERIES


def _segment(word, probs):
    """Forward and backward sums over all segmentations."""
    n = len(word)
    alpha, beta = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for i in range(1, n + 1):
        alpha[i] = sum(alpha[j] * probs.get(word[j:i], 0.0) for j in range(max(0, i - langid.MAX_PIECE), i))
    for j in range(n - 1, -1, -1):
        beta[j] = sum(beta[i] * probs.get(word[j:i], 0.0) for i in range(j + 1, min(n, j + langid.MAX_PIECE) + 1))
    return alpha, beta


def _learned(words, pieces):
    probs = {p: 0.02 ** max(1, len(p) - 1) for p in pieces}
    whole = sum(probs.values())
    probs = {p: v / whole for p, v in probs.items()}
    for _ in range(langid.ROUNDS):
        got = dict.fromkeys(pieces, 0.0)
        for word, n in words.items():
            alpha, beta = _segment(word, probs)
            for j in range(len(word)):
                for i in range(j + 1, min(len(word), j + langid.MAX_PIECE) + 1):
                    p = word[j:i]
                    if p in probs:
                        got[p] += n * alpha[j] * probs[p] * beta[i] / alpha[-1]
        whole = sum(got.values())
        probs = {p: v / whole + (langid.BYTE_FLOOR if len(p) == 1 else 0) for p, v in got.items()}
        whole = sum(probs.values())
        probs = {p: v / whole for p, v in probs.items()}
    return probs


def test_language_is_its_plain_version(spark, tmp_path):
    some = [b" the", b" and", b"ing", b"th", b" der", b"sch", b" u", b"nd", b"e ", b"ein", b" t", b"he"]
    path = tmp_path / "pieces.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {k}\n" for k, p in enumerate(some)))
    pieces = {p for p in some} | {bytes([b]) for b in range(256)}
    rnd = random.Random(3)
    stems = {"en": ["the", "and", "thing", "being", "he"], "de": ["der", "und", "ein", "schön", "nde"], "xx": ["abab", "baba"]}
    rows = [(k, " ".join(rnd.choice(stems[g]) for _ in range(rnd.randint(3, 20))), g) for k, g in enumerate(["en", "de", "xx"] * 8)]
    rows += [(90, None, "en"), (91, "12 !", "de"), (92, "the der", None), (1, rows[1][1], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, str(path), F.col("doc_id") % 4 != 2, keep_text=True).collect()
    by = collections.defaultdict(collections.Counter)
    for i, t, g in {(i, t, g) for i, t, g in rows if i % 4 != 2 and t and g}:
        for w in langid.LETTERS.findall(t.lower()):
            by[g][b" " + w.encode()] += 1
    probs = {g: _learned(by[g], pieces) for g in sorted(by)}
    for r in got:
        words = langid.LETTERS.findall((r["_row"]["text"] or "").lower())
        if not words:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        total = {g: sum(math.log(_segment(b" " + w.encode(), p)[0][-1]) for w in words) for g, p in probs.items()}
        best = max(total, key=total.get)
        want = 1 / sum(math.exp((v - total[best]) * langid.TEMPER / math.sqrt(len(words))) for v in total.values())
        assert r["lang_pred"] == best and math.isclose(r["score"], want, rel_tol=1e-6)


def _plain_hits(text, lexicon):
    best, spared = {}, []
    for k in {*lexicon.weights, *lexicon.exceptions}:
        at = text.find(k)
        while at >= 0:
            if k in lexicon.exceptions:
                spared.append((at, at + len(k)))
            w = lexicon.weights.get(k, 0.0)
            if w and (at not in best or w > best[at][1]):
                best[at] = (at + len(k), w)
            at = text.find(k, at + 1)
    return [w for s, (e, w) in best.items() if not any(a <= s and e <= b for a, b in spared)]


def test_toxicity_is_its_plain_version(spark):
    rnd = random.Random(8)
    clean, bad = ["sea", "sky", "house", "tree", "water", "bird"], ["grubbish", "w0rthless", "vіle"]
    rows, marks = [], []
    for k in range(160):
        y = k % 4 == 0
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 15))]
        if y:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        elif k % 10 == 1:
            words += ["vile", "weather"]
        rows.append((k, " ".join(words)))
        marks += [(k, int(y))] * (1 + (k % 7 == 0))
    rows += [(200, None), (201, ""), (202, "12 -")]
    marks += [(300, 1), (5, None), (None, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    lexicon = toxicity.learn_lexicon(docs, labels, F.lit(True))
    # counts, cover and the logistic function over plain sets
    texts = {(y, t) for i, t in rows for j, y in marks if i == j and y is not None and t is not None}
    toxic, calm = [t for y, t in texts if y == 1], [t for y, t in texts if y == 0]
    seen = {1: collections.Counter(), 0: collections.Counter()}
    for y, t in texts:
        seen[y].update(toxicity.terms(toxicity.folded(t)))
    weight = {t: math.log((a + 0.5) / (len(toxic) + 1)) - math.log((seen[0][t] + 0.5) / (len(calm) + 1)) for t, a in seen[1].items()}
    assert lexicon.weights and all(math.isclose(w, weight[t], rel_tol=1e-9) and w >= toxicity.LEAST_WEIGHT and seen[1][t] >= toxicity.LEAST for t, w in lexicon.weights.items())
    x = np.array([_plain_features(toxicity.folded(t), lexicon) for _, t in sorted(texts)])
    model = toxicity.fit_logistic(x, np.array([y for y, _ in sorted(texts)], float))
    assert np.allclose(model, lexicon.model, rtol=1e-6)
    for r in toxicity.score_toxicity(docs, lexicon, keep_text=True).collect():
        z = float(np.dot(_plain_features(toxicity.folded(r["_row"]["text"]), lexicon), lexicon.model))
        assert math.isclose(r["score"], 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-9)


def _plain_features(text, lexicon):
    total = sum(_plain_hits(text, lexicon))
    return [1.0, float(total > 0), math.log1p(total), total / math.sqrt(max(1, len(text.split())))]


def test_the_eleven_are_registered():
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == ["op1_quality", "op2_bpe", "op3_lm", "op4_simhash", "op5_decontaminate", "op6_language", "op7_warc", "op8_chat", "op9_main_text", "op10_toxicity"]
