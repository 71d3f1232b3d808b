"""Held-out accuracy on the whole table, and odd texts."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from beaconry.llm.language import FEATURES, LanguageModel, fit_language, identify_language
from beaconry.llm.queries import op1_language


def test_held_out_accuracy(spark):
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet")
    lang = dict(zip(table["doc_id"].to_pylist(), table["lang"].to_pylist()))
    rows = op1_language(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert 0.15 < len(held) / len(rows) < 0.35
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95


def test_odd_texts(spark):
    words = {"en": "the and of to house tree", "de": "der und schön straße haus baum", "fr": "le et où maison garçon arbre", "es": "el y casa niño árbol señor", "it": "il e casa albero città perché"}
    rows = [(i, " ".join([w] * (1 + i % 3)), k) for i, (k, w) in enumerate([*words.items()] * 12)]
    docs = spark.createDataFrame([*rows, (90, "nothing", None), (None, None, "en"), (91, "", "de")], "doc_id long, text string, lang string")
    model = fit_language(docs)
    assert sorted(model.languages) == sorted(words) and sum(map(len, model.families)) == 5
    odd = spark.createDataFrame([(1, None, "a", 5.0), (1, "", "a", 5.0), (1, "12 ,.!", "a", 5.0), (1, "√ 5", "a", 5.0), (1, "日本", "a", 5.0), (1, words["de"] * 20000, "a", 5.0), (1, words["es"], "a", 5.0)], "doc_id int, text string, lang_pred string, score double")
    got = identify_language(odd, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "score"]
    kinds = [r.lang_pred for r in got.collect()]
    assert Counter(kinds)["und"] == 4 and "de" in kinds and "es" in kinds
    assert identify_language(odd.limit(0), model).count() == 0
    assert fit_language(docs.limit(0)).predict(pa.array(["abc", None]))[0] == ["und", "und"]


def plain_prediction(model, text):
    """Family, then votes of its pairs, from n-grams counted one by one."""
    cells = [b if 97 <= b <= 122 or b >= 128 else 32 for b in b"  " + (text or "").lower().encode() + b"  "]
    bits = FEATURES.bit_length() - 1
    grams = defaultdict(int)
    for a, b, c in zip(cells, cells[1:-1], cells[2:]):
        grams[(a + b * 256) * 2246822519 % 2**32 >> 32 - bits] += 1
        grams[(a + b * 256 + c * 65536) * 2654435761 % 2**32 >> 32 - bits] += 1
    n = sum(grams.values())
    margins = [sum(k * float(model.weights[g, m]) for g, k in grams.items()) / n + float(c) for m, c in enumerate(model.constants)]
    family = max(range(len(model.families)), key=lambda f: (margins[f], -f))
    score, votes, least = 1 / (1 + math.exp(-2 * margins[family])), defaultdict(float), defaultdict(lambda: math.inf)
    for (a, b), m in zip(model.pairs, margins[len(model.families):]):
        votes[a] += (m > 0) + 1e-3 * math.tanh(m)
        votes[b] += (m <= 0) - 1e-3 * math.tanh(m)
        least[a], least[b] = min(least[a], m), min(least[b], -m)
    best = max(model.families[family], key=lambda i: (votes[i], -i))
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    return model.languages[best], score / (1 + math.exp(-2 * min(30, least[best])))


def test_plain_margins():
    rng = np.random.default_rng(5)
    languages = ["l0", "l1", "l2", "l3", "l4"]
    families = [[0, 3], [1, 2, 4]]
    pairs = [(0, 3), (1, 2), (1, 4), (2, 4)]
    model = LanguageModel(languages, families, pairs, rng.normal(0, 20, (FEATURES, 6)).astype(np.float32), rng.normal(0, 0.1, 6))
    words = ["Straße", "the", "niño", "a", "12", "日本", "…", "zz", "É", "house\n"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(400)] + ["", None, "x", "é", "7", " "]
    found, scores = model.predict(pa.array(texts))
    for text, lang, score in zip(texts, found, scores):
        want, near = plain_prediction(model, text)
        assert lang == want and math.isclose(score, near, rel_tol=1e-4, abs_tol=1e-6), text
    # Neighbours in a batch do not matter.
    alone = [model.predict(pa.array([t], pa.string())) for t in texts]
    assert [a[0][0] for a in alone] == found and np.allclose([a[1][0] for a in alone], scores, rtol=1e-6)
