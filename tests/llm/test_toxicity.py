"""Readings of obfuscated words, held-out quality, odd rows."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from beaconry.llm.language import held_out
from beaconry.llm.text import hash_spans, joined
from beaconry.llm.toxicity import LOOKALIKES, MORE_READINGS, READINGS, Decoder, ToxicityModel, fit_toxicity, score_toxicity, trigrams


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return fit_toxicity(docs, labels.where(~held_out("doc_id", 3, 1)))


def test_trigrams():
    counts = trigrams(pa.array(["ab", None, "Éa"]))
    assert counts.sum() == 7 and counts[0 * 784 + 1 * 28 + 2] == 1 and counts[27 * 28 + 1] == 1


@pytest.mark.parametrize("token,word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("$tup1d", "stupid"), ("s.c.u.m", "scum"), ("w0rthl3ss!", "worthless"), ("idiiiiiot", "idiot"), ("p-a-t-h-e-t-i-c", "pathetic"), ("CL0WN", "clown")])
def test_readings(model, token, word):
    assert any(word in r.split() for r in model.decoder.readings(token)), model.decoder.readings(token)


def test_obfuscated_documents(model):
    clean = "the and of to in that was on for with as at by this"
    insults = ["1d10t m0r0n", "you s t u p i d thing", "w.o.r.t.h.l.e.s.s tr@sh", "ddddisgusting scummm", "lo$er cl0wn"]
    scores = model.score(pa.array([clean, None, "", *[f"{clean} {i} {clean}" for i in insults]]))
    assert (scores[:3] < 0.7).all() and (scores[3:] >= 0.7).all(), scores


def test_held_out_quality(spark, model):
    from beaconry.llm.queries import op8_toxicity

    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet")
    toxic = dict(zip(labels["doc_id"].to_pylist(), labels["toxic"].to_pylist()))
    rows = op8_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    judged = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    hit = sum(p and t for p, t in judged)
    assert hit / sum(t for _, t in judged) > 0.9 and hit / max(1, sum(p for p, _ in judged)) > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "bad word", 9.0), (1, None, 9.0), (None, "", 9.0), (3, "x" * 100_000 + " 1" * 5000, 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        got = score_toxicity(docs, fit_toxicity(docs, known))
        assert got.columns == ["doc_id", "text", "score"] and all(0 <= r.score <= 1 for r in got.collect())
    assert score_toxicity(docs.limit(0), ToxicityModel(Decoder(trigrams(pa.array([""]))), np.zeros(0, np.uint64), np.zeros((0, 4), int), np.zeros(1), 0.0)).count() == 0


def words(model, text):
    """Of the toxic words, those among the features of a text."""
    known = ["idiot", "moron", "stupid", "scum", "worthless", "pathetic", "clown", "disgusting", "ass"]
    _, hashes = model.decoder.features(pa.array([text]))
    buf, offsets = joined(pa.array(known))
    return {w for w, h in zip(known, hash_spans(buf, offsets[:-1], offsets[1:])) if h in hashes}


@pytest.mark.parametrize("text,want", [("a m o r o n", {"moron"}), ("such a m o r o n he is", {"moron"}), ("y o u i d i o t", {"idiot"}), ("i d i o t  m o r o n", {"idiot", "moron"}), ("p a t h e t i c c l o w n", {"pathetic", "clown"}), ("no a s s here", {"ass"})])
def test_spaced_words(model, text, want):
    assert want <= words(model, text), model.decoder.readings(text.replace("  ", "\n"))


@pytest.mark.parametrize("word", ["i d i o t", "m 0 r 0 n", "w 0 r t h l 3 s s"])
def test_long_tokens(model, word):
    # Wherever the word lies, also over what was a cut at 64 characters.
    plain = {"i d i o t": "idiot", "m 0 r 0 n": "moron", "w 0 r t h l 3 s s": "worthless"}[word]
    for n in range(3, 9):
        for m in range(4):
            before = "  ".join(" ".join(w) for w in ["that"] * n + ["the"] * m)
            assert plain in words(model, f"{before}  {word}  a n d  t h a t"), (n, m)


def test_very_long_token(model):
    readings = model.decoder.readings("a n d\nt h a t\n" * 2000 + "m 0 r 0 n")
    assert any("moron" in r.split() for r in readings)
    assert len(model.decoder.readings("ab1" * 10_000)[0]) > 15_000


@pytest.mark.parametrize("text,word", [("c£own", "clown"), ("¡d¡ot", "idiot"), ("the £o$€r", "loser"), ("@$$", "ass"), ("an @$$!", "ass"), ("5#1+", "sit"), ("iiddiioott", "idiot"), ("mmoorroonn", "moron"), ("¡ d ¡ o t", "idiot"), ("c £ o w n", "clown")])
def test_hidden_words(model, text, word):
    _, hashes = model.decoder.features(pa.array(["", text, None]))
    buf, offsets = joined(pa.array([word]))
    assert hash_spans(buf, offsets[:-1], offsets[1:])[0] in hashes


def test_plain_words_stay(model):
    text = "successful address 1234 ** * é £ e€ 5€"
    of, hashes = model.decoder.features(pa.array([text]))
    buf, offsets = joined(pa.array(["successful", "address", "é"]))
    assert np.isin(hash_spans(buf, offsets[:-1], offsets[1:]), hashes).all() and (of == 0).all()


def every_reading(token, cost):
    """The least cost of every text that the lattice of a token spells, path by path."""
    bonus, code = 2.5, lambda x: ord(x) - 96
    edges = (0, len(token) - 1) if any(c.isalpha() for c in token) else (len(token) - 1,)
    least = {}

    def walk(i, text, a, b, spent):
        if i == len(token):
            spent += cost[a][b][0] if b else 0.0
            least[text] = min(spent, least.get(text, spent))
            return
        c = token[i]
        for x in c if c.isalpha() else LOOKALIKES.get(c, ""):
            walk(i + 1, text + x, b, code(x), spent + (0.0 if c.isalpha() else 1.0) - bonus + cost[a][b][code(x)])
            if i and token[i - 1] == c and text[-1:] == x:
                walk(i + 1, text, a, b, spent + 0.5)
        if c.isalpha():
            return
        dropped, ended = {" ": (0.7, 3.0), "\n": (6.0, 0.3)}.get(c, (0.7 if c not in LOOKALIKES or c == "*" else 3.0 if i in edges else 6.0, 4.0))
        walk(i + 1, text, a, b, spent + dropped)
        if b:
            walk(i + 1, text + " ", b, 0, spent + ended + cost[a][b][0])

    walk(0, "", 0, 0, 0.0)
    return least


def test_every_path():
    rng = np.random.default_rng(3)
    decoder = Decoder(rng.integers(0, 50, 28 ** 3).astype(float))
    tokens = ["1d10t", "a m o", "s.c.u.m", "iii", "@$$", "m\nn o", "w0**3", "!a!", "1", "aab.bb", ""]
    tokens += ["".join(rng.choice(list("aabi10$!*. -\n"), rng.integers(1, 7))) for _ in range(150)]
    for token in tokens:
        least = every_reading(token, decoder.cost)
        keep = MORE_READINGS if " " in token or "\n" in token else READINGS
        got = decoder.readings(token)
        assert len(set(got)) == len(got) == min(keep, len(least)), token
        assert np.allclose([least[text] for text in got], sorted(least.values())[:keep]), token
