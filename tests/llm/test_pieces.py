"""Encoding against the library, for BPE and (the same pieces declared) unigram models; decoding by round trip."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece

from beaconry.llm.pieces import PieceModel, decode_pieces, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "hello  world", " a", "trail   ", "     ", " " * 40 + "x" + " " * 15, "a\n\n b\tc", "é́ ﬁ ② 日本語 𝒳", "a▁b ▁▁c", "\x00a\x7f", "a<s>b</s><unk> <0x41>", "x" * 300, "Straße " * 50, "  日", "12345 €", "\n", " \n ", "don't--stop..."]


@pytest.fixture(scope="module")
def model():
    return PieceModel.load(PATH)


def ids_of(model, texts):
    ids, offsets = model.encode(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_bpe_equals_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rnd = random.Random(1)
    mixed = ["".join(rnd.choice("ab eé\n ▁th日s") for _ in range(rnd.randrange(60))) for _ in range(300)]
    texts = ODD + mixed + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for text, ids in zip(texts, ids_of(model, texts)):
        assert ids == library.encode(text), repr(text[:80])


def brute_unigram(model, word):
    """Best score by trying every last piece."""
    scores = {p: s for p, s, u in zip(model.pieces, model.scores, model.usable) if u}
    worst, best = min(scores.values()) - 10, [0.0]
    for end in range(1, len(word) + 1):
        best.append(max(best[s] + scores.get(word[s:end], worst if end - s == 1 else -np.inf) for s in range(max(0, end - 16), end)))
    return best[-1]


def test_viterbi_finds_the_best_path(model):
    own = PieceModel("unigram", model.pieces, -1.0 - np.arange(len(model.pieces)) ** 0.5 / 20, model.usable, model.byte_ids, model.unknown)
    words = ["▁hello", "▁worthlessness", "théorie", "日本語𝒳", "a", "▁internationalization", "xxxxxxxxxxxxxxxxxxxxxxxx"]
    worst = own.scores[own.usable].min() - 10
    for word, ids in zip(words, own.words(words)):
        known = sum(own.scores[i] for i in ids if own.usable[i])
        unknown = sum(c not in own.singles for c in word)
        assert known + worst * unknown == pytest.approx(brute_unigram(own, word)), word
        assert "".join(own.pieces[i] if own.usable[i] else "" for i in ids) == "".join(c for c in word if c in own.singles)


def test_operators_round_trip(spark, model):
    rows = [(i, t, b"x", 1) for i, t in enumerate([None, *ODD])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids binary, decoded int")
    coded = encode_pieces(df, model)
    assert coded.columns == ["doc_id", "text", "decoded", "ids"]
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in decode_pieces(coded, model).collect():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.decoded == library.decode(ids) == (r.text or "").replace("▁", " "), repr(r.text)
    assert encode_pieces(df.limit(0), model).count() == 0
    assert decode_pieces(spark.createDataFrame([(None,), (np.array([1, 0, 3 + 0xFF], "<u4").tobytes(),)], "ids binary"), model).collect()[0].decoded == ""
    with pytest.raises(ValueError):
        PieceModel.load(PATH, "word")


def test_words_met_before_are_not_encoded_again(monkeypatch):
    """A task looks up words of earlier chunks; with no room to remember, the ids are the same."""
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model, rnd, calls = PieceModel.load(PATH), random.Random(2), []
    lattice = PieceModel.lattice
    monkeypatch.setattr(PieceModel, "lattice", lambda self, chars: calls.append(len(chars)) or lattice(self, chars))
    chunks = [ODD, ODD[::-1], ["".join(rnd.choice("ab eé\n ▁th日s") for _ in range(40)) for _ in range(50)], ODD]
    made = []
    for chunk in chunks:
        calls.clear()
        assert ids_of(model, chunk) == [library.encode(t) for t in chunk]
        made.append(sum(calls))
    assert made[0] > 0 and made[1] == 0 and made[2] > 0 and made[3] == 0
    monkeypatch.setattr("beaconry.llm.pieces.REMEMBERED", 3)
    assert all(ids_of(model, chunk) == [library.encode(t) for t in chunk] for chunk in chunks)


def test_words_of_broken_utf8(model):
    """Bytes that are no UTF-8, also where the next text goes on with them, are read as U+FFFD."""
    broken = [b"ab \xc3", b"\xa9 x", b"a\xff\xfeb", "é".encode()]
    sizes = np.cumsum([0, *map(len, broken)]).astype(np.int64)
    texts = pa.LargeStringArray.from_buffers(len(broken), pa.py_buffer(sizes), pa.py_buffer(b"".join(broken)))
    assert ids_of_array(model, texts) == ids_of(model, [t.decode("utf-8", "replace") for t in broken[:2]] + ["a��b", "é"])


def ids_of_array(model, texts):
    ids, offsets = model.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
