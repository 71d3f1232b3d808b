"""Aligned tokens against plain Python over the libraries' own tokens."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

from beaconry.llm import alignment

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printable}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}
    a_bytes = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    b_bytes = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    return a, b, a_bytes, b_bytes


def brute(rows):
    a, b, a_bytes, b_bytes = tokenizers()
    docs = []
    for doc_id, text in rows:
        groups = []
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            want = (" " + text).encode()
            if b"".join(map(a_bytes, x)) == want == b"".join(map(b_bytes, y)):
                ends = lambda ids, of: np.cumsum([len(of(i)) for i in ids]).tolist()
                ex, ey = ends(x, a_bytes), ends(y, b_bytes)
                common = sorted(set(ex) & set(ey))
                low = 0
                for c in common:
                    groups.append(([i for i, e in zip(x, ex) if low < e <= c], [i for i, e in zip(y, ey) if low < e <= c]))
                    low = c
        docs.append((doc_id, groups))
    counts = Counter(p for _, groups in docs for p in {(i, j) for g, h in groups for i in g for j in h})
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for doc_id, groups in docs:
        links = [(i, j) for g, h in groups for i in g for j in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((doc_id, sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links),
                    sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else "", text))
    return out


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


ODD = [
    (1, "a plain text"), (1, "a plain text"), (2, None), (3, ""), (None, "null id <|endoftext|> and <s>"), (4, "▁ low line"), (5, " "),
    (6, "  two  spaces\n\tand tabs "), (7, "é́ \U0001f600\U0001f601 漢字かな"), (8, "\x00\x01 controls\x7f"), (9, "a" * 3000), (10, "ab" * 700 + " " * 300),
    (11, "ﬁ ½ Ｆｕｌｌ"), (12, "ßlong" * 40),
]


def test_odd_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "run", 1) for i, t in ODD], "doc_id long, text string, run string, i int")
    got = alignment.align_tokenizers(docs, A, B, with_groups=True).collect()
    assert key(got) == key(brute(ODD))
    # Several runs, each with few documents.
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 60)
    got = alignment.align_tokenizers(docs.repartition(3), A, B, with_groups=True).collect()
    assert key(got) == key(brute(ODD))


def test_records_in_parts(monkeypatch):
    """Wide groups by distinct ids and tiny link batches give the same records."""
    sides = alignment.Side.byte_level(A), alignment.Side.pieces(B)
    a, b = alignment.Tokenizers(sides).tokens(pa.array([t for _, t in ODD]))
    aligned = alignment.Aligned(a, b, sides)
    rank = np.random.default_rng(1).permutation(sides[0].size)
    want = aligned.records(rank, 15)
    for name, value in {"WIDE_GROUP": 3, "LINKS": 5}.items():
        monkeypatch.setattr(alignment, name, value)
    assert all((x == y).all() for x, y in zip(want, aligned.records(rank, 15)))


def test_parts():
    """Parts encoded on their own give the ids of the whole text."""
    sides = alignment.Side.byte_level(A), alignment.Side.pieces(B)
    assert sides[0].parts and sides[1].parts
    a, b, *_ = tokenizers()
    letters = [*"ab1.,'s", " ", " ", "  ", "\u00a0", "\u3000", "\u2003", "\u0085", "\t", "\n", "é", "ñ", "漢", "\u0301", "\x1c", "'ll", "\u1680", "\x00"]
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(letters, n)) for n in rng.integers(1, 30, 3000)]
    got = alignment.Tokenizers(sides).tokens(pa.array(texts))
    for text, x, y in zip(texts, *got):
        if len(x):
            assert x.tolist() == a.encode(" " + text, add_special_tokens=False).ids and y.tolist() == b.encode(text), repr(text)
    assert sum(len(x) > 0 for x in got[0]) > 2900


def test_parts_met_before_are_not_encoded_again():
    """300 000 different parts are remembered, whatever came between."""
    asked = [0]

    def letters(text):
        asked[0] += 1
        return list(text.encode())

    vocabulary = [bytes([i]) for i in range(256)]
    sides = tuple(alignment.Side(vocabulary, lambda texts: [letters(t) for t in texts], True) for _ in range(2))
    tokenizers = alignment.Tokenizers(sides)
    chunks = [pa.array([" ".join(f"w{n}" for n in range(first, first + 100_000))]) for first in range(0, 300_000, 100_000)]
    before = [tokenizers.tokens(chunk) for chunk in chunks]
    assert asked[0] == 2 * 300_000
    after = [tokenizers.tokens(chunk) for chunk in chunks]
    assert asked[0] == 2 * 300_000
    for chunk, old, new in zip(chunks, before, after):
        assert all(bytes(x.astype(np.uint8)).decode() == " " + chunk[0].as_py() for side in (*old, *new) for x in side)


def test_parts_that_are_not_given_back(monkeypatch):
    """A text with a part that either side changes has no tokens; others keep theirs, with any room to remember."""
    vocabulary = [bytes([i]) for i in range(256)]
    plain = alignment.Side(vocabulary, lambda texts: [list(t.encode()) for t in texts], True)
    other = alignment.Side(vocabulary, lambda texts: [list(t.replace("x", "y").replace("z", "zz").encode()) for t in texts], True)
    texts = pa.array(["ab cd", "ab x", None, "z ab", "", "cd ab ab", "qx"])
    for room in (alignment.REMEMBERED, 2):
        monkeypatch.setattr(alignment, "REMEMBERED", room)
        tokenizers = alignment.Tokenizers((plain, other))
        for _ in range(2):
            for side in tokenizers.tokens(texts):
                assert [bytes(x.astype(np.uint8)).decode() for x in side] == [" ab cd", "", "", "", "", " cd ab ab", ""]


def test_supplied_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert key(alignment.align_tokenizers(docs, A, B, with_groups=True).collect()) == key(brute(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokenizers(docs, A, B).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_merge(monkeypatch, seed):
    monkeypatch.setattr(alignment, "FRAME", 5)
    monkeypatch.setattr(alignment, "SLAB", 11)
    rng = np.random.default_rng(seed)
    bits, runs = 4, [dict(zip(rng.choice(160, size, replace=False).tolist(), rng.integers(1, 9, size).tolist())) for size in (0, 1, 30, 70, 150)]
    counts = Counter()
    for r in runs:
        counts.update(r)
    best = {a: max(n for p, n in counts.items() if p >> bits == a) for a in {p >> bits for p in counts}}
    got = [[] for _ in runs]
    framed = [alignment._framed(np.array(sorted(r), np.int64), np.array([r[p] for p in sorted(r)], np.int64)) for r in runs]
    alignment.merge_runs([(f, frames) for f, _, frames in framed], bits, lambda k, n, b: got[k].extend(zip(n.tolist(), b.tolist())))
    assert got == [[(counts[p], counts[p] == best[p >> bits]) for p in sorted(r)] for r in runs]
