"""Ranked search against plain Python, and how much the two trees leave out."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from beaconry.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    first = {}
    for i, t in items:
        if t is not None and (first.get(i) is None or t < first[i]):
            first[i] = t
    out = []
    for item, text in first.items():
        scored = []
        for i, bag in bags:
            m = 25 + (75 * sum(bag.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t in terms(text) if bag[t])
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def key(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


DOCS = [(1, "Apple pie"), (1, "Apple pie"), (2, None), (3, ""), (None, "apple, APPLE; Äpfel Über"), (4, " .,;-\x00\t"), (5, "pie " * 50_000 + "rare"),
        (6, "x" * 100_000), (9, "tie one"), (8, "tie one"), (7, "tie two a1b2 ١٢ 漢字"), (10, "äpfel über")]
ITEMS = [(1, "apple pie pie"), (1, "zzz"), (2, None), (None, "Äpfel äpfel"), (3, "tie TIE one"), (4, "rare x"), (5, "..."), (6, "漢字 ١٢ a1b2"), (7, "unknown")]


@pytest.mark.parametrize("block", [1 << 15, 2])
def test_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical, "LEVEL_BYTES", block)
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in DOCS], "doc_id long, text string, item int, score int").repartition(3)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, id string")
    got = lexical.rank_documents(docs, items, 3).collect()
    assert key(got) == key(brute(DOCS, ITEMS, 3))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), items).collect() == []
    assert lexical.rank_documents(docs, items.limit(0)).collect() == []


def test_trees():
    """Exact on sparse random rows; equal scores included; large weights take the integer path."""
    rng = np.random.default_rng(3)
    for factor in (1, 1 << 40):
        q, v = (rng.integers(1, 20, s) * (rng.random(s) < 0.2) for s in ((70, 40), (500, 40)))
        items = lexical.Items(*np.nonzero(q), q[np.nonzero(q)] * factor, 70, 40, 5)
        items.mass = np.ones(40, np.int64)
        ids = rng.permutation(500)
        for s in range(0, 500, 125):
            row, col = np.nonzero(v[s:s + 125])
            items.search(row, col, v[s:s + 125][row, col], ids[s:s + 125])
        scores = (q @ v.T) * factor
        for at, i in enumerate(items.order):
            best = sorted((-int(x), int(d)) for x, d in zip(scores[i], ids) if x > 0)[:5]
            assert [(-int(x), int(d)) for x, d in zip(items.scores[at], items.ids[at]) if x] == best


def test_trees_prune():
    """Most pairs of supplied items and documents are never scored."""
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet")["text"].combine_chunks()
    texts = pq.read_table("/root/testdata/sf0.1/benchmark.parquet")["text"].combine_chunks()
    hashes, at = lexical.term_hashes(texts)
    vocabulary, col = np.unique(hashes, return_inverse=True)
    item, col, times = lexical._counted(np.repeat(np.arange(len(texts)), np.diff(at)), col, len(vocabulary))
    h, n = lexical.term_hashes(docs)
    c = np.searchsorted(vocabulary, h)
    known = np.flatnonzero(vocabulary[np.minimum(c, len(vocabulary) - 1)] == h)
    doc, c, tf = lexical._counted(np.repeat(np.arange(len(docs)), np.diff(n))[known], c[known], len(vocabulary))
    mass = np.floor(1000 * np.log((2 * len(docs) + 2) / (2 * np.bincount(c, minlength=len(vocabulary)) + 1))).astype(np.int64)
    items = lexical.Items(item, col, times * mass[col], len(texts), len(vocabulary), 10)
    items.mass = mass
    m = 25 + 75 * np.diff(n) * len(docs) // n[-1]
    impact = 10**9 * tf // (1000 * tf + 8 * m[doc])
    for s in range(0, len(docs), 1000):
        a, b = np.searchsorted(doc, [s, s + 1000])
        items.search(doc[a:b] - s, c[a:b], impact[a:b], np.arange(s, min(s + 1000, len(docs))))
    assert items.pairs < 0.1 * len(texts) * len(docs)
