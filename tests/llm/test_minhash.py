"""Similarity, signatures and classes against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from beaconry.llm import minhash
from beaconry.llm.minhash import _bags, components, keep_one_of_each, near_duplicate_classes, probability_jaccard, shingles, signatures


def bag(text, size=5):
    words = (text or "").split()
    if not words:
        return Counter()
    if len(words) < size:
        return Counter([tuple(words)])
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def similarity(x, y):
    if not x or not y:
        return float(len(x) == len(y))
    both, total = set(x) | set(y), 0.0
    for i in set(x) & set(y):
        total += 1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in both)
    return total


def texts(rnd, n):
    vocabulary = [f"w{i}" for i in range(300)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(40, 160))] for _ in range(8)]
    out = []
    for _ in range(n):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 1, 1, 2, 4, 12])):
            words[rnd.randrange(len(words))] = f"x{rnd.random()}"
        if rnd.random() < 0.2:
            words += words[:rnd.randrange(len(words))]
        out.append(" ".join(words))
    return out


def test_similarity_and_signatures():
    rnd = random.Random(2)
    all_texts = [*texts(rnd, 30), "", None, "a b", "a b a b a b a b a b", "one two three four five", "z"]
    array = pa.array(all_texts)
    own, bags = _bags(array, 5), [bag(t) for t in all_texts]
    sig = signatures(*shingles(array), len(all_texts), 128)
    for i in range(len(all_texts)):
        for j in range(i):
            want = similarity(bags[i], bags[j])
            assert probability_jaccard(own[i], own[j]) == pytest.approx(want)
            if bags[i] and bags[j]:
                assert abs((sig[i] == sig[j]).mean() - want) < 0.25
    errors = [(sig[i] == sig[j]).mean() - similarity(bags[i], bags[j]) for i in range(30) for j in range(i)]
    assert abs(np.mean(errors)) < 0.02
    assert (signatures(*shingles(array.slice(3, 1)), 1, 128)[0] == sig[3]).all()


def test_components(spark):
    rnd = random.Random(3)
    links = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(5, 5)]
    parent = {x: x for l in links for x in l}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(bytes([u]), bytes([v])) for u, v in links], "u binary, v binary")
    assert {(r.node[0], r.root[0]) for r in components(df).collect()} == {(x, find(x)) for x in parent}
    assert components(df.limit(0)).count() == 0


@pytest.mark.parametrize("members", [60, 240])
def test_links_within_a_group_are_not_carried_along(spark, monkeypatch, members):
    rnd = random.Random(members)
    # Every member hangs on the smallest of its buckets, and buckets overlap; one long chain besides.
    links = {(i, min(i, j)) for i in range(members) for j in rnd.sample(range(members), 12)}
    links |= {(5000 + i, 5001 + i) for i in range(100)} | {(9000, 9000)}
    key = lambda x: x.to_bytes(2, "big")
    sizes, stored = [], minhash._stored

    def counted(df, name):
        out = stored(df, name)
        if name == "links":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(minhash, "_stored", counted)
    got = {(r.node, r.root) for r in components(spark.createDataFrame([(key(u), key(v)) for u, v in links], "u binary, v binary")).collect()}
    root = lambda x: 0 if x < members else min(x, 5000) if x < 9000 else x
    assert got == {(key(x), key(root(x))) for l in links for x in l}
    # A link is looked at in the first round, and later only while its ends are apart.
    assert sizes[0] == len(links) and sizes[-1] == 0 and sum(sizes) <= 1.5 * len(links)


@pytest.mark.parametrize("chunk", [256, 8])
def test_classes_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK_TEXTS", chunk)
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 100 * chunk)
    rnd = random.Random(4)
    rows = [(i, t, "n", 1) for i, t in enumerate(texts(rnd, 150))]
    rows += [(200, rows[3][1], "n", 1), (200, rows[3][1], "n", 1), (None, rows[5][1], "n", 1), (201, None, "n", 1), (202, "", "n", 1), (203, " \n", "n", 1), (204, "a b", "n", 1), (205, "a b", "n", 1), (206, "b a", "n", 1), (None, "lonely words here", "n", 1)]
    bags = [bag(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    want = Counter((i, min((x for x in ids if x is not None), default=None)) for ids in groups.values() for i in ids)
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, root int")
    assert Counter((r.doc_id, r.class_id) for r in near_duplicate_classes(df).collect()) == want
    kept = keep_one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((min((x for x in ids if x is not None), default=None) for ids in groups.values()), key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicate_classes(df).count() == 0 and keep_one_of_each(df).count() == 0
