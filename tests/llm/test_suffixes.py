"""Suffix arrays and removal of repeated bytes against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from beaconry.llm.suffixes import _Runs, _minima, _windows, common_prefixes, remove_repeated_bytes, repeated_passages, repeated_starts, suffix_order


@pytest.mark.parametrize("text", [b"", b"a", b"aaaaaaa", b"banana", b"mississippi\x00\xff\x00\x00", bytes(range(256)) * 2, b"abab" * 50 + b"ba"])
def test_suffix_order(text):
    order = suffix_order(text, len(text) + 1)
    assert order.tolist() == sorted(range(len(text)), key=lambda p: text[p:])
    shared = common_prefixes(text, order, 9)
    for i, (a, b) in enumerate(zip(order, order[1:])):
        n = 0
        while n < 9 and a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert shared[i + 1] == n


def test_truncated_order_and_repeats():
    rnd = random.Random(5)
    text = bytes(rnd.choice(b"ab") for _ in range(3000))
    order = suffix_order(text, 12)
    assert sorted(order.tolist()) == list(range(3000))
    assert all(text[a:a + 12] <= text[b:b + 12] for a, b in zip(order, order[1:]))
    parts = [text[:700], text[600:1400], text[2000:2005]]
    every = [[p[s:s + 12] for s in range(len(p) - 11)] for p in parts]
    flat = [w for ws in every for w in ws]
    assert repeated_starts(parts, 12).tolist() == [flat.count(w) > 1 for w in flat]


def brute(rows, length, words=0):
    """Rows of the operator; with ``words``, passages of so many whole words go too."""
    data = [(t or "").encode() for _, t, *_ in rows]
    spans = [[(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", d)] for d in data]
    passages = [[(s[i][0], s[i + words - 1][1]) for i in range(len(s) - words + 1)] if words else [] for s in spans]
    held = Counter(d[a:b] for d, ps in zip(data, passages) for a, b in ps)
    seen = {}
    for d in data:
        for s in range(len(d) - length + 1):
            seen[d[s:s + length]] = seen.get(d[s:s + length], 0) + 1
    out = []
    for row, d, ps in zip(rows, data, passages):
        gone = np.zeros(len(d), bool)
        for a, b in ps:
            gone[a:b] |= held[d[a:b]] > 1
        for s in range(len(d) - length + 1):
            if seen[d[s:s + length]] > 1:
                gone[s:s + length] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((row[0], bytes(np.frombuffer(d, np.uint8)[~gone]), len(d), int(gone.sum()), spans))
    return sorted(out, key=str)


@pytest.mark.parametrize("length,block_bytes,hot_runs", [(60, 3000, 1000), (60, 3000, 3), (60, 1 << 20, 3), (40, 2000, 5), (400, 6000, 4)])
def test_against_brute_force(spark, length, block_bytes, hot_runs):
    rnd = random.Random(length)
    word = lambda: "".join(rnd.choice("abcdé日") for _ in range(rnd.randrange(1, 9)))
    passage = " ".join(word() for _ in range(30 * length // 60))
    base = [" ".join(word() for _ in range(60 * length // 60)) for _ in range(6)]
    rows = []
    for i in range(40):
        text = rnd.choice(base)
        cut = rnd.randrange(len(text))
        text = rnd.choice([text, text[:cut], text[:cut] + word() + text[cut:], word() + " " + passage + word() + " " + word(), word() * 3 + passage[5:] + word()])
        rows.append((i, text, "x", 1))
    rows += [(3, rows[4][1], "x", 1), (None, passage, "x", 1), (50, None, "x", 1), (51, "", "x", 1), (52, "ab" * length * 2, "x", 1), (53, "z" * (length + 1), "x", 1),
             (54, "\x00" * (2 * length), "x", 1), (55, passage.encode()[:length].decode("utf8", "ignore"), "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string, shard int")
    got = remove_repeated_bytes(df, length, block_bytes=block_bytes, hot_runs=hot_runs)
    assert got.columns == ["doc_id", "text", "shard", "kept", "n_bytes", "n_removed", "n_spans"]
    assert sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()), key=str) == brute(rows, length)


@pytest.mark.parametrize("seed", range(4))
def test_repeated_passages(seed):
    """Among equal strings stand some that go on with the same letters."""
    rnd = random.Random(seed)
    parts = []
    for _ in range(40):
        words = [rnd.choice(["aa", "aab", "b", "ba\x10", "ba"]) for _ in range(rnd.randrange(20, 26))]
        words[rnd.randrange(3)] = rnd.choice("ab")
        parts.append("".join(w + rnd.choice("  \n") for w in words).strip().encode())
    every = []
    for p in parts:
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^ \t-\r]+", p)]
        every += [p[at[i][0]:at[i + 2][1]] for i in range(len(at) - 2)]
    counts = Counter(every)
    assert repeated_passages(parts, 3, 60).tolist() == [counts[w] > 1 for w in every]


@pytest.mark.parametrize("words,block_bytes,hot_runs", [(17, 3000, 1000), (17, 3000, 3), (20, 1 << 20, 5)])
def test_passages_against_brute_force(spark, words, block_bytes, hot_runs):
    rnd = random.Random(words)
    word = lambda: "".join(rnd.choice("abcdé日") for _ in range(rnd.randrange(1, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    base, shared = [line(words + 12) for _ in range(5)], line(words - 2)
    rows = []
    for i in range(40):
        ws = rnd.choice(base).split(" ")
        cut = rnd.randrange(len(ws))
        rows.append((i, rnd.choice([" ".join(ws), line(3) + " " + " ".join(ws[cut:]) + "x " + line(4), " ".join([*ws[:cut], word(), *ws[cut:]]), line(9) + "\n" + shared + " " + line(5)])))
    rows += [(50, "ab " * 4 * words), (51, None), (None, ""), (52, "a b c " * words), (3, rows[3][1]), (53, "\u00a0".join(["x"] * 60)), (54, rows[0][1] + "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    both = {"length": 400, "passage_words": words, "block_bytes": block_bytes, "hot_runs": hot_runs}
    got = remove_repeated_bytes(df, **both).collect()
    want, plain = brute(rows, 400, words), brute(rows, 400)
    assert sorted(((r.doc_id, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got), key=str) == plain
    assert sorted(((r.doc_id, r.n_bytes, r.n_repeated) for r in got), key=str) == sorted(((i, n, gone) for i, _, n, gone, _ in want), key=str)
    texts = remove_repeated_bytes(df, as_text=True, **both).collect()
    assert sorted(((r.doc_id, r.text.encode(), r.n_bytes, r.n_removed, r.n_spans) for r in texts), key=str) == want


def test_cut_characters(spark):
    """Readable text where a removed string ends within a character."""
    text = "é" * 30
    rows = [(1, "x" + text), (2, text[:-1] + "è")]
    got = remove_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 59, as_text=True).collect()
    assert {r.doc_id: r.text for r in got} == {i: k.decode("utf-8", "ignore") for i, k, *_ in brute(rows, 59)}


def test_empty_and_bad_length(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(df).count() == 0
    with pytest.raises(ValueError):
        remove_repeated_bytes(df, 8)


@pytest.mark.parametrize("width", [1, 2, 7, 40])
@pytest.mark.parametrize("kinds", [1, 2, 5, 10**6])
def test_minima_of_windows(width, kinds):
    """Places and windows of minima, with many equal values and fewer values than a window."""
    rnd = random.Random(width * kinds)
    for n in (0, 1, 6, 39, 40, 300):
        values = np.array([rnd.randrange(kinds) for _ in range(n)], np.uint64)
        starts = {}
        for s in range(n - width + 1):
            least = min(values[s:s + width])
            for p in range(s, s + width):
                if values[p] == least:
                    starts.setdefault(p, []).append(s)
        at = _minima(values, width)
        assert at.tolist() == sorted(starts)
        first, last = _windows(np.arange(n), values, width, n)
        assert {p: list(range(a, b + 1)) for p, (a, b) in enumerate(zip(first, last)) if a <= b} == starts


@pytest.mark.parametrize("words", [0, 17])
def test_runs_are_all_strings(words):
    """Runs hold every string of ``length`` bytes within a text once, whatever lies next to it."""
    rnd = random.Random(words)
    texts = ["".join(rnd.choice("ab ") for _ in range(rnd.choice([0, 5, 59, 60, 61, 75, 200]))) for _ in range(60)] + ["z" * 150, "ab" * 70, "z" * 60]
    runs = _Runs(pa.array(texts), 60, words)
    lo, hi = (x[~runs.by_word] for x in (runs.lo, runs.hi))
    offsets = np.cumsum([0, *map(len, texts)])
    assert [s for a, b in zip(lo, hi) for s in range(a, b + 1)] == [o + s for o, t in zip(offsets, texts) for s in range(len(t) - 59)]
    # Equal strings have equal anchors, and every anchor is counted.
    whole, anchors = "".join(texts), {}
    for a, b, anchor, key in zip(lo, hi, runs.anchor[~runs.by_word], runs.key[~runs.by_word]):
        assert key in runs.keys
        for s in range(a, b + 1):
            assert anchors.setdefault(whole[s:s + 60], anchor) == anchor
