"""Repeated word windows against a literal dictionary of windows."""

import random

import pytest

from beaconry.llm.substrings import remove_repeated_windows


def brute(rows, window):
    order = sorted(range(len(rows)), key=lambda i: ((rows[i][0] is not None), rows[i][0] or 0, rows[i][1] or ""))
    seen, out = set(), {}
    import re
    for i in order:
        words = re.findall(r"[^\x20\x09-\x0D]+", rows[i][1] or "")
        gone = set()
        for s in range(len(words) - window + 1):
            w = tuple(words[s:s + window])
            if w in seen:
                gone.update(range(s, s + window))
            seen.add(w)
        out[i] = (rows[i][0], " ".join(w for j, w in enumerate(words) if j not in gone), len(words), len(gone))
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("window,block_bytes", [(20, 4000), (20, 1 << 20), (5, 3000)])
def test_against_dictionary(spark, window, block_bytes):
    rnd = random.Random(window)
    base = [[rnd.choice("ab cd efghijklm ñö nopqrstuvwxyz日本".split(" ")) + str(rnd.randrange(40)) for _ in range(120)] for _ in range(12)]
    rows = []
    for i in range(60):
        words = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(len(words))] = f"new{rnd.random()}"
        a, b = sorted(rnd.sample(range(len(words)), 2))
        rows.append((i, rnd.choice([" ", "\n", "\t\x0b"]).join(words[a:b]) + rnd.choice(["", " "]), "k"))
    rows += [(5, "x y " * 60, "k"), (61, "x y " * 60, "k"), (62, None, "k"), (63, "", "k"), (64, " \n ", "k"), (None, rows[0][1], "k"), (3, rows[9][1], "k"), (3, rows[9][1], "k"),
             (70, " ".join(f"w{i}" for i in range(window)), "k"), (71, "q " + " ".join(f"w{i}" for i in range(window)) + " r", "k"), (72, "w" * 5000, "k"), (73, " ".join(["tick\x00"] * 700), "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, b string")
    got = remove_repeated_windows(df, window, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "text", "b", "n_words", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in got.collect()), key=str) == brute(rows, window)


def test_empty_and_long_windows(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert [r.n_removed for r in remove_repeated_windows(df, 4).collect()] == [0, 0]
    assert sorted(r.n_removed for r in remove_repeated_windows(df, 1).collect()) == [0, 3]
    assert remove_repeated_windows(df.limit(0)).count() == 0
