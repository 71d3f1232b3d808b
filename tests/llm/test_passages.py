"""Repeated passages of more than 50 words go, however short their words; shorter ones stay."""

import random

import corpus_pipeline


def test_short_words(spark):
    rnd = random.Random(3)
    prose = lambda: " ".join("".join(rnd.choice("bcdfghjklmnp") for _ in range(9)) for _ in range(40))
    passages = [" ".join(rnd.choice("abcdefghij") * n for _ in range(51)) for n in (1, 2, 6)]
    assert all(len(p.encode()) < 400 for p in passages)
    rows = [(10 * i + j, f"{prose()} {p} {prose()}", 0) for i, p in enumerate(passages) for j in range(2)]
    short = " ".join(rnd.choice("abcdefghij") * 6 for _ in range(45))
    few = [(i, f"{prose()} {short} {prose()}", 0) for i in (97, 98)]
    # Two such passages that overlap in a third text do not add up to a long one.
    words = [rnd.choice("abcdefghij") * rnd.randrange(4, 9) for _ in range(80)]
    one, two, both = (f"{prose()} {' '.join(words[a:b])} {prose()}" for a, b in ((0, 45), (35, 80), (0, 80)))
    assert len(" ".join(words[:45])) < 400 > len(" ".join(words[35:]))
    few += [(100, one, 0), (101, two, 0), (102, both, 0)]
    docs = spark.createDataFrame([*rows, *few, (99, prose(), 0)], "doc_id long, text string, n_chars long")
    texts = {r.doc_id: r.text for r in corpus_pipeline.dedup_passages(spark, docs, "").collect()}
    for i, p in enumerate(passages):
        for j in range(2):
            before = rows[2 * i + j][1]
            assert len(texts[10 * i + j]) <= len(before) - len(p) and p not in texts[10 * i + j]
            assert texts[10 * i + j].startswith(before[:before.index(p) - 1])
    # 45 words and 314 bytes are below both limits.
    assert all(texts[i] == text for i, text, _ in few)
    assert len(texts[99].split()) == 40


def test_op9_counts_short_words(spark, tmp_path):
    """op9 removes strings of 400 bytes; its n_repeated counts repeated passages of more than 50 words too."""
    from beaconry.llm.queries import op9_suffixes

    rnd = random.Random(7)
    prose = lambda: " ".join("".join(rnd.choice("bcdfghjklmnp") for _ in range(9)) for _ in range(40))
    passage, fewer = (" ".join(rnd.choice("abcdefghij") * 4 for _ in range(n)) for n in (51, 50))
    long = " ".join(rnd.choice("abcdefghij") * 9 for _ in range(48))
    texts = [f"{prose()} {p} {prose()}" for p in (passage, passage, fewer, fewer, long, long)]
    spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_repeated) for r in op9_suffixes(spark, str(tmp_path)).collect()}
    assert len(passage) < 400 < len(long)
    # A space on each side of the long passage repeats with it.
    want = [(0, len(passage))] * 2 + [(0, 0)] * 2 + [(len(long) + 2, len(long) + 2)] * 2
    assert got == {9: (0, 0, 0)} | {i: (len(t), *w) for i, (t, w) in enumerate(zip(texts, want))}
