"""Line removal against a literal loop, whatever the batches and levels."""

from collections import Counter

import pytest

from beaconry.llm.lines import drop_frequent_lines

TEXTS = [None, "", "\n", "Header\nbody one\n", " header \t\nbody two", "HEADER\r\nÄ\nheader", "header", "header", "x\n\n\nx\x0b\ny", "ä\nA\na", "only ä"] + [f"foot\n{i}\nFOOT " for i in range(6)]
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (7, 3)])
def test_against_loop(spark, batches, fanout):
    rows = [(i // 2 if i % 5 else None, t, i, "n", "h") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines long, h1 string, lost string")
    counts = Counter(k for t in TEXTS for k in {key(x) for x in (t or "").split("\n")})
    want = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not key(x) or counts[key(x)] < 3]
        want.append((str(doc_id), "\n".join(kept) if len(kept) < len(lines) else text, len(lines), len(lines) - len(kept)))
    got = drop_frequent_lines(df, 3, batches=batches, fanout=fanout)
    assert got.columns == ["doc_id", "text", "h1", "lost", "n_lines", "n_dropped"]
    assert sorted(((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert drop_frequent_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
