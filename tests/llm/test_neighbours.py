"""Recall against brute force; exactness of scores, ties and copies."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from beaconry.llm.neighbours import hilbert, nearest_neighbours


def test_hilbert_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        place = hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_recall_on_whole_table(spark):
    from beaconry.llm.queries import op7_neighbours

    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(np.float64)
    got = {}
    for r in op7_neighbours(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in sorted(range(len(ids)), key=lambda i: (d[i], ids[i])) if i != q][:10]
        found = got[ids[q]]
        assert len(found) == 10 and all(abs(d[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in found.items())
        hits, total = hits + sum(int(ids[i]) in found for i in want), total + 10
    assert hits / total >= 0.9


def test_copies_and_broken_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in (rng.normal(size=3) if i > 60 else (1.0, 2.0, 3.0))], "k") for i in range(130)]
    rows += [(0, rows[0][1], "again"), (200, None, "k"), (300, [1.0, None, 2.0], "k"), (400, [float("nan"), 1.0, 1.0], "k"), (500, [0.0, 0.0, 0.0], "k"), (None, [1.0, 1.0, 1.0], "k"), (600, [1.0, 2.0], "k"), (700, [], "k")]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, place string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest_neighbours(df, F.col("vec_id") % 100 == 0, 10, window=200).collect())
    assert [g[:3] for g in got if g[0] == 0] == [(0, i, i) for i in range(1, 11)]
    assert {g[0] for g in got} == {0, 100}
    d = sorted((float(np.sqrt(((np.array(v) - rows[100][1]) ** 2).sum())), i) for i, v, _ in rows[:130] if i != 100)[:10]
    assert [(g[2], round(g[3], 12)) for g in got if g[0] == 100] == [(i, round(s, 12)) for s, i in d]
    assert nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_id_with_many_vectors(spark):
    """One id holds more than 2k near vectors; each id still counts once."""
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 1.0, 1.0])] + [(5, [1.0 + float(x) for x in rng.normal(size=3) / 1000]) for _ in range(40)]
    rows += [(i, [1.0 + float(x) for x in rng.normal(size=3)]) for i in range(6, 90)]
    rows += [(i, [5.0, 5.0, 5.0]) for i in (3, 4)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = [(r["rank"], r.vec_id) for r in nearest_neighbours(df, F.col("vec_id") == 0, 10, window=200).orderBy("rank").collect()]
    best = {}
    for i, v in rows[1:]:
        best[i] = min(best.get(i, 1e9), float(np.sqrt(((np.array(v) - rows[0][1]) ** 2).sum())))
    assert got == [(n + 1, i) for n, (i, _) in enumerate(sorted(best.items(), key=lambda x: (x[1], x[0]))[:10])]
