"""Top-k against brute force, on signed, tied, repeated, ragged and broken vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from beaconry.llm.topk import ImpactIndex, top_k_inner_product


@pytest.mark.parametrize("scale", [2, 300, 100_000])
def test_index_is_exact(scale):
    rng = np.random.default_rng(scale)
    vectors = rng.integers(-scale, scale, (700, 8))
    vectors[100:200] = vectors[7]
    ids = rng.permutation(700)
    index = ImpactIndex(ids, vectors)
    for query_id, query in [(int(ids[7]), vectors[7]), (-1, np.zeros(8, np.int64)), (3, rng.integers(-scale, scale, 8))]:
        rows, scores = index.search(query_id, query, 10)
        want = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors) if i != query_id)[:10]
        assert [(-int(s), int(ids[r])) for r, s in zip(rows, scores)] == want


def test_operator(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-50, 50, 4)], "x") for i in range(250)]
    rows += [(7, rows[7][1], "again"), (100, None, "x"), (300, [1, None, 2, 3], "x"), (None, [1, 2, 3, 4], "x"), (400, [], "x"), (500, [1, 2], "x"), (600, [3, 4], "x"), (200, [0, 0, 0, 0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>, score string")
    got = {}
    for r in top_k_inner_product(df, F.col("vec_id") % 100 == 0, 5, shard_rows=40, block_queries=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    clean = {(i, tuple(v)) for i, v, _ in rows if i is not None and v and None not in v}
    for q in {i for i, _ in clean if i % 100 == 0}:
        vector = min(v for i, v in clean if i == q)
        best = {}
        for i, v in clean:
            if i != q and len(v) == len(vector):
                best[i] = max(best.get(i, -10**9), int(np.dot(v, vector)))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got.get(q, [])) == [(n + 1, i, s) for n, (i, s) in enumerate(want)], q
    assert top_k_inner_product(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_id_with_many_vectors(spark):
    """One id holds more high vectors than k; each id still counts once."""
    rng = np.random.default_rng(8)
    rows = [(0, [3, 4, 5])] + [(5, [int(x) for x in rng.integers(50, 90, 3)]) for _ in range(40)] + [(i, [int(x) for x in rng.integers(-9, 30, 3)]) for i in range(6, 40)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    for shard_rows in (1000, 20):
        got = [(r["rank"], r.vec_id, r.score) for r in top_k_inner_product(df, F.col("vec_id") == 0, 10, shard_rows=shard_rows).orderBy("rank").collect()]
        best = {}
        for i, v in rows[1:]:
            best[i] = max(best.get(i, -10**9), int(np.dot(v, rows[0][1])))
        assert got == [(n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10])]
