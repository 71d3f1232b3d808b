"""Waterfall and critical path on hand-made traces, in tasks and level by level."""

import random

import pytest
from pyspark.sql import functions as F

from beaconry.operators import traces

US = 1000


def spans(spark, rows):
    """(trace, id, parent, start ms, end ms)"""
    df = spark.createDataFrame(rows, "TraceId string, SpanId string, ParentSpanId string, s bigint, e bigint")
    at = lambda c: F.timestamp_add("MICROSECOND", F.col(c) * US, F.lit("2024-01-01").cast("timestamp_ntz"))
    return df.select("TraceId", "SpanId", "ParentSpanId", at("s").alias("StartTime"), at("e").alias("EndTime"))


CASES = [
    ("one", "a", "", 0, 10),
    ("orphan", "a", "", 0, 10), ("orphan", "b", "gone", 2, 20), ("orphan", "c", "b", 3, 8),
    ("roots", "a", "", 0, 10), ("roots", "b", "", 5, 15),
    ("overlap", "r", "", 0, 100), ("overlap", "x", "r", 10, 60), ("overlap", "y", "r", 40, 90), ("overlap", "z", "r", 50, 55),
    ("outlive", "r", "", 0, 10), ("outlive", "k", "r", 5, 30), ("outlive", "j", "k", 6, 25),
    ("cycle", "r", "", 0, 10), ("cycle", "p", "q", 1, 3), ("cycle", "q", "p", 2, 4),
    ("loop", "p", "q", 1, 3), ("loop", "q", "p", 2, 4),
    ("zero", "r", "", 0, 10), ("zero", "a", "r", 7, 7), ("zero", "b", "r", 2, 5),
]
SHARES = {
    "one": {"a": 10}, "orphan": {"b": 13, "c": 5}, "roots": {"b": 10}, "overlap": {"r": 10 + 10, "y": 50, "x": 30},
    "outlive": {"r": 5, "k": 1, "j": 4}, "cycle": {"r": 10}, "zero": {"r": 7, "b": 3},
}


@pytest.mark.parametrize("limit", [20_000, 0])
def test_waterfall(spark, limit):
    got = {}
    for r in traces.trace_waterfall(spans(spark, CASES), limit).orderBy("TraceId", "Ordinal").collect():
        got.setdefault(r.TraceId, []).append((r.SpanId, r.Depth))
    assert got["overlap"] == [("r", 0), ("x", 1), ("y", 1), ("z", 1)]
    assert got["orphan"] == [("a", 0), ("b", 0), ("c", 1)]
    assert got["outlive"] == [("r", 0), ("k", 1), ("j", 2)]
    assert got["cycle"] == [("r", 0)] and "loop" not in got


@pytest.mark.parametrize("limit", [20_000, 0])
def test_critical_path(spark, limit):
    got, tops = {}, {}
    for r in traces.critical_path(spans(spark, CASES), limit).collect():
        got.setdefault(r.TraceId, {})[r.SpanId] = r.ContributionUs // US
        if r.IsTop:
            assert r.TraceId not in tops
            tops[r.TraceId] = r.SpanId
    assert got == SHARES
    assert tops["overlap"] == "y" and tops["orphan"] == "b" and set(tops) == set(got)


def test_both_ways_agree_on_random_trees(spark):
    rng, rows = random.Random(3), []
    for t in range(12):
        for i in range(40):
            start = rng.randrange(0, 4000)
            parent = f"s{rng.randrange(0, i)}" if i and rng.random() < 0.93 else ""
            rows.append((f"t{t}", f"s{i}", parent, start, start + rng.randrange(0, 3000)))
    df = spans(spark, rows)
    for op in (traces.trace_waterfall, traces.critical_path):
        inside, levels = (sorted(tuple(r) for r in op(df, limit).collect()) for limit in (20_000, 10))
        assert inside == levels and inside


@pytest.mark.parametrize("seed", [1, 2])
def test_both_ways_agree_on_repeated_ids_and_ties(spark, seed):
    rng = random.Random(seed)
    rows = [("same", "a", "", 0, 10), ("same", "b", "", 0, 10), ("twice", "r", "", 0, 100), ("twice", "q", "r", 1, 90), ("twice", "k", "q", 4, 8),
            ("twice", "k", "r", 2, 76), ("twice", "k", "r", 2, 60), ("twice", "j", "k", 3, 9)]
    for t in range(10):
        for _ in range(25):
            start = rng.randrange(0, 12)
            rows.append((f"t{t}", f"s{rng.randrange(14)}", rng.choice(["", *[f"s{i}" for i in range(14)]]), start, start + rng.randrange(0, 9)))
    df = spans(spark, rows)
    for op in (traces.trace_waterfall, traces.critical_path):
        inside, levels = (sorted(tuple(r) for r in op(df, limit).collect()) for limit in (20_000, 0))
        assert inside == levels and inside
    roots = {r.TraceId: r.RootSpanId for r in traces.critical_path(df, 0).collect()}
    assert roots["same"] == "a" and roots["twice"] == "r"


@pytest.mark.parametrize("hot_rows", [1000, 1])
def test_parents_with_many_children(spark, hot_rows):
    df = spans(spark, CASES).withColumns({"ServiceName": F.concat(F.lit("s-"), "SpanId"), "Name": F.col("SpanId")})
    got = {(r.TraceId, r.SpanId): (r.IsRoot, r.ParentName) for r in traces.parent_child(df, hot_rows).collect()}
    ids = {(t, i) for t, i, *_ in CASES}
    assert got == {(t, i): ((t, p) not in ids, p if (t, p) in ids else None) for t, i, p, *_ in CASES}


def test_contributions_add_up_to_the_root(spark):
    """With children inside their parents' start, shares sum to the root's duration."""
    rng, rows = random.Random(5), []
    for t in range(20):
        starts = [0]
        rows.append((f"t{t}", "s0", "", 0, 1000))
        for i in range(1, 30):
            p = rng.randrange(0, i)
            start = starts[p] + rng.randrange(0, 200)
            starts.append(start)
            rows.append((f"t{t}", f"s{i}", f"s{p}", start, start + rng.randrange(1, 900)))
    path = traces.critical_path(spans(spark, rows)).groupBy("TraceId").agg(
        F.sum("ContributionUs").alias("total"), F.max("RootDurationUs").alias("root"))
    assert path.where("total <> root").count() == 0 and path.count() == 20


def test_deep_chain(spark, monkeypatch):
    """5000 levels take about log2 of them rounds, and give the rows of the walk in one task."""
    from beaconry.plans import lineage, trees

    rng, rows = random.Random(11), [("deep", "s0", "", 0, 20_000)]
    for i in range(1, 5000):
        rows.append(("deep", f"s{i}", f"s{i - 1}", i, 20_000 - rng.randrange(0, 3 * i)))
        if i % 10 == 0:
            rows.append(("deep", f"leaf{i}", f"s{rng.randrange(i)}", i, i + rng.randrange(0, 4000)))
    df = spans(spark, rows)
    for op, passes in ((traces.trace_waterfall, 2), (traces.critical_path, 1)):
        written = []
        monkeypatch.setattr(trees, "stored", lambda frame: written.append(1) or lineage.stored(frame))
        inside, joined = (sorted(tuple(r) for r in op(df, limit).collect()) for limit in (20_000, 10))
        assert inside == joined and inside
        assert len(written) <= 14 * passes


def test_wide_tree(spark):
    """A root of very many children, and two cycles beside it."""
    rows = [("w", "r", "", 0, 9000), *[("w", f"c{i}", "r", i % 700, i % 700 + 40) for i in range(3000)], ("w", "p", "q", 1, 3), ("w", "q", "p", 2, 4), ("w", "z", "z", 5, 6)]
    df = spans(spark, rows)
    for op in (traces.trace_waterfall, traces.critical_path):
        inside, joined = (sorted(tuple(r) for r in op(df, limit).collect()) for limit in (20_000, 10))
        assert inside == joined and inside
