import os
import random

from pyspark.sql import functions as F

from beaconry.functions.masking import mask_body
from beaconry.operators import patterns


def logs(spark, bodies):
    rows = [(i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", b) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "EventId int, Timestamp string, Body string").withColumn(
        "Timestamp", F.col("Timestamp").cast("timestamp_ntz"))


def templates(spark, bodies, **options):
    rows = patterns.annotate_patterns(logs(spark, bodies), **options).orderBy("EventId").collect()
    return [r.PatternTemplate for r in rows], [r.PatternId for r in rows]


def test_masking(spark):
    cases = {
        "user 550e8400-e29b-41d4-a716-446655440000 logged in": "user <*> logged in",
        "checksum deadbeef1 ok": "checksum <*> ok", "checksum cafefaced ok": "checksum cafefaced ok",
        "took 12.5 s, -42 left": "took <*> s, -<*> left", "/api/orders/123/x": "/api/orders/<*>/x", "v1 12ms": "v1 12ms",
        "abc123": "<*>", "": "",
    }
    df = spark.createDataFrame([(b,) for b in cases], "b string").select("b", mask_body("b").alias("m"))
    assert {r.b: r.m for r in df.collect()} == cases
    assert spark.range(1).select(mask_body(F.lit("a 12 34"), 4).alias("m")).head().m == "a <*>"


def test_merging_and_widening(spark):
    got, ids = templates(spark, [
        "connection to db-a failed after 3 retries", "connection to db-b failed after 4 retries",
        "connection to db-c failed after 5 retries", "connection lost", None, "", "   ",
    ])
    assert got == ["connection to <*> failed after <*> retries"] * 3 + ["connection lost", "", "", ""]
    assert ids[0] == ids[1] == ids[2] != ids[3] and len(ids[0]) == 16 and ids[4:] == ["", "", ""]


def test_dissimilar_texts_stay_apart(spark):
    got, _ = templates(spark, ["start a b c d e f", "start u v w x y z"])
    assert got == ["start a b c d e f", "start u v w x y z"]


def test_disabled(spark):
    got, ids = templates(spark, ["a b"], enabled=False)
    assert got == [""] and ids == [""]


def reference_mining(texts):
    clusters = []
    for text in texts:
        tokens = text.split(" ")
        best, score = None, -1.0
        for c in clusters:
            if len(c) != len(tokens) or c[0] != tokens[0] and c[0] != "<*>":
                continue
            s = sum(a in ("<*>", b) for a, b in zip(c, tokens)) / len(tokens)
            if s > score:
                best, score = c, s
        if best is not None and score >= 0.5:
            best[:] = [a if a in ("<*>", b) else "<*>" for a, b in zip(best, tokens)]
        else:
            clusters.append(list(tokens))
    return sorted(" ".join(c) for c in clusters)


def test_rounds_equal_one_sequential_pass(spark):
    """A bucket far larger than a round gives the same templates as walking it in order."""
    rng = random.Random(11)
    words = "alpha beta gamma delta eps".split()
    bodies = [" ".join(["go", *(rng.choice(words) for _ in range(5))]) for _ in range(300)]
    bodies += [f"stop {rng.choice(words)} {w} end" for w in words for _ in range(3)]
    texts = patterns.distinct_texts(logs(spark, bodies))
    expected = reference_mining(dict.fromkeys(bodies))
    for size in (7, 50, 10_000):
        mined = patterns.drain_templates(texts, texts_per_round=size)
        assert sorted(r.template for r in mined.collect()) == expected
    assigned = patterns.assign_templates(texts, patterns.drain_templates(texts, texts_per_round=7))
    assert assigned.count() == texts.count()


def test_known_templates_are_kept_and_widened(spark):
    first = patterns.drain_templates(patterns.distinct_texts(logs(spark, ["job x done ok", "job y done ok"])))
    again = patterns.drain_templates(patterns.distinct_texts(logs(spark, ["job z done bad", "task new"])), first)
    assert sorted((r.template, r.ordinal) for r in again.collect()) == [("job <*> done <*>", 0), ("task new", 0)]


def test_without_broadcasts(spark, monkeypatch):
    """Large template tables take the shuffle joins; the result is the same."""
    bodies = ["go a b c d", "go a b c e", "go x y z w", "stop now please", "stop later please"]
    expected = templates(spark, bodies)
    for name in ("is_small", "broadcast_if_small"):
        monkeypatch.setattr(patterns, name, (lambda df, **_: False) if name == "is_small" else (lambda df, **_: df))
    assert templates(spark, bodies, texts_per_round=1) == expected


def test_crowded_bucket_in_blocks(spark, monkeypatch):
    """Many unlike texts of one bucket: slices of templates meet blocks of texts, as in one sequential pass."""
    rng = random.Random(5)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    bodies = [" ".join(["go", *(rng.choice(words) for _ in range(7))]) for _ in range(400)]
    bodies += [" ".join([*b.split(" ")[:5], *(rng.choice(words) for _ in range(3))]) for b in bodies[::3]]
    bodies += ["stop one two", "stop one three"]
    texts = patterns.distinct_texts(logs(spark, bodies))
    expected = reference_mining(dict.fromkeys(bodies))
    assert len(expected) > 100
    monkeypatch.setattr(patterns, "FEW_SHAPES", 2)
    for tokens in (8 * 40, 8 * 10_000):
        monkeypatch.setattr(patterns, "BLOCK_TOKENS", tokens)
        mined = patterns.drain_templates(texts, texts_per_round=150)
        rows = mined.collect()
        assert sorted(r.template for r in rows) == expected
        assert sorted(r.ordinal for r in rows if r.first_token == "go") == list(range(len(expected) - 1))
    # The first fitting template of each text, by blocks and by joins.
    by_blocks = {tuple(r) for r in patterns.assign_templates(texts, mined).collect()}
    monkeypatch.setattr(patterns, "FEW_SHAPES", 10_000)
    assert {tuple(r) for r in patterns.assign_templates(texts, mined).collect()} == by_blocks and len(by_blocks) == texts.count()


def stored_bytes(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)


def test_annotation_stores_no_texts(spark):
    """What is kept between the steps is a part of the bodies, not several copies of them."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(500)]
    bodies = [" ".join(["doc", *(rng.choice(words) for _ in range(400))]) for _ in range(60)]
    bodies += [" ".join([*b.split(" ")[:-3], "other", "last", "words"]) for b in bodies[::3]]
    bodies += [f"own{i} {b}" for i, b in enumerate(bodies)]
    before = stored_bytes(spark)
    got, _ = templates(spark, bodies)
    assert stored_bytes(spark) - before < sum(map(len, bodies)) / 2
    assert got[0] == got[60] == " ".join([*bodies[0].split(" ")[:-3], "<*>", "<*>", "<*>"]) and got[1] == bodies[1] and got[80:] == bodies[80:]


def reference_annotation(rows):
    """Template of each (time, body), masked bodies given: the first of the final templates that fits."""
    first = {}
    for time, body in rows:
        text = " ".join((body or "").split())
        if text:
            first[text] = min([t for t in (first.get(text), time) if t is not None], default=None)
    buckets = {}
    for text in sorted(first, key=lambda t: (first[t] is not None, first[t], t)):
        tokens = text.split(" ")
        clusters = buckets.setdefault((len(tokens), tokens[0]), [])
        agree = [sum(a in ("<*>", b) for a, b in zip(c, tokens)) / len(tokens) for c in clusters]
        if clusters and max(agree) >= 0.5:
            best = clusters[agree.index(max(agree))]
            best[:] = [a if a in ("<*>", b) else "<*>" for a, b in zip(best, tokens)]
        else:
            clusters.append(tokens)
    out = []
    for _, body in rows:
        tokens = (body or "").split()
        fits = (c for c in buckets.get((len(tokens), tokens[0]), [])) if tokens else ()
        out.append(next((" ".join(c) for c in fits if all(a in ("<*>", b) for a, b in zip(c, tokens))), ""))
    return out


def test_one_pass_and_rounds_agree(spark, monkeypatch):
    """Repeated rows, rows without time or body, blanks of all kinds, wildcards in bodies; buckets of one text, of a few, and crowded ones."""
    rng = random.Random(9)
    words = [*"abcdefghijklmnopqrstuvwyz", "<*>", "x<*>"]
    bodies = [" ".join([rng.choice(["go", "stop"]), *(rng.choice(words) for _ in range(rng.choice((3, 7, 7))))]) for _ in range(250)]
    bodies += [b.replace(" ", rng.choice(["  ", "\t", "\n ", "\u2003"])) + " " for b in bodies[::7]] + [f"lone{c} a b" for c in "abc"] + ["", " \t", "\u2003", None]
    rows = [(rng.choice([None, *range(40)]), b) for b in bodies + bodies[::5]]
    rng.shuffle(rows)
    expected = reference_annotation(rows)
    df = spark.createDataFrame([(i, t, b, i) for i, (t, b) in enumerate(rows)], "EventId int, Timestamp int, Body string, w int")
    assert len(set(expected)) > 20

    def got(size):
        out = patterns.annotate_patterns(df, texts_per_round=size).orderBy("EventId").collect()
        assert [r.w for r in out] == list(range(len(rows)))
        return [r.PatternTemplate for r in out]

    for size in (10_000, 30):
        assert got(size) == expected
    with monkeypatch.context() as m:  # as where bodies repeat
        m.setattr(patterns, "_repeating", lambda *_: True)
        assert got(30) == expected
    monkeypatch.setattr(patterns, "is_small", lambda df, **_: False)
    assert got(30) == expected


def test_repeating_bodies_are_told_by_their_characters(spark, monkeypatch):
    monkeypatch.setattr(patterns, "SAMPLED", 1.0)
    told = lambda bodies: patterns._repeating(logs(spark, bodies), "Body", "Timestamp", None)
    assert told([f"user {i} in" for i in range(600)]) and not told([f"user {i} in" for i in range(400)])
    assert not told([f"user u{i}s in" for i in range(600)]) and not told([None] * 600) and not told([])
    # Most rows repeat, but not most characters.
    assert not told(["ok"] * 600 + [f"{i} " + f"w{i}w " * 300 for i in range(60)])
