"""Each stage of the pipeline on its own input, against plain Python."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tests.llm.test_lines import key
from tests.llm.test_minhash import bag, similarity
from tests.llm.test_suffixes import brute

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF_DIR)
        if name != "packing":
            assert made.columns == columns and made.dtypes == docs.dtypes
        rows = made.collect()
        out.append((docs.collect(), rows))
        docs = spark.createDataFrame(rows, made.schema)
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out))


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "suffix_dedup", "packing"]


def test_toxicity(spark, stages):
    before, after = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert set(after) <= set(before)
    kept = {r.doc_id for r in after}
    clean = [r for r in before if labels.get(r.doc_id) == 0]
    assert sum(r.doc_id in kept for r in clean) >= 0.97 * len(clean)


def test_lines(stages):
    before, after = stages["line_dedup"]
    counts = Counter(k for r in before for k in {key(x) for x in (r.text or "").split("\n")})
    want = {r.doc_id: "\n".join(x for x in r.text.split("\n") if not key(x) or counts[key(x)] < 10) for r in before}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_near_duplicates(stages):
    before, after = stages["near_dedup"]
    bags = {r.doc_id: bag(r.text) for r in before}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in bags:
        for j in bags:
            small, large = sorted((sum(bags[i].values()), sum(bags[j].values())))
            if j < i and set(bags[i]) & set(bags[j]) or small == large == 0:
                if similarity(bags[i], bags[j]) >= 0.8:
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    assert sorted(after) == sorted(r for r in before if find(r.doc_id) == r.doc_id)


def test_suffixes(stages):
    before, after = stages["suffix_dedup"]
    want = {i: kept.decode("utf-8", "ignore") for i, kept, *_ in brute([(r.doc_id, r.text) for r in before], 400, 51)}
    assert {r.doc_id: r.text for r in after} == want


def test_packing(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before, after = stages["packing"]
    pieces = {}
    for r in sorted(after, key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert pieces == {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in before}


def test_odd_tables(spark, tmp_path):
    rows = [(1, "a\nb", "x", None, 3, 0.5), (1, "a\nb", "x", None, 3, 0.5), (None, None, None, "s", None, None), (2, "", None, "s", 0, 1.0), (3, "long " * 30_000, "x", "s", 5, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for name, table in (("some", docs), ("none", docs.limit(0))):
        sf_dir = str(tmp_path / name)
        table.write.parquet(f"{sf_dir}/documents.parquet")
        spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
        out = corpus_pipeline.run(spark, sf_dir).collect()
        assert (len(out) > 0) == (name == "some")
        if name == "some":
            assert {r.doc_id for r in out} == {1, 2, 3}
