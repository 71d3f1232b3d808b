"""Packing against the tokenizer applied to whole texts, one at a time."""

import zlib

import numpy as np
import public_tokenizers
import pytest

from beaconry.llm.packing import decompose, pack_power_of_two

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " \n\t ", "Hello, WORLD!!", "it's we're o'clock. 'S", "á é. .́ x≠ ≮", "naïve café… fin.",
    "<|endoftext|> a <|startoftext|>, b<|endoftext|>.", "ÀÉ Straße ǅ İstanbul ΣΑΣ", "word " * 3000 + "x" * 5000, "1,234.56 €3", "\x1c\x85 z",
    "same", "same", "日本語 テキスト。 𝒳𝒴",
]


def test_equals_whole_text_encoding(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, length string, ids int, start int")
    rows = pack_power_of_two(docs, PATH, 64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, text in enumerate(TEXTS):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in np.frombuffer(r.ids, "<u4")] == ids, text
        assert all(r.doc_tokens == len(ids) and r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 for r in own)
        assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))


def test_decompose_and_bad_length(spark):
    of, start, length = decompose(np.array([1, 4096 * 2 + 5, 3]), 4096)
    assert of.tolist() == [0, 1, 1, 1, 1, 2, 2]
    assert start.tolist() == [0, 0, 4096, 8192, 8196, 0, 2]
    assert length.tolist() == [1, 4096, 4096, 4, 1, 2, 1]
    with pytest.raises(ValueError):
        pack_power_of_two(spark.range(0), PATH, 100)


def test_empty_table_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert pack_power_of_two(spark.createDataFrame([], schema), PATH).count() == 0
    rows = pack_power_of_two(spark.createDataFrame([(None, "a b"), (None, "a b")], schema), PATH).collect()
    assert len(rows) == 4 and zlib.crc32(rows[0].ids) == zlib.crc32(rows[2].ids)
