"""Packing by power-of-two decomposition.

A document of n tokens becomes as many pieces of ``max_len`` as fit and one piece for each
binary digit of the rest. Every piece is a sequence of its own, so no sequence crosses
documents and none needs padding: equal lengths are batched together (column ``bucket``).
Decomposition is local to a document; nothing is shuffled.
"""

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from beaconry.llm.text import bounded_batches, hash_spans, joined, ranges, slices, word_spans

# Bytes of text tokenized at once, and words a task remembers. Neither changes a result.
CHUNK_BYTES, REMEMBERED = 4 << 20, 200_000

_FINAL = np.zeros(256, dtype=bool)
_FINAL[list(b".,;:?!")] = True
_ASCII_WORD = np.zeros(256, dtype=bool)
_ASCII_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: b if b in printable else next(rest) for b in range(256)}


class WordTokens:
    """Token ids of words, by a ``tokenizers`` file whose pre-tokenizer never crosses white space.

    Words are told apart by a 64-bit hash and encoded once per task while remembered. Case
    is folded for A-Z before that and final punctuation is split off after ASCII letters and
    digits: the lower-casing tokenizer encodes such parts alike on their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = re.compile("[a-zß-öø-ÿ]+").fullmatch
        self.letters = _byte_letters()
        self.known: dict[int, bytes] = {}

    def encode_new(self, words: list[str]) -> list[bytes]:
        """Lower-case Latin words go to the model at once, all others through the whole tokenizer."""
        out: list = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            if self.plain(word):
                seen = self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.letters))
                out[i] = np.array([t.id for t in seen], "<u4").tobytes()
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the n + 1 offsets of the texts in them."""
        buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        starts, ends, text_words = word_spans(buf, offsets)
        core = ends.copy()
        todo = np.arange(len(ends))
        while len(todo):
            todo = todo[(core[todo] > starts[todo]) & _FINAL[buf[core[todo] - 1]]]
            core[todo] -= 1
        split = np.flatnonzero((core < ends) & (core > starts) & _ASCII_WORD[buf[np.maximum(core - 1, 0)]]) if len(core) else core
        cuts = np.sort(np.concatenate([starts, core[split]]))
        stops = np.sort(np.concatenate([ends, core[split]]))
        hashes = hash_spans(buf, cuts, stops)
        kinds, sample, kind = np.unique(hashes, return_index=True, return_inverse=True)
        data, keys = buf.tobytes(), kinds.tolist()
        missing = [i for i, k in enumerate(keys) if k not in self.known]
        fresh = self.encode_new([data[cuts[j]:stops[j]].decode("utf-8", "replace") for j in sample[missing]])
        own = dict(zip((keys[i] for i in missing), fresh))
        tokens = [self.known[k] if k in self.known else own[k] for k in keys]
        if len(self.known) + len(own) > REMEMBERED:
            self.known = {}
        self.known |= own if len(own) <= REMEMBERED else {}
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
        flat = np.frombuffer(b"".join(tokens), "<u4")
        counts = sizes[kind]
        ids = flat[ranges((np.cumsum(sizes) - sizes)[kind], counts)]
        upto = np.concatenate([[0], np.cumsum(counts)])
        return ids, upto[np.searchsorted(cuts, offsets)]


def tokens_of(texts: pa.Array, words: WordTokens, eos: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each closed by ``eos``, and their n + 1 offsets."""
    ids, offsets = words.encode(*joined(texts))
    counts = np.diff(offsets)
    closed = np.full(len(ids) + len(counts), eos, "<u4")
    closed[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return closed, offsets + np.arange(len(offsets))


def decompose(counts: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents of ``counts`` tokens: the document, start and length of each piece, longest first."""
    whole = counts // max_len
    digits = [max_len >> k for k in range(1, max_len.bit_length())]
    has = (counts[:, None] & np.array(digits)) > 0
    pieces = whole + has.sum(1)
    of = np.repeat(np.arange(len(counts)), pieces)
    rank = ranges(np.zeros(len(counts), np.int64), pieces)
    length = np.full(len(of), max_len, np.int64)
    length[rank >= whole[of]] = np.broadcast_to(digits, has.shape)[has]
    upto = np.cumsum(length) - length
    first = (np.cumsum(pieces) - pieces)[of]
    return of, upto - upto[first] if len(of) else upto, length


def pack_power_of_two(docs: DataFrame, tokenizer: str, max_len: int = 4096, eos: int = 2, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian uint32), doc_tokens, bucket,
    sequence_id, offset.

    ``max_len`` is a power of two. Null and empty texts are the single token ``eos``; null and
    repeated ids are kept, each row being a document of its own; other columns are ignored.
    ``sequence_id`` numbers the pieces by partition; each sequence has one piece, at offset 0.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    key = docs.schema[id_col].dataType.simpleString()

    def pack(batches):
        words = WordTokens(tokenizer)  # of this task; a reused worker keeps nothing
        for batch in batches:
            for first, last in slices(batch.column(1), CHUNK_BYTES):
                part = batch.slice(first, last - first)
                ids, offsets = tokens_of(part.column(1), words, eos)
                counts = np.diff(offsets)
                of, start, length = decompose(counts, max_len)
                ends = np.concatenate([[0], 4 * np.cumsum(length)])
                small = ends[-1] < 1 << 31
                binary = pa.Array.from_buffers(
                    pa.binary() if small else pa.large_binary(), len(of),
                    [None, pa.py_buffer(ends.astype(np.int32 if small else np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays([
                    pc.take(part.column(0), pa.array(of)), pa.array(start), pa.array(length),
                    binary.cast(pa.binary()), pa.array(counts[of]),
                ], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    bounded_batches(docs.sparkSession)
    pieces = docs.select(id_col, text_col).mapInArrow(
        pack, f"doc_id {key}, start bigint, length bigint, ids binary, doc_tokens bigint")
    return pieces.withColumns({
        "bucket": F.col("length"), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint"),
    }).withColumnRenamed("doc_id", id_col)
