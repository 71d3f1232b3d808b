"""Removal of repeated word windows: a count-min prefilter, then exact grouping.

Round 1: every window of ``window`` words has an anchor, the smallest hash among its
``GRAM``-word shingles. Equal windows have equal anchors at equal places, so the number of
places chosen as an anchor bounds the count of each of its windows from above. Blocks update
count-min rows with their anchors; the partition sketches are merged by cell range. Round 2:
windows whose anchor is estimated to occur twice, in every row of the sketch, are grouped
exactly, by 96-bit digests, to find the first document of each. A colliding cell only lets
a window through to round 2, so none is lost.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from beaconry.llm.routed import Blocks, answer, bits, cuts, flags
from beaconry.llm.text import hash_spans, joined, mix, ranges, rolling, sliding_max, sliding_min, word_spans

GRAM = 8
# Cells of a sketch row per byte of text: about four per anchor.
CELLS_PER_BYTE, ROWS = 0.1, 2
BLOCK_BYTES, SHARD_BYTES = 12 << 20, 24 << 20
_SECOND = np.uint64(0xA0761D6478BD642F)


class _Words:
    """Words, windows and anchors of one block."""

    def __init__(self, texts: pa.Array, window: int):
        self.buf, self.offsets = joined(texts)
        self.starts, self.ends, self.docs = word_spans(self.buf, self.offsets)
        self.hashes = hash_spans(self.buf, self.starts, self.ends)
        n, gram = len(self.starts), min(GRAM, window)
        self.valid = np.zeros(max(0, n - window + 1), bool)
        counts = np.maximum(0, np.diff(self.docs) - window + 1)
        self.valid[ranges(self.docs[:-1], counts)] = True
        grams = rolling(self.hashes, gram)
        width = window - gram + 1
        self.anchor = sliding_min(grams, width)
        chosen = np.concatenate([np.zeros(width - 1, np.uint64), np.where(self.valid, self.anchor, 0), np.zeros(width - 1, np.uint64)])
        places = grams[sliding_max(chosen, width) == grams] if len(self.anchor) else grams[:0]
        self.anchors, counts = np.unique(places, return_counts=True)
        self.twice = counts > 1

    def cells(self, row: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct cells of a sketch row, their counts up to 2, and the cell of each anchor."""
        cell = mix(self.anchors + np.uint64(row + 1) * _SECOND) % np.uint64(width)
        cells, of = np.unique(cell, return_inverse=True)
        counts = np.bincount(of, weights=1 + self.twice, minlength=len(cells))
        return cells, np.minimum(counts, 2).astype(np.uint32), of


def remove_repeated_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the kept words of each text, joined by one space, and n_words and n_removed.

    A word goes if a window of ``window`` words over it also starts earlier: in a row with a
    smaller id (null first), or earlier in the same row. Rows that repeat an id count in the order of
    their texts; of equal rows one keeps its words. Windows are judged on the input. Null and empty texts have no words
    and become empty; texts below ``window`` words lose none. ``id_col`` is an integer column;
    columns named n_words and n_removed are replaced.
    """
    blocks = Blocks(docs, id_col, text_col, block_bytes)
    id_at, text_at = blocks.id_at, blocks.text_at
    width = max(1 << 16, int(blocks.bytes * CELLS_PER_BYTE))
    shards = max(1, -(-blocks.bytes // SHARD_BYTES))
    per_shard = -(-width // shards)

    def slices(cells):
        edges = np.searchsorted(cells, np.arange(shards + 1) * per_shard)
        return [(s, int(a), int(b)) for s, a, b in zip(range(shards), edges, edges[1:]) if b > a]

    def sketch(table: pa.Table, _) -> dict[int, bytes]:
        words, sent = _Words(table[text_at].combine_chunks(), window), {}
        for row in range(ROWS):
            cells, counts, _ = words.cells(row, width)
            for shard, a, b in slices(cells):
                local = (cells[a:b] - np.uint64(shard * per_shard)).astype(np.uint32)
                sent[row * shards + shard] = (local * np.uint32(2) + (counts[a:b] > 1)).astype("<u4").tobytes()
        return sent

    def merge_sketches(payloads, _) -> list[bytes]:
        parts = [np.frombuffer(p, "<u4") for p in payloads]
        total = np.zeros(per_shard, np.uint32)
        for p in parts:
            total[p >> np.uint32(1)] += 1 + (p & np.uint32(1))
        return [bits(total[p >> np.uint32(1)] > 1) for p in parts]

    def candidates(table: pa.Table, replies: dict):
        """Distinct digests of the windows estimated repeated, where each first starts, and the digest of each window."""
        words = _Words(table[text_at].combine_chunks(), window)
        heavy = np.ones(len(words.anchors), bool)
        for row in range(ROWS):
            cells, _, of = words.cells(row, width)
            heavy &= flags(replies, slices(cells), row * shards, len(cells))[of]
        at = np.searchsorted(words.anchors, words.anchor)
        at[at == len(words.anchors)] = 0
        found = words.valid & (heavy[at] if len(heavy) else False)
        windows = np.flatnonzero(found)
        one = rolling(words.hashes, window)[windows]
        two = (rolling(mix(words.hashes ^ _SECOND), window, 0xE7037ED1A0B428DB)[windows] >> np.uint64(32)).astype("<u4")
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        group = np.cumsum(new) - 1
        of = np.empty(len(order), np.int64)
        of[order] = group
        first = windows[order[np.flatnonzero(new)]]  # lexsort is stable: the earliest of equal windows
        return words, windows, one[order][new], two[order][new], first, of

    def ids(table: pa.Table) -> np.ndarray:
        """Ids in their order; a null id comes before all others."""
        values = table[id_at].combine_chunks().cast(pa.int64())
        return values.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)

    def exact(table: pa.Table, replies: dict) -> dict[int, bytes]:
        words, _, one, two, first, _ = candidates(table, replies)
        owner = ids(table)[np.searchsorted(words.docs, first, "right") - 1]
        return {s + ROWS * shards: one[a:b].astype("<u8").tobytes() + owner[a:b].astype("<i8").tobytes() + two[a:b].tobytes()
                for s, a, b in cuts(one, shards)}

    def group(payloads, numbers) -> list[bytes]:
        """For each digest sent, whether another block holds it in an earlier document."""
        sizes = [len(p) // 20 for p in payloads]
        column = lambda kind, start, size: np.concatenate([np.frombuffer(p, kind, n, start * n) for p, n in zip(payloads, sizes)])
        one, owner = column("<u8", 0, 8), column("<i8", 8, 8)
        two = column("<u4", 16, 4)
        block = np.repeat(numbers, sizes)
        order = np.lexsort((block, owner, two, one))
        later = np.zeros(len(order), bool)
        later[order[1:]] = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        return [bits(x) for x in np.split(later, np.cumsum(sizes)[:-1])]

    def remove(table: pa.Table, replies: dict):
        words, windows, one, _, first, of = candidates(table, replies)
        later = flags(replies, cuts(one, shards), ROWS * shards, len(one))
        gone = windows[later[of] | (first[of] != windows)]
        steps = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(steps, gone, 1)
        np.add.at(steps, gone + window, -1)
        keep = np.cumsum(steps)[:-1] == 0
        n_words = np.diff(words.docs)
        kept_upto = np.concatenate([[0], np.cumsum(keep)])[words.docs]
        n_kept = np.diff(kept_upto)
        starts, sizes = words.starts[keep], (words.ends - words.starts)[keep]
        # Each kept word with a space behind it, then without the last space of each text.
        index = ranges(starts, sizes + 1)
        spaced = np.append(words.buf, np.uint8(32))[np.minimum(index, len(words.buf))]
        ends = np.cumsum(sizes + 1)
        spaced[ends - 1] = 32
        of_doc = np.concatenate([[0], ends])[kept_upto]
        drop = np.zeros(len(spaced), bool)
        drop[of_doc[1:][n_kept > 0] - 1] = True
        lengths = np.diff(of_doc) - (n_kept > 0)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [
            None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)), pa.py_buffer(spaced[~drop])])
        return texts.cast(pa.large_string()).cast(table[text_at].type), {"n_words": pa.array(n_words), "n_removed": pa.array(n_words - n_kept)}

    repeated = answer(blocks.ask(sketch), merge_sketches)
    earlier = answer(blocks.ask(exact, repeated), group)
    return blocks.finish(remove, repeated.unionByName(earlier), "n_words bigint, n_removed bigint")
