"""How the tokens of two tokenizers line up, and which pairs of tokens line up most often.

Byte offsets where tokens of both sides end cut a text into groups; every pair of tokens in a
group is a link. A pair's count is the number of documents that hold it linked, so it needs
the whole corpus. Pair-document records are counted externally:

1. Each chunk of documents sorts its records by (first id, second id, document). They are kept
   as one zstd run; the distinct pairs with the chunk's own document counts go out as zstd
   frames, cut by a radix of the first id.
2. One task per radix merges the frames of all chunks with a heap, smallest pair first. A
   second id can only be followed by larger ones of the same first id (side-major order), so
   the highest count of a first id is known as soon as the merge has passed it, and the counts
   of its pairs stream back to the chunks that asked.
3. Each chunk adds what came back to the documents of its own run.

A pair that all documents share is one entry per chunk. First ids are whole in a radix, which
bounds a hot one by (chunks x ids of the second side). Runs are written to the shared folder
before they are merged; a lost executor repeats a merge, not the tokenizing.
"""

import hashlib
import heapq
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from beaconry.llm.text import Packed, bounded_batches, hash_spans, joined, mix, ranges, slices
from beaconry.plans.lineage import scratch_path

# Text of a run, text tokenized at once, pairs in a frame, pairs merged at once, bytes of text per radix. None changes a result.
CHUNK_BYTES, TOKENIZE_BYTES, FRAME, SLAB = 3 << 20, 1 << 18, 1 << 13, 1 << 20
# Parts of texts that a task remembers.
REMEMBERED = 500_000
RADIX_BYTES, LEAST_RADICES, MOST_RADICES = 512 << 20, 64, 4096
# Links made at once; a group of more links than this is counted by its distinct ids.
LINKS, WIDE_GROUP = 1 << 21, 1 << 14
_FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string"


class Side:
    """One tokenizer: ids of texts, and the bytes each id stands for.

    ``encode`` takes texts that begin with the added space. ``parts`` tells whether parts of a
    text that single spaces begin are encoded alike on their own.
    """

    def __init__(self, vocabulary: list[bytes], encode, parts: bool):
        self.encode, self.parts = encode, parts
        self.size = len(vocabulary)
        self.lengths = np.fromiter(map(len, vocabulary), np.int64, self.size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)

    @classmethod
    def byte_level(cls, path: str) -> "Side":
        """A ``tokenizers`` file over the byte-level alphabet; a space is put before every text."""
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256 on.
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        byte_of = {chr(b if b in printable else next(rest)): b for b in range(256)}
        tokens = sorted(tokenizer.get_vocab().items(), key=lambda kv: kv[1])
        vocabulary = [b""] * (tokens[-1][1] + 1)
        for token, i in tokens:
            vocabulary[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()

        # The byte-level pattern lets a token hold a space only as its first letter, or white space alone.
        told = json.loads(tokenizer.to_str())
        parts = told["normalizer"] is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        return cls(vocabulary, lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], parts)

    @classmethod
    def pieces(cls, path: str) -> "Side":
        """A ``sentencepiece`` model, which adds the space itself."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)

        def meant(i: int) -> bytes:
            piece = model.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

        # No piece crosses the start of a word, and the normaliser changes nothing (looked at on letters it might change).
        probe = "ﬁ ½ e\u0301 Ａ  x\t\u00a0y \u3000"
        parts = model.normalize(probe) == "▁" + probe.replace(" ", "▁") and not any(
            "▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
        return cls([meant(i) for i in range(model.get_piece_size())], lambda texts: model.encode([t[1:] for t in texts], num_threads=1), parts)

    def tokens(self, texts: list[str], buf: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts that begin with a space, how many each has, and whether they stand for the text's bytes.

        ``buf`` holds the texts' bytes one after another, ``sizes`` of each.
        """
        ids = self.encode(texts)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
        held = np.concatenate([[0], np.cumsum(self.lengths[flat])])[np.concatenate([[0], np.cumsum(counts)])]
        given = self.bytes[ranges(self.starts[flat], self.lengths[flat])]
        good = np.diff(held) == sizes
        of, n = np.flatnonzero(good), sizes[good]
        differ = given[ranges(held[:-1][good], n)] != buf[ranges((np.cumsum(sizes) - sizes)[good], n)]
        good[np.repeat(of, n)[differ]] = False
        return flat, counts, good


def _parts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts begin, and single spaces with no white space, of any script, on either side."""
    at = np.flatnonzero(buf[1:-1] == 0x20) + 1
    before, after = buf[at - 1], buf[at + 1]
    # The first bytes of white space in UTF-8 beyond ASCII.
    wide = np.isin(after, [0xC2, 0xE1, 0xE2, 0xE3]) | (buf[at - 2] == 0xC2) | np.isin(buf[at - 3], [0xE1, 0xE2, 0xE3])
    return np.union1d(at[(before > 0x20) & (after > 0x20) & ~wide], offsets[:-1][np.diff(offsets) > 0])


class Tokenizers:
    """Both sides over whole texts; parts seen before are remembered by a 64-bit hash."""

    def __init__(self, sides: tuple[Side, Side]):
        self.sides, self.known = sides, Packed.none(3)

    def _encoded(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple:
        """Ids of parts, first side a's and then side b's of each; where they begin, how many of both sides, and whether they are right."""
        sizes, data = ends - starts, buf.tobytes()
        begins = np.cumsum(sizes) - sizes
        cut = np.flatnonzero(np.diff(begins // TOKENIZE_BYTES, prepend=-1)).tolist()
        ids, counts, good = ([], []), ([], []), np.ones(len(sizes), bool)
        for first, last in zip(cut, [*cut[1:], len(sizes)]):
            texts = [data[s:e].decode() for s, e in zip(starts[first:last].tolist(), ends[first:last].tolist())]
            own = buf[ranges(starts[first:last], sizes[first:last])]
            for side, tokenizer in enumerate(self.sides):
                flat, n, right = tokenizer.tokens(texts, own, sizes[first:last])
                ids[side].append(flat)
                counts[side].append(n)
                good[first:last] &= right
        n_a, n_b = (np.concatenate(c) for c in counts)
        at = np.cumsum(n_a + n_b) - n_a - n_b
        values = np.empty(int((n_a + n_b).sum()), np.int32)
        values[ranges(at, n_a)], values[ranges(at + n_a, n_b)] = (np.concatenate(x) for x in ids)
        return values, at, n_a, n_b, good

    def tokens(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of every text on both sides; none for texts without tokens."""
        spaced = pc.binary_join_element_wise(pa.scalar("", pa.string()), texts.cast(pa.string()), " ")
        buf, offsets = joined(pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(None, pa.string()), spaced))
        starts = _parts(buf, offsets) if all(s.parts for s in self.sides) else offsets[:-1][np.diff(offsets) > 0]
        ends = np.append(starts[1:], len(buf)) if len(starts) else starts
        kinds, sample, kind = np.unique(hash_spans(buf, starts, ends), return_index=True, return_inverse=True)
        known, new = self.known, np.flatnonzero(~np.isin(kinds, self.known.hashes))
        if len(new):
            known = known.plus(kinds[new], *self._encoded(buf, starts[sample[new]], ends[sample[new]]))
        self.known = known if len(known.hashes) <= REMEMBERED else Packed.none(3)
        place = np.searchsorted(known.hashes, kinds)[kind]
        first, (n_a, n_b, good) = known.firsts[place], (c[place] for c in known.columns)
        at = np.searchsorted(starts, offsets)
        bad = np.concatenate([[0], np.cumsum(good == 0)])
        empty = bad[at[1:]] > bad[at[:-1]]
        out = []
        for begins, counts in ((first, n_a), (first + n_a, n_b)):
            flat = known.values[ranges(begins, counts)]
            cut = np.concatenate([[0], np.cumsum(counts)])[at]
            out.append([flat[:0] if none else flat[s:e] for none, s, e in zip(empty.tolist(), cut[:-1].tolist(), cut[1:].tolist())])
        return out[0], out[1]


def _decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids, left-aligned in rows, and how many there are; a column is left for a separator."""
    text = [str(i).encode() for i in range(size)]
    width = len(text[-1]) + 1
    return np.frombuffer(b"".join(t.ljust(width) for t in text), np.uint8).reshape(size, width), np.fromiter(map(len, text), np.int64, size)


class Aligned:
    """Groups and links of some texts, laid end to end; texts without tokens hold none."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], sides: tuple[Side, Side]):
        self.count = len(a)
        none = np.zeros(0, np.int64)
        self.a, self.b = np.concatenate([none, *a]), np.concatenate([none, *b])
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
        self.doc = np.repeat(np.arange(self.count), self.n_a)
        a_ends, b_ends = np.cumsum(sides[0].lengths[self.a]), np.cumsum(sides[1].lengths[self.b])
        marked = np.zeros((int(a_ends[-1]) if len(a_ends) else 0) + 1, bool)
        marked[a_ends] = True
        last_b = marked[b_ends]
        marked[:] = False
        marked[b_ends] = True
        last_a = marked[a_ends]
        # A token belongs to the group that the first common end at or after its own end closes.
        self.in_a, self.in_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        groups = int(last_a.sum())
        self.per_a, self.per_b = np.bincount(self.in_a, minlength=groups), np.bincount(self.in_b, minlength=groups)
        self.first_b = np.cumsum(self.per_b) - self.per_b
        self.group_doc = self.doc[last_a] if groups else none
        self.n_groups = np.bincount(self.group_doc, minlength=self.count)

    def records(self, rank: np.ndarray, b_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (pair, document) records, ordered: pairs, documents and how often each is linked.

        A pair is ``rank[a] << b_bits | b``.
        """
        doc_bits = max(1, self.count.bit_length())
        wide = self.per_a * self.per_b > WIDE_GROUP
        links = np.where(wide[self.in_a], 0, self.per_b[self.in_a]) if len(self.a) else np.zeros(0, np.int64)
        upto, keys, times, first = np.cumsum(links), [], [], 0

        def add(key: np.ndarray, n: np.ndarray | None = None) -> None:
            order = None if n is None else np.argsort(key, kind="stable")
            key = np.sort(key) if n is None else key[order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            keys.append(key[starts])
            times.append(np.diff(np.append(starts, len(key))) if n is None else np.add.reduceat(n[order], starts) if len(starts) else n)

        while first < len(links):
            done = upto[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(upto, done + LINKS, "right")))
            n = links[first:last]
            pair = np.repeat(rank[self.a[first:last]] << b_bits, n) | self.b[ranges(self.first_b[self.in_a[first:last]], n)]
            add(pair << doc_bits | np.repeat(self.doc[first:last], n))
            first = last
        for g in np.flatnonzero(wide):
            a, n_a = np.unique(self.a[slice(*np.searchsorted(self.in_a, [g, g + 1]))], return_counts=True)
            b, n_b = np.unique(self.b[slice(*np.searchsorted(self.in_b, [g, g + 1]))], return_counts=True)
            pair = ((rank[a] << b_bits)[:, None] | b).ravel()
            add(pair << doc_bits | self.group_doc[g], np.outer(n_a, n_b).ravel())
        if len(keys) > 1:
            parts, n = np.concatenate(keys), np.concatenate(times)
            keys, times = [], []
            add(parts, n)
        key, n = (keys[0], times[0]) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return key >> doc_bits, key & ((1 << doc_bits) - 1), n

    def links(self) -> np.ndarray:
        """How many links each text has."""
        return _sums(self.group_doc, self.per_a * self.per_b, self.count)

    def rendered(self, decimals: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text: ids in order, side by side, group by group."""
        n = len(self.a) + len(self.b)
        width = max(d.shape[1] for d, _ in decimals)
        table, size = np.zeros((n, width), np.uint8), np.zeros(n, np.int64)
        upto_a, upto_b = np.cumsum(self.per_a), np.cumsum(self.per_b)
        at_a = np.arange(len(self.a)) + (upto_b - self.per_b)[self.in_a]
        at_b = np.arange(len(self.b)) + upto_a[self.in_b]
        for at, ids, (digits, lengths) in ((at_a, self.a, decimals[0]), (at_b, self.b, decimals[1])):
            table[at, :digits.shape[1]] = digits[ids]
            size[at] = lengths[ids]
        separator = np.full(n, ord(","), np.uint8)
        separator[upto_a + upto_b - self.per_b - 1] = ord("|")
        separator[upto_a + upto_b - 1] = ord(";")
        table[np.arange(n), size] = separator
        flat = table[np.arange(width) <= size[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(size + 1)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [flat[s:max(s, e - 1)] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Exact integer sums per position; double sums of the two halves of each value."""
    low = np.bincount(at, values & 0x3FFFFFF, n).astype(np.int64)
    return low + (np.bincount(at, values >> 26, n).astype(np.int64) << 26)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one zstd frame: their lengths, then their bytes."""
    return zstandard.ZstdCompressor(level=1).compress(
        np.array([len(arrays), *[x.nbytes for x in arrays]], "<i8").tobytes() + b"".join(x.tobytes() for x in arrays))


def _unpack(frame: bytes, *types: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(frame)
    sizes = np.frombuffer(data, "<i8", 1 + len(types))[1:]
    ends = np.cumsum(sizes) + 8 * (1 + len(types))
    return [np.frombuffer(data[e - s:e], t) for s, e, t in zip(sizes.tolist(), ends.tolist(), types)]


def _framed(pairs: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """First pairs, sizes and frames of a sorted run."""
    cut = range(0, len(pairs), FRAME)
    frames = [_pack(np.diff(pairs[i:i + FRAME], prepend=pairs[i]).astype("<u8"), n[i:i + FRAME].astype("<u4")) for i in cut]
    return [int(pairs[i]) for i in cut], [min(FRAME, len(pairs) - i) for i in cut], frames


def merge_runs(runs: list[tuple[list[int], list[bytes]]], b_bits: int, emit) -> None:
    """K-way heap merge of sorted runs, given as first pairs and frames.

    Frames are opened in the order of their first pairs. Once enough pairs are open, all first
    ids below the next frame's are complete: ``emit(run, counts, best)`` gets, for each run and
    in its own order, the documents of the pair over all runs and whether no pair of the same
    first id has more.
    """
    heap = [(firsts[0], k, 0) for k, (firsts, _) in enumerate(runs) if firsts]
    heapq.heapify(heap)
    open_pairs, open_n, open_run, opened, wait = [], [], [], 0, SLAB

    while heap or opened:
        if heap:
            first, k, i = heap[0]
            steps, n = _unpack(runs[k][1][i], "<u8", "<u4")
            pairs = np.cumsum(steps.astype(np.int64)) + first
            open_pairs.append(pairs)
            open_n.append(n.astype(np.int64))
            open_run.append(np.full(len(pairs), k))
            opened += len(pairs)
            if i + 1 < len(runs[k][0]):
                heapq.heapreplace(heap, (runs[k][0][i + 1], k, i + 1))
            else:
                heapq.heappop(heap)
            if heap and opened < wait:
                continue
        pairs, n, run = np.concatenate(open_pairs), np.concatenate(open_n), np.concatenate(open_run)
        bound = heap[0][0] >> b_bits << b_bits if heap else np.iinfo(np.int64).max
        whole = pairs < bound
        rest = ~whole
        open_pairs, open_n, open_run, opened = [pairs[rest]], [n[rest]], [run[rest]], int(rest.sum())
        # What stays open is one hot first id, or a frame per run; open as much again before looking next.
        wait = SLAB + opened
        pairs, n, run = pairs[whole], n[whole], run[whole]
        if not len(pairs):
            continue
        order = np.argsort(pairs, kind="stable")
        pairs, n = pairs[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        counts = np.add.reduceat(n, starts)
        ids = pairs[starts] >> b_bits
        id_starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        highest = np.repeat(np.maximum.reduceat(counts, id_starts), np.diff(np.append(id_starts, len(ids))))
        spread = np.diff(np.append(starts, len(pairs)))
        count, best = np.empty(len(pairs), np.int64), np.empty(len(pairs), bool)
        count[order], best[order] = np.repeat(counts, spread), np.repeat(counts == highest, spread)
        # Frames of a run were opened in its order, so a stable sort by run restores it.
        by_run = np.argsort(run, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(run[by_run]) != 0, [True]]))
        for s, e in zip(edges[:-1], edges[1:]):
            at = by_run[s:e]
            emit(int(run[at[0]]), count[at], best[at])


def align_tokenizers(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text",
                     with_groups: bool = False) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 [, groups].

    ``byte_level`` (side a) and ``pieces`` (side b) are tokenizer files. ``n_best`` counts the
    links whose pair has the highest count of its a id, ``count_sum`` adds the counts of all
    links. Texts that are null, empty or not given back byte by byte by both sides have no
    tokens: zeros and ''. Null and repeated ids are kept, each row being a document of its own;
    other columns are ignored. Runs once, when called, up to the written runs.
    """
    spark, key = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    bounded_batches(spark)
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)).alias("n")).head().n
    radices = min(MOST_RADICES, max(LEAST_RADICES, -(-total // RADIX_BYTES)))
    schema = f"kind string, run bigint, i int, radix int, firsts array<bigint>, sizes array<int>, frames array<binary>, id {key}, {_FIELDS}"

    def runs(batches):
        sides = Side.byte_level(byte_level), Side.pieces(pieces)
        tokenizers = Tokenizers(sides)  # of this task; a reused worker keeps nothing
        decimals = [_decimals(s.size) for s in sides]
        b_bits = max(1, (sides[1].size - 1).bit_length())
        radix = mix(np.arange(1, sides[0].size + 1, dtype=np.uint64)) % np.uint64(radices)
        order = np.argsort(radix, kind="stable")
        rank = np.empty(sides[0].size, np.int64)
        rank[order] = np.arange(sides[0].size)
        edges = np.searchsorted(radix[order], np.arange(radices + 1).astype(np.uint64)) << b_bits
        made = 0
        for batch in batches:
            for first, last in slices(batch.column(1), CHUNK_BYTES):
                part = batch.slice(first, last - first)
                run, made = (TaskContext.get().partitionId() << 32) + made, made + 1
                yield from chunk(part, run, tokenizers, decimals, rank, edges, b_bits)

    def chunk(part, run, tokenizers, decimals, rank, edges, b_bits):
        a, b = tokenizers.tokens(part.column(1))
        sides = tokenizers.sides
        aligned = Aligned(a, b, sides)
        n, texts = len(part), aligned.rendered(decimals)
        tokens = aligned.n_a > 0
        yield batch_of(n, kind=["docs"] * n, run=[run] * n, i=range(n), id=part.column(0), n_a=aligned.n_a, n_b=aligned.n_b,
                       n_groups=aligned.n_groups, n_links=aligned.links(),
                       groups_sha256=[hashlib.sha256(t).hexdigest() if has else "" for t, has in zip(texts, tokens)],
                       **({"groups": [t.decode() for t in texts]} if with_groups else {}))
        del texts
        pairs, doc, times = aligned.records(rank, b_bits)
        if not len(pairs):
            return
        starts = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        held, pairs = np.diff(np.append(starts, len(pairs))), pairs[starts]
        # The run itself: documents of each pair, one after another.
        narrow = "<u2" if n <= 1 << 16 else "<u4"
        record = _pack(held.astype("<u4"), doc.astype(narrow), times.astype("<u8") if times.max() >> 16 else times.astype("<u2"))
        yield batch_of(1, kind=["runs"], run=[run], i=[n], sizes=[[int(narrow[2]), 8 if times.max() >> 16 else 2]], frames=[[record]])
        cut = np.searchsorted(pairs, edges)
        rows = [(r, *_framed(pairs[s:e], held[s:e])) for r, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]
        yield batch_of(len(rows), kind=["asked"] * len(rows), run=[run] * len(rows), radix=[r[0] for r in rows],
                       firsts=[r[1] for r in rows], sizes=[r[2] for r in rows], frames=[r[3] for r in rows])

    types = None

    def batch_of(n, **columns):
        arrays = [pa.nulls(n, t) if name not in columns else pa.array(columns[name], t) if not isinstance(columns[name], pa.Array) else columns[name]
                  for name, t in types]
        return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in types])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = [(f.name, f.type) for f in to_arrow_schema(StructType.fromDDL(schema))]
    path = scratch_path(spark, "alignment")
    docs.select(id_col, text_col).mapInArrow(runs, schema).write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(schema).parquet(path)

    def merge(table: pa.Table) -> pa.Table:
        from sentencepiece import SentencePieceProcessor

        bits = max(1, (SentencePieceProcessor(model_file=pieces).get_piece_size() - 1).bit_length())
        frames = list(zip(table["firsts"].to_pylist(), table["frames"].to_pylist()))
        back: list[list[bytes]] = [[] for _ in frames]
        merge_runs(frames, bits, lambda k, counts, best: back[k].append(_pack((counts << 1 | best).astype("<u8"))))
        return pa.table({"run": table["run"], "radix": table["radix"], "back": pa.array(back, pa.list_(pa.binary()))})

    asked = stored.where("kind = 'asked'").select("run", "radix", "firsts", "frames")
    answers = asked.groupBy("radix").applyInArrow(merge, "run bigint, radix int, back array<binary>")

    def add_up(table: pa.Table, replies: pa.Table) -> pa.Table:
        out = {"run": [], "i": [], "n_best": [], "count_sum": []}
        if table.num_rows:
            (doc_width, times_width), n = table["sizes"][0].as_py(), table["i"][0].as_py()
            held, doc, times = _unpack(table["frames"][0].as_py()[0], "<u4", f"<u{doc_width}", f"<u{times_width}")
            replies = replies.sort_by("radix")
            back = np.concatenate([_unpack(f, "<u8")[0] for row in replies["back"].to_pylist() for f in row]).astype(np.int64)
            counts, times = np.repeat(back, held), times.astype(np.int64)
            out = {"run": [table["run"][0].as_py()] * n, "i": range(n), "n_best": _sums(doc, times * (counts & 1), n),
                   "count_sum": _sums(doc, times * (counts >> 1), n)}
        return pa.table([pa.array(out["run"], pa.int64()), pa.array(out["i"], pa.int32()), pa.array(out["n_best"], pa.int64()),
                         pa.array(out["count_sum"], pa.int64())], names=list(out))

    added = (
        stored.where("kind = 'runs'").select("run", "i", "sizes", "frames").groupBy("run").cogroup(answers.groupBy("run"))
        .applyInArrow(add_up, "run bigint, i int, n_best bigint, count_sum bigint")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return stored.where("kind = 'docs'").drop("kind").join(added, ["run", "i"], "left").select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256",
        *(["groups"] if with_groups else []))
