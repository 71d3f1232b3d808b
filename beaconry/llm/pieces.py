"""SentencePiece encoding and decoding in batches of words.

Pieces never continue past a space, so a text falls into words, each with the space before
it. Distinct words of one length form a matrix of characters and advance together: hashes
of all substrings probe the sorted keys of the pieces, which gives the lattice of the batch.
For unigram models a Viterbi pass takes, character by character, the best piece ending
there (vectorised maxima with backpointers). For BPE models the best path is not what the
model means; there the same lattice gives every neighbouring pair its score, and vectorised
maxima pick the next merge of each word until none is left.
"""

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from beaconry.llm.text import Packed, add_columns, hash_spans, joined, mix, ranges

_SPACE = "▁"
# Cells of a lattice (words x places x lengths) held at once, and bytes of text.
CELLS, CHUNK_BYTES = 1_000_000, 2 << 20
# Words that a task remembers, and leading bits of a hash that are looked at before the keys are searched.
REMEMBERED, LEADING = 500_000, 20
_NONE = np.float64(-np.inf)


@dataclass
class PieceModel:
    """Pieces of a model file: their texts, scores, and which of them are bytes or not text."""

    kind: str
    pieces: list[str]
    scores: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray
    unknown: int

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> "PieceModel":
        """Read a model whose normaliser changes nothing; ``kind`` is bpe or unigram."""
        import sentencepiece

        if kind not in ("bpe", "unigram"):
            raise ValueError("kind is bpe or unigram")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        bytes_ = {int(pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        usable = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) for i in ids])
        byte_ids = np.array([bytes_.get(b, model.unk_id()) for b in range(256)])
        return cls(kind, pieces, np.array([model.get_score(i) for i in ids]), usable, byte_ids, model.unk_id())

    def __getstate__(self):
        """With the tables made from the pieces, so that tasks do not make them again."""
        self.longest, self.keys, self.alone, self.singles, self.spaces, self.texts
        return dict(self.__dict__)

    @cached_property
    def longest(self) -> int:
        return max(len(p) for p, u in zip(self.pieces, self.usable) if u)

    @cached_property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted hashes of the usable pieces, and their ids."""
        ids = np.flatnonzero(self.usable)
        hashes = _hashes(*_code_points([self.pieces[i] for i in ids]))
        order = np.argsort(hashes)
        return hashes[order], ids[order]

    @cached_property
    def leading(self) -> np.ndarray:
        """Which leading bits some key has; most substrings of a word have others."""
        out = np.zeros(1 << LEADING, bool)
        out[self.keys[0] >> np.uint64(64 - LEADING)] = True
        return out

    @cached_property
    def alone(self) -> np.ndarray:
        """ASCII bytes that are in no piece of several characters; words can be cut at them."""
        joined_ = {c for p, u in zip(self.pieces, self.usable) if u and len(p) > 1 for c in p}
        out = np.zeros(256, bool)
        out[[b for b in range(128) if chr(b) not in joined_ and b != 32]] = True
        return out

    @cached_property
    def singles(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces) if self.usable[i] and len(p) == 1}

    @cached_property
    def spaces(self) -> dict[int, int]:
        return {len(p): i for i, p in enumerate(self.pieces) if self.usable[i] and set(p) == {_SPACE}}

    def lattice(self, chars: np.ndarray) -> np.ndarray:
        """(word, start, length - 1): id of the piece, or -1, for a matrix of code points."""
        n, size = chars.shape
        keys, ids = self.keys
        out = np.full((n, size, min(size, self.longest)), -1, np.int32)
        hashes = np.zeros((n, size), np.uint64)
        for length in range(1, out.shape[2] + 1):
            hashes = mix(hashes[:, :size - length + 1] + chars[:, length - 1:].astype(np.uint64))
            rows, starts = np.nonzero(self.leading[hashes >> np.uint64(64 - LEADING)])
            own = hashes[rows, starts]
            at = np.searchsorted(keys, own)
            at[at == len(keys)] = 0
            found = keys[at] == own
            out[rows[found], starts[found], length - 1] = ids[at[found]]
        return out

    def viterbi(self, lattice: np.ndarray) -> np.ndarray:
        """End of the piece that starts at each place of each word, 0 where none starts."""
        n, size = lattice.shape[:2]
        scores = np.append(self.scores, _NONE)[lattice]
        unknown = self.scores[self.usable].min() - 10
        scores[:, :, 0] = np.where(lattice[:, :, 0] < 0, unknown, scores[:, :, 0])
        best = np.full((n, size + 1), _NONE)
        best[:, 0] = 0
        back = np.zeros((n, size + 1), np.int64)
        for end in range(1, size + 1):
            lengths = np.arange(1, min(end, lattice.shape[2]) + 1)
            ways = best[:, end - lengths] + scores[:, end - lengths, lengths - 1]
            # Of equal ways the one with the longest last piece.
            choice = len(lengths) - 1 - ways[:, ::-1].argmax(1)
            best[:, end] = ways[np.arange(n), choice]
            back[:, end] = end - lengths[choice]
        ends = np.zeros((n, size), np.int64)
        at = np.full(n, size)
        todo = np.arange(n)
        while len(todo):
            start = back[todo, at[todo]]
            ends[todo, start] = at[todo]
            at[todo] = start
            todo = todo[start > 0]
        return ends

    def merges(self, lattice: np.ndarray) -> np.ndarray:
        """The same for BPE: in every round each word makes its best merge, the leftmost of equal ones."""
        n, size = lattice.shape[:2]
        ends = np.tile(np.arange(1, size + 1), (n, 1))
        before = np.tile(np.arange(-1, size - 1), (n, 1))
        scores = np.append(self.scores, _NONE)
        pair = np.full((n, size), _NONE)
        if size > 1 and lattice.shape[2] > 1:
            pair[:, :-1] = scores[lattice[:, :-1, 1]]

        def rescore(rows, starts):
            middle = ends[rows, starts]
            has = (starts >= 0) & (middle < size)
            rows, starts, middle = rows[has], starts[has], middle[has]
            length = ends[rows, middle] - starts
            fits = length <= lattice.shape[2]
            found = np.full(len(rows), -1)
            found[fits] = lattice[rows[fits], starts[fits], length[fits] - 1]
            pair[rows, starts] = scores[found]

        todo = np.arange(n)
        while len(todo):
            left = pair[todo].argmax(1)
            more = pair[todo, left] > _NONE
            todo, left = todo[more], left[more]
            right = ends[todo, left]
            after = ends[todo, right]
            ends[todo, left] = after
            ends[todo, right] = 0
            pair[todo, right] = _NONE
            pair[todo, left] = _NONE
            inner = after < size
            before[todo[inner], after[inner]] = left[inner]
            rescore(todo, left)
            first = before[todo, left]
            rescore(todo[first >= 0], first[first >= 0])
        return ends

    def words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each word (in which a space is written as its piece)."""
        ids, counts = self._spelled(*_code_points(texts))
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []

    def _spelled(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose code points follow each other, and how many each word has."""
        starts, counts, parts = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64), []
        order = np.argsort(sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1) if len(order) else []:
            size = int(sizes[group[0]])
            step = max(1, CELLS // (size * min(size, self.longest)))
            for at in range(0, len(group), step):
                part = group[at:at + step]
                own = chars[starts[part][:, None] + np.arange(size)]
                lattice = self.lattice(own)
                ends = self.viterbi(lattice) if self.kind == "unigram" else self.merges(lattice)
                rows, first = np.nonzero(ends)
                ids = lattice[rows, first, ends[rows, first] - first - 1].astype(np.int64)
                bad = np.flatnonzero(ids < 0)
                if len(bad):
                    # A single character without a piece: its bytes.
                    spelled = [chr(c).encode("utf-8", "replace") for c in own[rows[bad], first[bad]].tolist()]
                    times = np.ones(len(ids), np.int64)
                    times[bad] = [len(b) for b in spelled]
                    ids, rows = np.repeat(ids, times), np.repeat(rows, times)
                    ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
                counts[part] = np.bincount(rows, minlength=len(part))
                parts.append((part, ids))
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for part, ids in parts:
            out[ranges(first[part], counts[part])] = ids
        return out, counts

    @cached_property
    def seen(self) -> Packed:
        """Words met so far, a task's own: their ids, how many, and whether the first takes the space before the word."""
        return Packed.none(2)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def _known(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixed: np.ndarray) -> tuple[Packed, np.ndarray]:
        """Words with the ids of all given ones, which have distinct hashes, and where each of these is.

        A word that has a space before it is encoded with that; if its first piece is the space
        alone, this id is left out.
        """
        seen = self.seen
        new = np.flatnonzero(~np.isin(hashes, seen.hashes))
        if len(new):
            with_space = prefixed[new]
            chars, sizes = _characters(buf, starts[new], ends[new])
            longer = sizes + with_space
            at = np.cumsum(longer) - longer
            spaced = np.full(int(longer.sum()), ord(_SPACE), np.uint32)
            spaced[ranges(at + with_space, sizes)] = chars
            ids, counts = self._spelled(spaced, longer)
            first = np.cumsum(counts) - counts
            alone = with_space & (ids[first] == self.singles.get(_SPACE, -1))
            seen = seen.plus(hashes[new], ids, first + alone, counts - alone, (with_space & ~alone).astype(np.int64))
        self.seen = seen if len(seen.hashes) <= REMEMBERED else Packed.none(2)
        return seen, np.searchsorted(seen.hashes, hashes)

    def run(self, count: int) -> list[int]:
        """Ids of ``count`` spaces on their own."""
        if self.kind == "unigram":
            return self.words([_SPACE * count])[0].tolist()
        parts, left = [1] * count, 0
        # The leftmost merge of equal ones first; a merge can only make one to its left possible again.
        while left < len(parts) - 1:
            if parts[left] + parts[left + 1] in self.spaces:
                end = left + 1
                parts[left:end + 1] = [parts[left] + parts[end]]
                left = max(0, left - 1)
            else:
                left += 1
        return [self.spaces[p] for p in parts]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the n + 1 offsets of the texts in them. A null or empty text has none."""
        texts = pc.replace_substring(texts.cast(pa.large_string()), _SPACE, " ")
        buf, offsets = joined(texts)
        alone = self.alone[buf]
        inside = np.zeros(len(buf) + 2, bool)
        inside[1:-1] = (buf != 32) & ~alone
        edge = np.zeros(len(buf) + 1, bool)
        edge[offsets] = True
        first = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        last = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        single = np.flatnonzero(alone)
        starts, ends = np.concatenate([first, single]), np.concatenate([last, single + 1])
        order = np.argsort(starts, kind="stable")
        starts, ends, is_word = starts[order], ends[order], order < len(first)
        of = np.searchsorted(offsets, starts, "right") - 1
        opens = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
        gap = starts - np.where(opens, offsets[of], np.concatenate([[0], ends[:-1]])) + opens
        prefixed = gap > 0

        hashes = hash_spans(buf, starts, ends) ^ np.where(is_word & prefixed, np.uint64(0), np.uint64(0x5DEECE66D))
        hashes, sample, kind = np.unique(hashes, return_index=True, return_inverse=True)
        seen, place = self._known(hashes, buf, starts[sample], ends[sample], is_word[sample] & prefixed[sample])
        held, takes = (c[place] for c in seen.columns)
        run = gap - takes[kind]
        counts_per_text = np.bincount(of, minlength=len(texts))
        last_end = offsets[:-1].copy()
        last_end[of] = ends  # the last event of a text wins
        tail = offsets[1:] - last_end + ((counts_per_text == 0) & (np.diff(offsets) > 0))
        # Atoms: words, then runs of spaces. Each event is a run and a word; each text ends in a run.
        lengths, run_kind = np.unique(np.concatenate([run, tail]), return_inverse=True)
        runs = [np.array(self.run(int(k)), np.int32) for k in lengths]
        run_sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        where = np.arange(len(of)) * 2 + of
        sequence = np.empty(2 * len(of) + len(texts), np.int64)
        sequence[where] = len(place) + run_kind[:len(of)]
        sequence[where + 1] = kind
        closing = 2 * np.cumsum(counts_per_text) + np.arange(len(texts))
        sequence[closing] = len(place) + run_kind[len(of):]
        sizes = np.concatenate([held, run_sizes])
        firsts = np.concatenate([seen.firsts[place], len(seen.values) + np.cumsum(run_sizes) - run_sizes])
        flat = np.concatenate([seen.values, *runs]).astype("<u4")
        counts = sizes[sequence]
        ids = flat[ranges(firsts[sequence], counts)]
        return ids, np.concatenate([[0], np.cumsum(counts)[closing]])

    @cached_property
    def texts(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all pieces one after another, and their offsets."""
        own = [p.replace(_SPACE, " ").encode() if u else b"" for p, u in zip(self.pieces, self.usable)]
        own[self.unknown] = " ⁇ ".encode()
        for byte, i in enumerate(self.byte_ids):
            if i != self.unknown:
                own[i] = bytes([byte])
        return np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of sequences of ids; bytes that are no UTF-8 become U+FFFD."""
        flat, at = self.texts
        counts = at[ids + 1] - at[ids]
        buf = flat[ranges(at[ids], counts)]
        edges = np.concatenate([[0], np.cumsum(counts)])[offsets]
        # The space put before each text goes again.
        drop = edges[:-1][np.diff(edges) > 0]
        keep = np.ones(len(buf), bool)
        keep[drop[buf[drop] == 32]] = False
        edges = np.concatenate([[0], np.cumsum(keep)])[edges]
        binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(buf[keep])])
        try:
            return binary.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([b.as_py().decode("utf-8", "replace") for b in binary], pa.large_string())


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and how many each has."""
    return np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"), np.fromiter(map(len, texts), np.int64, len(texts))


def _characters(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for spans of UTF-8, none of them empty."""
    sizes = ends - starts
    data = buf[ranges(starts, sizes)]
    begins = (data & 0xC0) != 0x80
    first = np.cumsum(sizes) - sizes
    if begins[first].all():
        try:
            return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), np.add.reduceat(begins, first, dtype=np.int64)
        except UnicodeDecodeError:
            pass
    whole = data.tobytes()
    return _code_points([whole[a:a + n].decode("utf-8", "replace") for a, n in zip(first.tolist(), sizes.tolist())])


def _hashes(chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each text, character by character."""
    starts, hashes = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.uint64)
    for k in range(int(sizes.max(initial=0))):
        more = np.flatnonzero(sizes > k)
        hashes[more] = mix(hashes[more] + chars[starts[more] + k].astype(np.uint64))
    return hashes


def encode_pieces(docs: DataFrame, model: PieceModel, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (binary, little-endian uint32), which replace a column of that name.

    Null and empty texts have no ids. U+2581 in a text counts as a space, as the library has it.
    """

    def run(texts: pa.Array):
        ids, offsets = model.encode(texts)
        return [pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer((4 * offsets).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))]).cast(pa.binary())]

    return add_columns(docs, text_col, run, f"`{out}` binary", CHUNK_BYTES)


def decode_pieces(docs: DataFrame, model: PieceModel, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of each sequence of ids, which replaces a column of that name; null ids give an empty text."""

    def run(sequences: pa.Array):
        buf, offsets = joined(sequences)
        return [model.decode(np.frombuffer(buf.tobytes(), "<u4").astype(np.int64), offsets // 4).cast(pa.string())]

    return add_columns(docs, ids_col, run, f"`{out}` string", CHUNK_BYTES)
