"""Removal of byte strings that occur twice, by suffix arrays over the parts that can repeat.

Every ``length``-byte string has an anchor, the smallest hash among its ``GRAM``-byte
substrings; equal strings have equal anchors. Round 1 counts the anchors of all documents.
Consecutive starts with one anchor form a run; only runs whose anchor occurs twice are sent,
as text, to the task of that anchor. There a suffix array is built by two-stage sorting:
suffixes smaller than their successor are sorted directly, the others are induced by
scanning the buckets of first bytes, and neighbours with a common prefix of ``length`` bytes
are the repeated strings. What a block needs to read the verdicts on its runs it sends to itself.

An anchor of very many runs (a passage that a third of the documents share, each with its
own surroundings) would make one large group. Its runs are cut into pieces of ``PIECE``
starts, counted from the anchor. All strings of a piece share a core of ``length - PIECE + 1``
bytes, and equal strings fall into pieces with equal cores; round 2 asks which cores occur twice, and those
pieces are sent to the task of their core.

Passages of so many whole words that are shorter than ``length`` go the same way: their starts
are words instead of bytes, only suffixes that begin with a word are sorted, their strings end
with their last word, and a hot run of them is cut into single strings. Both kinds never meet
in one group.
"""

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from beaconry.llm.routed import Blocks, answer, cuts
from beaconry.llm.text import joined, mix, prefix_hashes, ranges, slices, span_hashes, word_spans

GRAM, PIECE = 32, 4
# Anchors of more runs than this are cut into pieces.
HOT_RUNS = 1000
BLOCK_BYTES, SHARD_BYTES, SLICE_BYTES, SORT_BYTES = 4 << 20, 12 << 20, 1 << 19, 1 << 18
# Bytes of strings that are compared at a time.
EQUAL_BYTES = 1 << 19
# Random 64-bit value of each byte, from a rule.
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_RESPREAD, _PASSAGES = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_RESULTS = ("kept", "n_bytes", "n_removed", "n_spans", "n_repeated")
_FIRST, _SECOND = 0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB
# Begins what a block sends to itself; other messages begin with their number of parts, which is less.
_OWN = b"\xff" * 4


def _sorted_directly(text: bytes, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` of at least two bytes each, by the ``depth`` bytes from there."""
    if not len(starts):
        return starts
    # By their first two bytes, then within each such bucket, so that few keys are held at once.
    t = np.frombuffer(text, np.uint8)
    pairs = t[starts].astype(np.uint16) << np.uint16(8) | t[starts + 1]
    order = np.argsort(pairs, kind="stable")
    starts = starts[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(pairs[order])) + 1, [len(starts)]]).tolist()
    for a, b in zip(edges, edges[1:]):
        if b - a > 1:
            part = starts[a:b]
            keys = list(map(text.__getitem__, map(slice, part.tolist(), (part + depth).tolist())))
            starts[a:b] = part[sorted(range(b - a), key=keys.__getitem__)]
    return starts


def suffix_order(text: bytes, depth: int) -> np.ndarray:
    """All suffix starts, ordered by their first ``depth`` bytes (at least)."""
    t = np.frombuffer(text, np.uint8)
    n = len(t)
    if not n:
        return np.zeros(0, np.int32)
    # A suffix is small if its first byte that differs from the next one is smaller; the last one is not.
    at = np.full(n, n, np.int32)
    differs = np.flatnonzero(t[1:] != t[:-1])
    at[differs] = differs
    at[-1] = n - 1
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = (t[at] < np.append(t[1:], np.uint8(0))[at]) & (at < n - 1)
    del at, differs
    direct = _sorted_directly(text, np.flatnonzero(small).astype(np.int32), depth)
    first = t[direct]
    edges = np.searchsorted(first, np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[t[-1]].append(np.array([n - 1], np.int32))
    out = []

    def scan(placed: np.ndarray, byte: int) -> np.ndarray:
        """Put the larger suffixes in front of ``placed`` behind each other in their buckets; those of ``byte`` come back."""
        before = placed[placed > 0] - 1
        before = before[~small[before]]
        bucket = t[before]
        order = np.argsort(bucket, kind="stable")
        before, bucket = before[order], bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1))
        own = before[:0]
        for part, b in zip(np.split(before, starts[1:]), bucket[starts]):
            if b == byte:
                own = part
            else:
                induced[b].append(part)
        return own

    for byte in np.unique(t).tolist():
        front = np.concatenate(induced[byte]) if induced[byte] else direct[:0]
        while len(front):
            out.append(front)
            front = scan(front, byte)
        placed = direct[edges[byte]:edges[byte + 1]]
        if len(placed):
            out.append(placed)
            scan(placed, byte)
    return np.concatenate(out)


def common_prefixes(text: bytes, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` and the one before it, up to ``limit``; 0 for the first."""
    padded = np.frombuffer(text + bytes(limit + 8), np.uint8)
    lanes = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    shared = np.zeros(len(order), np.int64)
    todo = np.arange(1, len(order))
    for at in range(0, limit, 8):
        differ = lanes[order[todo] + at] ^ lanes[order[todo - 1] + at]
        ended = differ != 0
        low = differ[ended] & (~differ[ended] + np.uint64(1))
        shared[todo[ended]] = at + np.log2(low.astype(np.float64)).astype(np.int64) // 8
        todo = todo[~ended]
        if not len(todo):
            break
    shared[todo] = limit
    room = len(text) - order
    return np.minimum(shared, np.minimum(limit, np.minimum(room, np.roll(room, 1))))


def repeated_starts(parts: list[bytes], length: int) -> np.ndarray:
    """For all starts of ``length``-byte strings of all parts: whether the string occurs twice."""
    sizes = np.array([len(p) for p in parts])
    firsts = np.cumsum(sizes) - sizes
    starts = ranges(firsts, np.maximum(0, sizes - length + 1))
    text = b"".join(parts)
    inside = np.zeros(len(text), bool)
    inside[starts] = True
    order = suffix_order(text, length)
    order = order[inside[order]]
    equal = 1 + _equal_strings(text, order[:-1], order[1:], length)
    twice = np.zeros(len(text), bool)
    twice[order[equal]] = True
    twice[order[equal - 1]] = True
    return twice[starts]


def _equal_strings(text: bytes, one: np.ndarray, two: np.ndarray, length: int) -> np.ndarray:
    """Places of ``one`` and ``two`` whose ``length`` bytes from there, at least 8, are equal."""
    lanes = np.ndarray(max(0, len(text) - 7), "<u8", text, strides=(1,))
    whole = np.ndarray((max(0, len(text) - length + 1), length // 8), "<u8", text, strides=(1, 8))
    at = np.arange(len(one))
    for offset in (length - 8, 0):
        at = at[lanes[one[at] + offset] == lanes[two[at] + offset]]
    step = max(1, EQUAL_BYTES // length)
    parts = [at[a:a + step] for a in range(0, len(at), step)]
    return np.concatenate([part[(whole[one[part]] == whole[two[part]]).all(axis=1)] for part in parts]) if parts else at


def repeated_passages(parts: list[bytes], n_words: int, longest: int) -> np.ndarray:
    """For all strings of ``n_words`` whole words of all parts, below ``longest`` bytes each: whether it occurs twice."""
    text = b"".join(parts)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    begins, ends, at = word_spans(np.frombuffer(text, np.uint8), offsets)
    words = ranges(at[:-1], np.maximum(0, np.diff(at) - n_words + 1))
    starts, sizes = begins[words], ends[words + n_words - 1] - begins[words]
    string = np.full(len(text), -1)
    string[starts] = np.arange(len(starts))
    order = _sorted_directly(text, starts, longest)
    shared, size = common_prefixes(text, order, longest), sizes[string[order]]
    twice = np.zeros(len(starts), bool)
    # Next to an equal string may stand longer ones that begin with it; the common prefix with the
    # first equal one behind is the least on the way.
    active, step, least = np.arange(len(order) - 1), 1, np.full(max(0, len(order) - 1), longest)
    while len(active):
        least = np.minimum(least, shared[active + step])
        within = least >= size[active]
        active, least = active[within], least[within]
        equal = size[active + step] == size[active]
        twice[string[order[active[equal]]]] = True
        twice[string[order[active[equal] + step]]] = True
        on = ~equal & (active + step + 1 < len(order))
        active, least, step = active[on], least[on], step + 1
    return twice


def _smaller_before(first: np.ndarray, last: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """The end of the nearest stretch before each that holds a smaller value and is less than ``width`` away, or one ``width`` away."""
    found, todo, step = first - width, np.arange(1, len(first)), 1
    while len(todo):
        near, smaller = first[todo] - last[todo - step] < width, values[todo - step] < values[todo]
        hit = todo[near & smaller]
        found[hit] = last[hit - step]
        step += 1
        todo = todo[near & ~smaller]
        todo = todo[todo >= step]
    return found


def _windows(at: np.ndarray, values: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows of ``width`` of ``n`` values whose minimum each place holds; none if last < first.

    ``at`` are places in order, among them all that hold such a minimum.
    """
    if not len(at):
        return at, at
    # Equal values next to each other are bounded by the same smaller ones.
    new = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    ends, of = np.append(new[1:], len(at)) - 1, np.repeat(np.arange(len(new)), np.diff(np.append(new, len(at))))
    before = _smaller_before(at[new], at[ends], values[new], width)
    behind = -_smaller_before(-at[ends][::-1], -at[new][::-1], values[new][::-1], width)[::-1]
    return np.maximum(np.maximum(before[of] + 1, at - width + 1), 0), np.minimum(np.minimum(behind[of] - width, at), n - width)


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the minimum of some ``width`` consecutive values; any longer stretch has its minimum at one."""
    # Half of a window lies before or behind its minimum.
    half = 1
    lowest = values
    while 2 * half <= (width + 1) // 2:
        lowest = np.minimum(lowest[:-half], lowest[half:])
        half *= 2
    if len(values) < width:
        return np.zeros(0, np.int64)
    least = np.zeros(len(values), bool)
    n = len(lowest)
    least[:n] = lowest == values[:n]
    least[half - 1:] |= lowest == values[half - 1:]
    at = np.flatnonzero(least)
    first, last = _windows(at, values[at], width, len(values))
    return at[first <= last]


def _number_before(places: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """How many of the ordered ``places`` lie before each of the ordered ``limits``; there are fewer places."""
    return np.cumsum(np.bincount(np.searchsorted(limits, places, "right"), minlength=len(limits) + 1))[:len(limits)]


def _grams(prefix: tuple[np.ndarray, np.ndarray], starts, ends) -> np.ndarray:
    """Hashes of substrings of one length. Their values are random sums, so their order is too, without a last mix."""
    sums, inverse = prefix
    return (sums[ends] - sums[starts]) * inverse[starts]


class _Runs:
    """Runs of starts with one anchor, over the texts of a block.

    ``lo`` and ``hi`` are the first and last start: bytes or, where ``by_word``, words of the block.
    """

    def __init__(self, texts: pa.Array, length: int, n_words: int = 0, digest: bool = True):
        self.length, self.n_words = length, n_words
        self.buf, self.offsets = joined(texts)
        self.begins, self.ends, words = word_spans(self.buf, self.offsets) if n_words else [self.offsets[:0]] * 3
        width = length - GRAM + 1
        lo, hi, anchors, by_word, digests, keys, counts = [], [], [], [], [], [], []
        for a, b in slices(texts, SLICE_BYTES):
            base = self.offsets[a]
            offsets = self.offsets[a:b + 1] - base
            data = self.buf[base:base + offsets[-1]]
            values = _VALUES[data]
            if len(values) < GRAM:
                continue
            prefix, other = prefix_hashes(values, _FIRST), prefix_hashes(values, _SECOND) if digest else None
            grams = _grams(prefix, slice(-GRAM), slice(GRAM, None))

            def add(first, last, start, stop, anchor, words):
                lo.append(first)
                hi.append(last)
                anchors.append(anchor)
                by_word.append(np.full(len(first), words))
                if digest:
                    digests.append((span_hashes(prefix, start, stop), span_hashes(other, start, stop)))

            # Passages of words of a letter are the shortest; among their minima are those of all longer strings.
            low = _minima(grams, min(width, max(1, 2 * n_words - GRAM)) if n_words else width)
            least = grams[low]
            first, last = _windows(low, least, width, len(grams))
            # Of those windows, the ones that are strings of one text: the last one's or else the first one's.
            # They are fewer than ``width`` and so no strings of two texts.
            text, earlier = (np.clip(np.searchsorted(offsets, x, "right"), 1, b - a) for x in (last, first))
            begin, end = np.maximum(first, offsets[text - 1]), np.minimum(last, offsets[text] - length)
            first, last = np.where(begin <= end, begin, first), np.where(begin <= end, end, np.minimum(last, offsets[earlier] - length))
            some = first <= last
            first, last, anchor = first[some], last[some], least[some]
            keys.append(mix(anchor + _RESPREAD))
            counts.append(np.ones(len(anchor), np.int64))
            # Equal minima share windows; a run's strings follow each other.
            first[1:] = np.maximum(first[1:], last[:-1] + 1)
            some = first <= last
            first, last, anchor = first[some], last[some], anchor[some]
            new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (first[1:] != last[:-1] + 1))[:len(first)])
            first, last, anchor = first[new], last[np.append(new[1:], len(last))[:len(new)] - 1], anchor[new]
            add(first + base, last + base, first, last + length, anchor, False)
            if n_words:
                n_before = words[a]
                begin, end = (x[n_before:words[b]] - base for x in (self.begins, self.ends))
                stop, start = end[n_words - 1:], begin[:max(0, len(begin) - n_words + 1)]
                of = np.repeat(np.arange(b - a), np.diff(words[a:b + 1]))
                word = np.flatnonzero((of[:len(start)] == of[n_words - 1:]) & (stop - start < length))
                start, stop = start[word], stop[word]
                least = np.append(least, np.uint64(0))
                edges = np.stack([_number_before(low, start), _number_before(low, stop - GRAM + 1)], axis=1)
                anchor = np.minimum.reduceat(least, edges.ravel())[::2] if len(word) else least[:0]
                # A run's strings follow each other word by word.
                new = np.ones(len(word), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (word[1:] != word[:-1] + 1)
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(word))[:len(first)] - 1
                n_low = edges[last, 1] - edges[first, 0]
                hits = least[ranges(edges[first, 0], n_low)] == np.repeat(anchor[first], n_low)
                keys.append(mix(anchor[first] + _PASSAGES))
                counts.append(np.add.reduceat(hits, np.cumsum(n_low) - n_low).astype(np.int64) if len(first) else first)
                add(word[first] + n_before, word[last] + n_before, start[first], stop[last], anchor[first], True)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        self.lo, self.hi, self.anchor, self.by_word = join(lo, np.int64), join(hi, np.int64), join(anchors, np.uint64), join(by_word, bool)
        self.one, self.two = (join([d[i] for d in digests], np.uint64) for i in range(2))
        # Anchors are minima and so all small; mixed anew, they spread evenly over key ranges.
        self.key = mix(self.anchor + np.where(self.by_word, _PASSAGES, _RESPREAD))
        self.keys, at = np.unique(join(keys, np.uint64), return_inverse=True)
        self.counts = np.bincount(at, weights=join(counts, np.int64), minlength=len(self.keys)).astype(np.int64)

    def extent(self, lo: np.ndarray, hi: np.ndarray, by_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte, and the one behind the last, of the strings that start from ``lo`` to ``hi``."""
        first, stop = lo.copy(), hi + self.length
        first[by_word] = self.begins[lo[by_word]]
        stop[by_word] = self.ends[hi[by_word] + self.n_words - 1]
        return first, stop

    def pieces(self, runs: np.ndarray):
        """(index into ``runs``, first start from the run's, number of further starts, core hash, two digests) of all pieces."""
        owner, first, span, cores, one, two = [], [], [], [], [], []
        begin, stop = self.extent(self.lo[runs], self.hi[runs], self.by_word[runs])
        for i, (run, a, b) in enumerate(zip(runs, begin, stop)):
            values = _VALUES[self.buf[a:b]]
            prefix = prefix_hashes(values, _FIRST)
            if self.by_word[run]:
                new = np.arange(self.hi[run] - self.lo[run] + 1)
                start, end = self.extent(self.lo[run] + new, self.lo[run] + new, np.ones(len(new), bool))
                start, end, last = start - a, end - a, new
                cores.append(span_hashes(prefix, start, end) ^ _PASSAGES)
            else:
                at = np.arange(b - a - GRAM + 1)
                places = np.flatnonzero(_grams(prefix, at, at + GRAM) == self.anchor[run])
                starts = np.arange(b - a - self.length + 1)
                place = places[np.searchsorted(places, starts)]  # the leftmost in each string
                step = (place - starts) // PIECE
                new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (np.diff(step, prepend=-1) != 0))
                core = place[new] - PIECE * step[new]
                cores.append(span_hashes(prefix, core, core - PIECE + 1 + self.length))
                last = np.append(new[1:] - 1, len(starts) - 1)
                start, end = new, last + self.length
            owner.append(np.full(len(new), i))
            first.append(new)
            span.append(last - new)
            one.append(span_hashes(prefix, start, end))
            two.append(span_hashes(prefix_hashes(values, _SECOND), start, end))
        join = lambda parts, kind=np.int64: np.concatenate(parts) if parts else np.zeros(0, kind)
        return join(owner), join(first), join(span), *(join(x, np.uint64) for x in (cores, one, two))


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sample of each distinct pair, the distinct pair of each row, and how often it occurs."""
    order = np.lexsort((two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of, np.bincount(of, minlength=int(new.sum()))


def _counted(payloads: list[bytes], code) -> list[bytes]:
    """Payloads of 64-bit keys and 16-bit counts; one byte per key, ``code(total counts)``."""
    sizes = [len(p) // 10 for p in payloads]
    keys = np.concatenate([np.frombuffer(p, "<u8", n) for p, n in zip(payloads, sizes)])
    counts = np.concatenate([np.frombuffer(p, "<u2", n, 8 * n) for p, n in zip(payloads, sizes)])
    _, of = np.unique(keys, return_inverse=True)
    return [x.tobytes() for x in np.split(code(np.bincount(of, weights=counts)[of]).astype(np.uint8), np.cumsum(sizes)[:-1])]


def _packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for x in arrays:
        np.save(out, x)
    return out.getvalue()


def _unpacked(payload: bytes) -> list[np.ndarray]:
    held, arrays = io.BytesIO(payload), []
    while held.tell() < len(payload):
        arrays.append(np.load(held))
    return arrays


def _count_payload(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return keys.astype("<u8").tobytes() + np.minimum(counts, 65535).astype("<u2").tobytes()


def _codes(replies: dict[int, bytes], keys: np.ndarray, shards: int, offset: int) -> np.ndarray:
    return np.frombuffer(b"".join(replies[s + offset] for s, _, _ in cuts(keys, shards)), np.uint8)


def remove_repeated_bytes(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text",
                          block_bytes: int = BLOCK_BYTES, hot_runs: int = HOT_RUNS, passage_words: int = 0, as_text: bool = False) -> DataFrame:
    """``docs`` with, as binary ``kept``, the bytes of each text outside repeated strings, and n_bytes, n_removed, n_spans.

    A byte goes if some ``length`` bytes over it, within one text, also start anywhere else, the
    same text included; strings are judged on the input. n_spans counts maximal removed runs.
    With ``passage_words``, ``n_repeated`` counts the bytes of these strings and of all strings of that
    many whole words (between white space or ends of the text) that occur twice as such. Each repeated
    string is judged by itself: passages that overlap or touch and are all shorter do not add up.
    Null and empty texts have no bytes; rows repeating an id, or without one, are texts of their
    own. Removal may cut a character in two, hence binary. ``as_text`` removes the repeated
    passages too, and gives the text itself instead of ``kept``, without cut characters. Columns
    named like the results are replaced. ``id_col`` is an integer column; ``length`` is at least
    ``GRAM + PIECE``, and passages have at least ``GRAM`` bytes (17 words).
    """
    if length < GRAM + PIECE or passage_words and 2 * passage_words - 1 < GRAM:
        raise ValueError(f"length must be at least {GRAM + PIECE}, passage_words {GRAM // 2 + 1}")
    blocks = Blocks(docs, id_col, text_col, block_bytes)
    text_at = blocks.text_at
    shards = max(1, -(-blocks.bytes // SHARD_BYTES))

    def runs_of(table: pa.Table, digest: bool = True) -> _Runs:
        return _Runs(table[text_at].combine_chunks(), length, passage_words, digest)

    def anchors(table: pa.Table, _) -> dict[int, bytes]:
        runs = runs_of(table, digest=False)
        return {s: _count_payload(runs.keys[a:b], runs.counts[a:b]) for s, a, b in cuts(runs.keys, shards)}

    def anchor_codes(payloads, _) -> list[bytes]:
        return _counted(payloads, lambda n: (n > 1) + (n > hot_runs).astype(int))

    def hot_pieces(runs: _Runs, replies: dict):
        """Runs with a repeated anchor; runs with a hot one, how they are alike, and the pieces of each distinct one."""
        code = _codes(replies, runs.keys, shards, 0)[np.searchsorted(runs.keys, runs.key)] if len(runs.lo) else np.zeros(0, np.uint8)
        hot = np.flatnonzero(code == 2)
        sample, of, times = _distinct(runs.one[hot] ^ np.where(runs.by_word[hot], _PASSAGES, np.uint64(0)), runs.two[hot])
        return np.flatnonzero(code == 1), hot, sample, of, times, runs.pieces(hot[sample])

    def core_keys(table: pa.Table, replies: dict) -> dict[int, bytes]:
        runs = runs_of(table)
        *_, times, (owner, _, _, cores, _, _) = hot_pieces(runs, replies)
        keys, at = np.unique(cores, return_inverse=True)
        counts = np.bincount(at, weights=times[owner], minlength=len(keys))
        return {s + shards: _count_payload(keys[a:b], counts[a:b]) for s, a, b in cuts(keys, shards)}

    def core_codes(payloads, _) -> list[bytes]:
        return _counted(payloads, lambda n: n > 1)

    def items(table: pa.Table, replies: dict):
        """What may repeat: (lo, hi, by word) and kind of every occurrence, and those, key, digests and count of each kind, by key."""
        runs = runs_of(table)
        plain, hot, sample, of, _, (owner, first, span, cores, one, two) = hot_pieces(runs, replies)
        keys, at = np.unique(cores, return_inverse=True)
        keep = (_codes(replies, keys, shards, shards)[at] if len(keys) else cores) > 0
        owner, first, span, cores, one, two = (x[keep] for x in (owner, first, span, cores, one, two))
        # A run has the pieces of the run it equals.
        pieces = np.bincount(owner, minlength=len(sample))
        counts = pieces[of]
        piece = ranges((np.cumsum(pieces) - pieces)[of], counts)
        lo = np.concatenate([runs.lo[plain], np.repeat(runs.lo[hot], counts) + first[piece]])
        hi = lo + np.concatenate([runs.hi[plain] - runs.lo[plain], span[piece]])
        by_word = np.concatenate([runs.by_word[plain], np.repeat(runs.by_word[hot], counts)])
        keys = np.concatenate([runs.key[plain], cores[piece]])
        one, two = np.concatenate([runs.one[plain], one[piece]]), np.concatenate([runs.two[plain], two[piece]])
        # Equal bytes are two kinds if their strings start at bytes in one and at words in the other.
        one = one ^ np.where(by_word, _PASSAGES, np.uint64(0))
        kinds, kind, times = _distinct(one, two)
        order = np.argsort(keys[kinds], kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        kinds = kinds[order]
        return runs, lo, hi, by_word, rank[kind], keys[kinds], one[kinds], two[kinds], kinds, times[order] > 1

    def send(table: pa.Table, replies: dict) -> dict[int, bytes]:
        runs, lo, hi, by_word, kind, keys, one, two, kinds, often = items(table, replies)
        first, stop = runs.extent(lo[kinds], hi[kinds], by_word[kinds])
        starts, marks = (hi - lo + 1)[kinds].astype("<u4"), (often | by_word[kinds].astype(np.uint8) << 1).astype(np.uint8)
        sent = {}
        for s, a, b in cuts(keys, shards):
            parts = [runs.buf[x:y].tobytes() for x, y in zip(first[a:b], stop[a:b])]
            columns = (np.array([b - a], "<u4"), keys[a:b].astype("<u8"), one[a:b].astype("<u8"), two[a:b].astype("<u8"),
                       (stop - first)[a:b].astype("<u4"), starts[a:b], marks[a:b])
            sent[s + 2 * shards] = b"".join([*(c.tobytes() for c in columns), *parts])
        # What the block itself needs to read the answers goes round with them.
        sent[own(table)] = _OWN + _packed(lo.astype("<u4"), (hi - lo).astype("<u4"), by_word, kind.astype("<u4"), starts, np.array(cuts(keys, shards), "<i8"))
        return sent

    def own(table: pa.Table) -> int:
        return 3 * shards + table["b"][0].as_py()

    def sort_shard(payloads, _) -> list[bytes]:
        if payloads[0].startswith(_OWN):
            return payloads
        keys, one, two, starts, marks, begins, ends, sizes = [], [], [], [], [], [], [], []
        for p in payloads:
            n = int(np.frombuffer(p, "<u4", 1)[0])
            for column, kind, at in ((keys, "<u8", 0), (one, "<u8", 8), (two, "<u8", 16), (starts, "<u4", 28), (marks, np.uint8, 32)):
                column.append(np.frombuffer(p, kind, n, 4 + at * n))
            size = np.frombuffer(p, "<u4", n, 4 + 24 * n).astype(np.int64)
            ends.append(4 + 33 * n + np.cumsum(size))
            begins.append(ends[-1] - size)
            sizes.append(n)
        keys, one, two, starts, marks, begins, ends = (np.concatenate(x) for x in (keys, one, two, starts, marks, begins, ends))
        sender = np.repeat(np.arange(len(sizes)), sizes)
        kinds, of, times = _distinct(one, two)
        whole = (times > 1) | (np.bincount(of, weights=marks & 1, minlength=len(kinds)) > 0)
        starts, by_word, keys = starts[kinds].astype(np.int64), (marks[kinds] >> 1).astype(bool), keys[kinds]
        firsts, verdict = np.cumsum(starts) - starts, np.repeat(whole, starts)
        order = np.lexsort((keys, by_word))
        edges = np.flatnonzero(np.append(True, (keys[order][1:] != keys[order][:-1]) | (by_word[order][1:] != by_word[order][:-1]))[:len(order)])
        # Nothing is to be found where every text is repeated as a whole, or there is a single string.
        unknown = np.add.reduceat(np.where(whole[order], 0, starts[order]), edges) if len(order) else edges
        several = np.add.reduceat(starts[order], edges) > 1 if len(order) else edges
        groups = [g for g, u in zip(np.split(order, edges[1:]), (unknown > 0) & several) if u]
        batch, held = [], 0

        def sort() -> None:
            rows = kinds[batch]
            texts = [payloads[i][a:b] for i, a, b in zip(sender[rows].tolist(), begins[rows].tolist(), ends[rows].tolist())]
            found = repeated_passages(texts, passage_words, length) if by_word[batch[0]] else repeated_starts(texts, length)
            verdict[ranges(firsts[batch], starts[batch])] |= found

        for group in groups:
            if batch and (held >= SORT_BYTES or by_word[group[0]] != by_word[batch[0]]):
                sort()
                batch, held = [], 0
            batch += group.tolist()
            held += int((ends[kinds[group]] - begins[kinds[group]]).sum())
        if batch:
            sort()
        edges = np.cumsum([0, *sizes])
        return [np.packbits(verdict[ranges(firsts[of[a:b]], starts[of[a:b]])]).tobytes() for a, b in zip(edges, edges[1:])]

    def remove(table: pa.Table, replies: dict):
        lo, span, by_word, kind, starts, parts = _unpacked(replies[own(table)][len(_OWN):])
        lo, span, starts = (x.astype(np.int64) for x in (lo, span, starts))
        flags = [np.unpackbits(np.frombuffer(replies[s + 2 * shards], np.uint8), count=int(starts[a:b].sum())) for s, a, b in parts.tolist()]
        flags = np.concatenate(flags) if flags else np.zeros(0, np.uint8)
        found = flags[ranges((np.cumsum(starts) - starts)[kind], span + 1)].astype(bool)
        at, word = ranges(lo, span + 1)[found], np.repeat(by_word, span + 1)[found]
        del lo, span, by_word, kind, starts, flags, found, replies
        buf, offsets = joined(table[text_at].combine_chunks())
        n = len(buf)

        def covered(first, stop) -> np.ndarray:
            # No two strings of a kind start, or end, at one place.
            edges = np.zeros(n + 1, np.int8)
            edges[first] += 1
            edges[stop] -= 1
            return np.cumsum(edges[:n], dtype=np.int32) > 0

        gone = covered(at[~word], at[~word] + length)
        repeated = gone
        if passage_words:
            begins, ends, _ = word_spans(buf, offsets)
            repeated = gone | covered(begins[at[word]], ends[at[word] + passage_words - 1])
        gone = repeated if as_text else gone
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        spans = gone & (np.concatenate([[True], ~gone[:-1]]) | edge[:n]) if n else gone
        per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
        n_bytes, n_removed = np.diff(offsets), per_text(gone)
        places = [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n_bytes - n_removed)]).astype(np.int64)), pa.py_buffer(buf[~gone])]
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n_bytes), places)
        columns = {"n_bytes": pa.array(n_bytes), "n_removed": pa.array(n_removed), "n_spans": pa.array(per_text(spans)), "n_repeated": pa.array(per_text(repeated))}
        return (_readable(kept), columns) if as_text else (table[text_at], {"kept": kept.cast(pa.binary()), **columns})

    known = answer(blocks.ask(anchors), anchor_codes)
    known = known.unionByName(answer(blocks.ask(core_keys, known), core_codes))
    known = known.unionByName(answer(blocks.ask(send, known), sort_shard))
    extra = f"{'' if as_text else 'kept binary, '}n_bytes bigint, n_removed bigint, n_spans bigint{', n_repeated bigint' if passage_words else ''}"
    return blocks.finish(remove, known, extra)


def _readable(kept: pa.LargeBinaryArray) -> pa.Array:
    """As text, without characters cut in two; rows one by one only where some are cut."""
    text = kept.view(pa.large_string())
    try:
        text.validate(full=True)
    except pa.ArrowInvalid:
        text = pa.array((p.as_py().decode("utf-8", "ignore") for p in kept), pa.large_string())
    return text.cast(pa.string())


def drop_repeated_text(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the text that :func:`remove_repeated_bytes` keeps, without characters cut in two.

    Null texts become empty. Columns named like the results are left out.
    """
    kept = remove_repeated_bytes(docs, text_col=text_col, as_text=True, **options)
    return kept.select(*[c for c in docs.columns if c not in _RESULTS])
