"""Toxicity by noisy-channel deobfuscation.

Suspicious tokens (letters mixed with look-alike digits and signs, look-alikes alone, a letter
three times in a row, several doubled letters, letters spaced out) become lattices: each sign may be a letter it looks like, a repeated
letter may be one, a separator may be nothing. Viterbi search under a character trigram model of the
corpus gives the likeliest readings; all other tokens read as they are. The restored text is
scored by a logistic model over the words and word beginnings that mark toxic documents.
"""

from dataclasses import dataclass, field
from math import inf
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from beaconry.llm.text import add_columns, bounded_batches, hash_spans, joined, mix, ranges, slices, word_spans
from beaconry.plans.lineage import scratch_path

# Labelled documents the scorer is fitted on, at most about.
SAMPLE_DOCS = 20_000
READINGS, PIECE = 3, 64
# Readings of spaced-out letters, where each gap may end a word, and of pieces of long tokens.
MORE_READINGS = 8
# Bytes of text looked at together.
SLICE_BYTES = 1 << 20
_PREFIXES = (4, 5, 6)
# How often a word or beginning must be in a text to count once, twice, ...
LEVELS = np.array([1, 2, 3, 5])

# Letters that digits and signs are used for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
# Costs in nats: a look-alike, a dropped repetition, a sign that ends a word; dropped signs:
# plain separators, look-alikes at an end, look-alikes between letters.
_SWAP, _REPEAT, _BREAK = 1.0, 0.5, 4.0
_DROP, _DROP_EDGE, _DROP_SIGN = 0.7, 3.0, 6.0
# Between spaced-out letters: a space that ends a word, wider space that does, wider space dropped.
_BREAK_SPACE, _BREAK_WIDE, _DROP_WIDE = 3.0, 0.3, 6.0
_SPACE, _WIDE = " ", "\n"
# Gained by each letter read, so that short readings are not likelier for being short.
_LETTER_BONUS = 2.5

_BREAK_CODE, _OTHER_CODE = 0, 27
_CODE = np.zeros(256, np.uint8)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[0xC0:] = _OTHER_CODE
_LETTER = (_CODE > 0) | (np.arange(256) >= 128)
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKALIKES if ord(c) < 128]] = True
# Look-alikes that stand for certain letters and are no digits: these alone may be a word.
_TELLING = _SIGN.copy()
_TELLING[[*range(48, 58), ord("*")]] = False
_WIDE_SIGNS = [np.frombuffer(c.encode(), np.uint8) for c in LOOKALIKES if ord(c) >= 128]
_SINGLE = (_LETTER & (np.arange(256) < 128)) | _SIGN


def trigrams(texts: pa.Array) -> np.ndarray:
    """Counts of character trigrams (a-z, other letters, breaks) of the texts."""
    buf, offsets = joined(texts)
    codes = np.zeros(len(buf) + len(offsets) + 1, np.int64)
    codes[np.arange(len(buf)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = _CODE[buf]
    continued = np.zeros(len(codes), bool)
    continued[np.arange(len(buf)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = (buf >= 0x80) & (buf < 0xC0)
    codes = codes[~continued]
    return np.bincount(codes[:-2] * 784 + codes[1:-1] * 28 + codes[2:], minlength=28 ** 3)


def _costs(counts: np.ndarray) -> list:
    """Nats of a character after two others, smoothed by shorter contexts."""
    three = counts.reshape(28, 28, 28).astype(float)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + 28)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    p3 = (three + 20 * p2) / (three.sum(2, keepdims=True) + 20)
    return (-np.log(p3)).tolist()


@dataclass
class Decoder:
    """Readings of tokens under a trigram model."""

    counts: np.ndarray
    known: dict = field(default_factory=dict)

    def __post_init__(self):
        self.cost = _costs(self.counts)

    def __getstate__(self):
        return {"counts": self.counts}

    def __setstate__(self, state):
        self.__init__(**state)

    def readings(self, token: str) -> list[str]:
        """The likeliest distinct readings of a token, best first; breaks between words are spaces.

        A token of more than ``PIECE`` characters is read as a whole. So few readings differ in few
        places only, so pieces of it, each overlapping the next by half, are read as well: their other
        words are a last reading.
        """
        token = token.lower()
        if len(token) > PIECE:
            whole = self._viterbi(token)
            pieces = [self._viterbi(token[i:i + PIECE], MORE_READINGS) for i in range(0, len(token) - PIECE // 2, PIECE // 2)]
            words = {w for text in whole for w in text.split()}
            others = {w: None for piece in pieces for text in piece for w in text.split() if w not in words}
            return [*whole, " ".join(others)]
        if token not in self.known:
            if len(self.known) > 50_000:
                self.known = {}
            self.known[token] = self._viterbi(token)
        return self.known[token]

    def _viterbi(self, token: str, keep: int = READINGS) -> list[str]:
        """List Viterbi over a lower-case token: the state is the last two codes, and keeps its best few texts.

        The text of a long token is a linked list of (characters before, character), next to a hash that
        tells it from others.
        """
        cost = self.cost
        # A word of signs alone begins with one that is a letter.
        edges = (0, len(token) - 1) if any(c.isalpha() for c in token) else (len(token) - 1,)
        keep = MORE_READINGS if _SPACE in token or _WIDE in token else keep
        long = len(token) > PIECE
        states = {(0, 0): [(0.0, 0, None) if long else (0.0, "", "")]}
        for i, c in enumerate(token):
            letters = [(c, -_LETTER_BONUS)] if c.isalpha() else [(x, _SWAP - _LETTER_BONUS) for x in LOOKALIKES.get(c, "")]
            letters = [(x, extra, ord(x) - 96 if "a" <= x <= "z" else _OTHER_CODE) for x, extra in letters]
            again = i > 0 and token[i - 1] == c
            noise, ended = inf, _BREAK
            if c in (_SPACE, _WIDE):
                noise, ended = (_DROP, _BREAK_SPACE) if c == _SPACE else (_DROP_WIDE, _BREAK_WIDE)
            elif not c.isalpha():
                noise = _DROP if c not in LOOKALIKES or c == "*" else _DROP_EDGE if i in edges else _DROP_SIGN
            new: dict = {}
            for (a, b), texts in states.items():
                row = cost[a][b]
                for spent, known, text in texts:
                    for x, extra, code in letters:
                        more = (spent + extra + row[code], _added(known, x), (text, x)) if long else (spent + extra + row[code], known + x, x)
                        if (b, code) in new:
                            new[b, code].append(more)
                        else:
                            new[b, code] = [more]
                        if again and text and (text[1] if long else text) == x:
                            new.setdefault((a, b), []).append((spent + _REPEAT, known, text))
                    if noise < inf:
                        # A sign is noise inside a word, or ends it.
                        new.setdefault((a, b), []).append((spent + noise, known, text))
                        if b != _BREAK_CODE:
                            new.setdefault((b, _BREAK_CODE), []).append((spent + ended + row[_BREAK_CODE], _added(known, " "), (text, " ")) if long else (spent + ended + row[_BREAK_CODE], known + " ", " "))
            states = {key: _best(texts, keep) for key, texts in new.items()}
        ends = [(spent + (cost[a][b][0] if b else 0.0), known, text) for (a, b), texts in states.items() for spent, known, text in texts]
        return [_spelled(text) if long else known for _, known, text in _best(ends, keep)]

    def features(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature hash) of the words and word beginnings of the restored texts."""
        buf, offsets = joined(texts)
        buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
        starts, ends, docs = word_spans(buf, offsets)
        of = np.repeat(np.arange(len(texts)), np.diff(docs))
        upto = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        letter, sign, telling = _LETTER[buf], _SIGN[buf], _TELLING[buf]
        wide_sign = np.zeros(len(buf) + 1, np.int64)
        for c in _WIDE_SIGNS:
            at = np.flatnonzero(np.logical_and.reduce([buf[i:len(buf) - len(c) + 1 + i] == x for i, x in enumerate(c)])) if len(buf) >= len(c) else np.zeros(0, np.int64)
            wide_sign[at] = len(c)
            sign[at] = telling[at] = True
            letter[ranges(at, np.full(len(at), len(c)))] = False
        n_letters, n_signs, n_telling = upto(letter), upto(sign), upto(telling)
        triple = np.zeros(len(buf), bool)
        triple[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & _LETTER[buf[2:]]
        n_triples = upto(triple)
        double = np.zeros(len(buf), bool)
        double[1:] = (buf[1:] == buf[:-1]) & (buf[1:] >= 97) & (buf[1:] <= 122)
        n_doubles = upto(double)
        # Punctuation around a word does not belong to it.
        word = letter | ((buf >= 48) & (buf <= 57))
        first, last = starts.copy(), ends.copy()
        todo = np.arange(len(starts))
        while len(todo):
            todo = todo[(first[todo] < last[todo]) & ~word[np.minimum(first[todo], len(buf) - 1)]]
            first[todo] += 1
        todo = np.arange(len(starts))
        while len(todo):
            todo = todo[(last[todo] > first[todo]) & ~word[last[todo] - 1]]
            last[todo] -= 1
        inner = n_letters[last] - n_letters[first]
        odd = ((inner > 0) & ((n_signs[ends] - n_signs[starts] > 0) | (inner < last - first))) | (n_triples[ends] > n_triples[np.minimum(starts + 2, ends)])
        odd |= (inner == 0) & (n_telling[ends] > n_telling[starts]) & (n_signs[ends] - n_signs[starts] > 1)
        # Many a word has two doubled letters, so that these are also read as they are.
        doubled = ~odd & (n_doubles[ends] - n_doubles[np.minimum(starts + 1, ends)] > 1)
        # Three or more single characters in a row may be words spaced out; the gaps between them stay.
        single = (ends - starts == 1) & _SINGLE[buf[np.minimum(starts, max(0, len(buf) - 1))]] | (ends - starts == wide_sign[starts])
        breaks = np.flatnonzero(np.diff(np.concatenate([[0], single, [0]])) != 0) if len(single) else np.zeros(0, np.int64)
        spaced, data = [], buf.tobytes()
        for a, b in zip(breaks[::2], breaks[1::2]):
            for c, d in zip(*_same_text(of, a, b)):
                if d - c >= 3:
                    wide = (starts[c + 1:d] - ends[c:d - 1] > 1) | (buf[ends[c:d - 1]] == 10)
                    gaps = [*np.where(wide, _WIDE, _SPACE), ""]
                    spaced.append((of[c], "".join(data[x:y].decode() + gap for x, y, gap in zip(starts[c:d], ends[c:d], gaps))))
        plain = ~odd & (inner > 0)
        docs_of, hashes = [of[plain]], [hash_spans(buf, first[plain], last[plain])]
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        lanes = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
        for size in _PREFIXES:
            long = plain & (last - first > size)
            docs_of.append(of[long])
            hashes.append(mix((lanes[first[long]] & np.uint64((1 << 8 * size) - 1)) + np.uint64(size << 56)))
        tokens = spaced + [(of[i], data[starts[i]:ends[i]].decode("utf-8", "replace")) for i in np.flatnonzero(odd | doubled)]
        owners, words = [], []
        for owner, token in tokens:
            for reading in self.readings(token):
                for w in reading.split():
                    owners.append(owner)
                    words.append(w.encode())
        if words:
            owners = np.array(owners)
            sizes = np.array([len(w) for w in words])
            text = np.frombuffer(b"".join(words), np.uint8)
            at = np.cumsum(sizes) - sizes
            docs_of.append(owners)
            hashes.append(hash_spans(text, at, at + sizes))
            lanes = np.ndarray(len(text) + 1, "<u8", np.concatenate([text, np.zeros(8, np.uint8)]), strides=(1,))
            for size in _PREFIXES:
                long = sizes > size
                docs_of.append(owners[long])
                hashes.append(mix((lanes[at[long]] & np.uint64((1 << 8 * size) - 1)) + np.uint64(size << 56)))
        return np.concatenate(docs_of), np.concatenate(hashes)


def _added(known: int, char: str) -> int:
    """Hash of a text and one more character, from the text's."""
    return (known * 1_000_003 + ord(char)) % ((1 << 61) - 1)


def _spelled(text: tuple | None) -> str:
    chars = []
    while text:
        text, char = text
        chars.append(char)
    return "".join(reversed(chars))


def _best(texts: list, keep: int) -> list:
    """The cheapest few distinct texts."""
    if len(texts) == 1:
        return texts
    out: list = []
    for path in sorted(texts, key=itemgetter(0, 1)):
        if all(path[1] != known for _, known, _ in out):
            out.append(path)
            if len(out) == keep:
                break
    return out


def _same_text(of: np.ndarray, a: int, b: int) -> tuple[list, list]:
    """The parts of words [a, b) that lie in one text each."""
    cut = [a, *(a + 1 + np.flatnonzero(np.diff(of[a:b]))), b]
    return cut[:-1], cut[1:]


def _levels(of: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, kind, level) for each text and kind: one row per level of ``LEVELS`` that its count reaches."""
    if not len(of):
        return of, kinds, np.zeros(0, np.int64)
    order = np.lexsort((kinds, of))
    of, kinds = of[order], kinds[order]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (kinds[1:] != kinds[:-1])]))
    counts = np.diff(np.append(new, len(of)))
    reached = np.searchsorted(LEVELS, counts, "right")
    at = np.repeat(new, reached)
    return of[at], kinds[at], ranges(np.zeros(len(reached), np.int64), reached)


@dataclass
class ToxicityModel:
    decoder: Decoder
    kinds: np.ndarray  # sorted distinct hashes of the kept features
    slots: np.ndarray  # (kind, level): index of the feature's weight; the last weight is 0
    weights: np.ndarray
    constant: float

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, index of a kept feature)."""
        if not len(self.kinds):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        of, hashes = self.decoder.features(texts)
        at = np.searchsorted(self.kinds, hashes)
        at[at == len(self.kinds)] = 0
        hit = self.kinds[at] == hashes
        of, kind, level = _levels(of[hit], at[hit])
        slot = self.slots[kind, level]
        return of[slot < len(self.weights) - 1], slot[slot < len(self.weights) - 1]

    def score(self, texts: pa.Array) -> np.ndarray:
        of, feature = self.present(texts)
        total = np.bincount(of, weights=self.weights[feature], minlength=len(texts)) + self.constant
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _logistic(of: np.ndarray, feature: np.ndarray, y: np.ndarray, n_features: int, rounds: int = 800) -> tuple[np.ndarray, float]:
    """Weights, none negative, and constant of a logistic model over feature sets.

    Each toxic set counts a second time, less, with only some of its features: marks that
    always come together in the sample must also do alone.
    """
    rng = np.random.default_rng(0)
    kept = (rng.random(len(of)) < 0.35) & (y[of] > 0)
    of = np.concatenate([of, of[kept] + len(y)])
    feature = np.concatenate([feature, feature[kept]])
    again = np.zeros(len(y))
    again[of[of >= len(y)] - len(y)] = 0.25
    share, y = np.concatenate([np.ones(len(y)), again]), np.concatenate([y, y])
    w, c = np.full(n_features, 0.5), -2.0
    m = v = np.zeros(n_features + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(of, weights=w[feature], minlength=len(y)) + c, -50, 50)))
        error = share * (p - y) / share.sum()
        grad = np.append(np.bincount(feature, weights=error[of], minlength=n_features) + 1e-5 * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        step = 0.05 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
        # What marks a document as toxic can only be found, not be outweighed by other words.
        w, c = np.maximum(0, w - step[:-1]), c - step[-1]
    return w, float(c)


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all documents; 28**3 cells, summed in Spark."""

    def count(batches):
        total = np.zeros(28 ** 3, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE_BYTES):
                total += trigrams(batch.column(0).slice(a, b - a))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(text_col).mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(28 ** 3)
    for r in rows:
        counts[r.cell] = r.n
    return counts


def fit_toxicity(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Fit on about ``sample_docs`` documents that have a label, chosen by a hash of the id.

    ``corpus`` (``docs`` if not given) feeds the character model. Null ids and labels teach
    nothing; several labels of an id count as the largest. A feature is kept if its excess of toxic documents
    would be rare by chance even among all features (a Chernoff bound below e**-1 / number of
    features); all such are kept, so there are as many as the labelled sample proves. Without labels, or without a toxic one, no
    feature is kept and every text gets the same score.
    """
    spark = docs.sparkSession
    decoder = Decoder(character_model(corpus if corpus is not None else docs, text_col))
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("k").agg(F.max("y").alias("y"))
    total = known.count()
    bound = int(min(1.0, sample_docs / max(1, total)) * (1 << 30))
    # At most about sample_docs pairs of numbers.
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < bound))
    sample = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text")).join(chosen, "k").select("text", "y")

    def count(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE_BYTES):
                of, kind, level = _levels(*decoder.features(batch.column(0).slice(a, b - a)))
                toxic = batch.column(1).to_numpy()[a:b][of].astype(np.int64)
                rows = pa.table({"f": kind.view(np.int64), "l": level, "n": np.ones(len(of), np.int64), "t": toxic})
                yield from rows.group_by(["f", "l"]).aggregate([("n", "sum"), ("t", "sum")]).rename_columns(["f", "l", "n", "t"]).to_batches()

    sizes = chosen.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).head()
    rate = (sizes.t + 0.5) / (sizes.n + 1)
    path = scratch_path(spark, "toxic-features")
    sample.mapInArrow(count, "f bigint, l bigint, n bigint, t bigint").groupBy("f", "l").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).write.parquet(path)
    by_feature = spark.read.schema("f bigint, l bigint, n bigint, t bigint").parquet(path)
    n, t = F.col("n"), F.col("t")
    rest = F.when(n > t, (n - t) * F.log((n - t) / n / (1 - rate))).otherwise(0.0)
    marks = by_feature.where((t >= 3) & (t / n > rate)).withColumn("evidence", t * F.log(t / n / rate) + rest)
    marks = marks.where(F.col("evidence") >= float(np.log(max(1, by_feature.count())) + 1))
    marks = marks.orderBy("f", "l").toArrow()
    hashes, levels = marks["f"].to_numpy().view(np.uint64), marks["l"].to_numpy()
    kinds, of_kind = np.unique(hashes, return_inverse=True)
    slots = np.full((len(kinds), len(LEVELS)), len(hashes))
    slots[of_kind, levels] = np.arange(len(hashes))
    model = ToxicityModel(decoder, kinds, slots, np.zeros(len(hashes) + 1), float(np.log(rate / (1 - rate))))
    if not len(kinds):
        return model

    def presence(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE_BYTES):
                of, feature = model.present(batch.column(0).slice(a, b - a))
                edges = np.searchsorted(of, np.arange(b - a + 1))
                rows = [feature[x:y].astype("<u4").tobytes() for x, y in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).slice(a, b - a)], names=["f", "y"])

    rows = sample.mapInArrow(presence, "f binary, y int").toArrow()
    sets = [np.frombuffer(b.as_buffer(), "<u4").astype(np.int64) for b in rows["f"]]
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    weights, constant = _logistic(of, np.concatenate(sets), rows["y"].to_numpy().astype(float), len(hashes))
    return ToxicityModel(decoder, kinds, slots, np.append(weights, 0.0), constant)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, which replaces a column of that name. Null and empty texts get the constant's."""
    return add_columns(docs, text_col, lambda texts: [model.score(texts)], f"`{out}` double", SLICE_BYTES)
