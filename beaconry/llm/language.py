"""Language identification by hierarchical discrimination.

Features are hashed byte bigrams and trigrams of the lower-cased letters, as shares of the
text. Languages are joined into families by the likeness of their mean features. A linear
support vector machine per family (one against the rest) picks the family; inside it, one
machine for each pair of languages votes. Machines are fitted on a bounded sample of labelled
rows; a prediction reads whole texts and adds up the weights of their n-grams.
"""

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from beaconry.llm.text import add_columns, bounded_batches, joined, slices

FEATURES = 4096
# Labelled rows per language that the machines are fitted on, at most about this many.
SAMPLE_PER_LANGUAGE = 1000
UNKNOWN = "und"

_TRIGRAM, _BIGRAM = np.uint32(2654435761), np.uint32(2246822519)


def _ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed n-grams of all texts and the n + 1 offsets of the texts in them (two per byte)."""
    buf, offsets = joined(pc.utf8_lower(texts))
    letter = ((buf >= 97) & (buf <= 122)) | (buf >= 128)
    # Two spaces before each text, so that no n-gram holds letters of two texts.
    at = np.arange(len(buf)) + np.repeat(2 * np.arange(1, len(offsets)), np.diff(offsets))
    clean = np.full(len(buf) + 2 * len(offsets), 32, np.uint32)
    clean[at] = np.where(letter, buf, 32)
    two = clean[:-2] | clean[1:-1] << 8
    three = two | clean[2:] << 16
    grams = np.empty((len(two), 2), np.int32)
    shift = np.uint32(32 - (FEATURES.bit_length() - 1))
    grams[:, 0] = (two * _BIGRAM) >> shift
    grams[:, 1] = (three * _TRIGRAM) >> shift
    return grams.ravel(), 2 * (offsets + 2 * np.arange(len(offsets)))


def _shares(texts: pa.Array) -> np.ndarray:
    """Share of each feature, one row per text."""
    grams, offsets = _ngrams(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
        out[i] = np.bincount(grams[a:b], minlength=FEATURES) / max(1, b - a)
    return out


def _machine(x: np.ndarray, positive: np.ndarray, rounds: int = 150, cost: float = 10.0) -> np.ndarray:
    """Weights (the last one constant) of a linear machine with squared hinge loss, classes weighted equally."""
    y = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum()))
    x1 = np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
    step = 1 / (1 + 2 * cost * float((share * (x1 ** 2).sum(1)).sum()))
    w = seen = np.zeros(x1.shape[1])
    for t in range(1, rounds + 1):
        slack = np.maximum(0, 1 - y * (x1 @ seen))
        new = seen - step * (seen - 2 * cost * ((share * y * slack) @ x1))
        seen, w = new + (t - 1) / (t + 2) * (new - w), new
    return w


def _families(means: np.ndarray) -> list[list[int]]:
    """About sqrt(n) groups of rows, by average linkage of their cosines."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    groups = [[i] for i in range(len(means))]
    while len(groups) > max(1, round(len(means) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: near[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return groups


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[list[int]]
    pairs: list[tuple[int, int]]
    weights: np.ndarray  # (FEATURES, families + pairs)
    constants: np.ndarray

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language and a score from 0 to 1 of each text; ``und`` and 0 for texts without a letter."""
        buf, byte_offsets = joined(texts)
        ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
        has = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[byte_offsets]) > 0
        for i in np.flatnonzero(~has):
            has[i] = any(c.isalpha() for c in texts[i].as_py() or "")
        grams, offsets = _ngrams(texts)
        sums = np.add.reduceat(self.weights[grams], offsets[:-1], axis=0, dtype=np.float64) if len(grams) else np.zeros((len(texts), len(self.constants)))
        margins = sums / np.maximum(1, np.diff(offsets))[:, None] + self.constants
        n, n_families = len(texts), len(self.families)
        family = margins[:, :n_families].argmax(1)
        sure = 1 / (1 + np.exp(-2 * np.clip(margins[np.arange(n), family], -30, 30)))
        votes = np.full((n, len(self.languages)), -np.inf)
        for f, members in enumerate(self.families):
            votes[np.ix_(family == f, members)] = 0
        least = np.full((n, len(self.languages)), np.inf)
        for p, (a, b) in enumerate(self.pairs, n_families):
            m = margins[:, p]
            # Whole votes decide; the margins break ties.
            votes[:, a] += (m > 0) + 1e-3 * np.tanh(m)
            votes[:, b] += (m <= 0) - 1e-3 * np.tanh(m)
            least[:, a], least[:, b] = np.minimum(least[:, a], m), np.minimum(least[:, b], -m)
        best = votes.argmax(1)
        worst = least[np.arange(n), best]
        score = sure / (1 + np.exp(-2 * np.clip(worst, -30, 30)))
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, score, 0.0)


def fit_language(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
                 per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on about ``per_language`` rows of each language, chosen by a hash of the id.

    Rows with null language or text, or without a letter, teach nothing.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModel([UNKNOWN], [[0]], [], np.zeros((FEATURES, 1), np.float32), np.zeros(1))
    # One row per language: as many as the labels have.
    bounds = rows.sparkSession.createDataFrame([(k, int(min(1.0, per_language / n) * (1 << 30))) for k, n in counts.items()], "lang string, bound long")
    sample = rows.join(F.broadcast(bounds), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("bound")).select("lang", "text")

    def features(batches):
        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 20):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array([r.tobytes() for r in _shares(part.column("text")).astype(np.float16)], pa.binary())], names=["lang", "x"])

    bounded_batches(sample.sparkSession)
    found = sample.mapInArrow(features, "lang string, x binary").toArrow()
    langs = np.array(found["lang"].to_pylist())
    x = np.stack([np.frombuffer(v.as_buffer(), np.float16) for v in found["x"]]).astype(np.float32)
    scale = 1 / np.sqrt((x ** 2).mean(0) + 1e-9)
    x *= scale / np.sqrt(FEATURES)
    languages = sorted(set(langs))
    of = np.searchsorted(languages, langs)
    families = _families(np.stack([x[of == i].mean(0) for i in range(len(languages))]))
    machines = [_machine(x, np.isin(of, members)) for members in families]
    pairs = [tuple(sorted(p)) for members in families for p in combinations(members, 2)]
    for a, b in pairs:
        rows_ab = (of == a) | (of == b)
        machines.append(_machine(x[rows_ab], of[rows_ab] == a))
    machines = np.stack(machines, 1)
    return LanguageModel([str(s) for s in languages], families, pairs, (machines[:-1] * (scale / np.sqrt(FEATURES))[:, None]).astype(np.float32), machines[-1])


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of these names.

    Null and empty texts, and texts without a letter, are ``und`` with score 0. Every other text
    gets a learned language; a model fitted on no rows only knows ``und``.
    """
    return add_columns(docs, text_col, model.predict, "lang_pred string, score double")


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest, F.lit(False))
