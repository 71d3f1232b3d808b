"""Whole texts as byte arrays inside a task: words, hashes and sliding minima in numpy.

Used by operators that look at every word or byte of an Arrow batch. All functions are
linear in the bytes given; callers cut batches with :func:`slices` so that the arrays of
one call stay bounded, except for a single text that is longer than the bound.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed value: the white space of the word contract, [\x20\x09-\x0D].
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


# Rows of texts that go to a Python worker at a time, at most.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Send texts to Python in Arrow batches of at most ``BATCH_ROWS`` rows, fewer if the session says so.

    A batch is held whole by the JVM, outside its heap, and by the worker; ten thousand
    texts, Spark's default, are too many for small executors.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def slices(texts: pa.Array, max_bytes: int):
    """(first, last) row ranges whose texts hold about ``max_bytes`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
        yield first, last
        first = last


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, and the n + 1 offsets of the texts in it; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0]:offsets[-1]], offsets - offsets[0]


def word_spans(buf: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 word offsets of the texts; bytes of ``outside`` part words."""
    n = len(buf)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~outside[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _ODD
    h ^= h >> np.uint64(32)
    return h


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    h = mix(left.astype(np.uint64) + np.uint64(seed) * _ODD)
    todo, at = None, starts
    while len(at):
        lane = lanes[at]
        short = left < 8
        lane[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        if todo is None:
            h = mix(h ^ lane)
            todo = np.flatnonzero(left > 8)
            at, left = at[todo] + 8, left[todo] - 8
        else:
            h[todo] = mix(h[todo] ^ lane)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return h


# Powers of a hash's multiplier are made once per worker for slices of usual size.
_REMEMBERED_POWERS, _powers = 1 << 20, {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, ``n`` of them."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(n, base, np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if n <= _REMEMBERED_POWERS:
            _powers[base] = held
    return held[:n]


def prefix_hashes(values: np.ndarray, multiplier: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of ``values`` times powers of an odd number, modulo 2**64, and the inverse powers."""
    n = len(values) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum(values * _powers_of(multiplier, n)[:-1], out=sums[1:])
    return sums, _powers_of(pow(multiplier, -1, 1 << 64), n)


def span_hashes(prefix: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed hash of the values in each [start, end); it does not depend on where the span lies."""
    sums, inverse = prefix
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def rolling(values: np.ndarray, width: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A mixed hash of every ``width`` consecutive values."""
    return rolled(prefix_hashes(values, multiplier), width)


def rolled(prefix: tuple[np.ndarray, np.ndarray], width: int) -> np.ndarray:
    """A mixed hash of every ``width`` consecutive values, from their running sums."""
    sums, inverse = prefix
    if len(sums) <= width:
        return np.zeros(0, np.uint64)
    return mix((sums[width:] - sums[:-width]) * inverse[:-width] + np.uint64(width))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values (block prefix and suffix minima)."""
    return _sliding(values, width, np.minimum, np.iinfo(values.dtype).max)


def sliding_max(values: np.ndarray, width: int) -> np.ndarray:
    return _sliding(values, width, np.maximum, 0)


def _sliding(values, width, op, filler):
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, filler, values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = op.accumulate(padded, axis=1).ravel()
    back = op.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n - width + 1], ahead[width - 1:n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all ranges, one after another."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


@dataclass
class Packed:
    """Rows by sorted 64-bit hash: where each one's values begin, and further columns."""

    hashes: np.ndarray
    values: np.ndarray
    firsts: np.ndarray
    columns: tuple

    @classmethod
    def none(cls, columns: int) -> "Packed":
        no = np.zeros(0, np.int64)
        return cls(no.astype(np.uint64), no.astype(np.int32), no, (no,) * columns)

    def plus(self, hashes: np.ndarray, values: np.ndarray, firsts: np.ndarray, *columns: np.ndarray) -> "Packed":
        """With rows of hashes not known before; ``firsts`` are places in ``values``."""
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        join = lambda old, new: np.concatenate([old, new])[order]
        return Packed(every[order], np.concatenate([self.values, values.astype(np.int32)]), join(self.firsts, firsts + len(self.values)),
                      tuple(join(old, new) for old, new in zip(self.columns, columns)))


def add_columns(docs: DataFrame, text_col: str, fn: Callable, ddl: str, max_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with the columns of ``ddl``, which ``fn(texts)`` gives as arrays; columns of these names are replaced."""
    bounded_batches(docs.sparkSession)
    added = StructType.fromDDL(ddl)
    kept = [f for f in docs.schema.fields if f.name not in added.names or f.name == text_col]
    inner = docs.select(*[F.col(f"`{f.name}`") for f in kept])
    at = inner.columns.index(text_col)
    types = to_arrow_schema(added).types

    def run(batches):
        for batch in batches:
            for first, last in slices(batch.column(at), max_bytes):
                part = batch.slice(first, last - first)
                new = [pa.array(c, type=t) for c, t in zip(fn(part.column(at)), types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added.names])

    return inner.mapInArrow(run, StructType([*kept, *added.fields]))
