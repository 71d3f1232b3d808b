"""Questions that blocks of documents ask about the whole corpus, answered per key range.

Whether a key (a window, an anchor) also occurs in another document cannot be told from one
block. Each block sends its distinct keys as packed arrays, cut into key ranges; one task per
range merges the arrays of all blocks and sends back one packed answer per array. Rows never
hold single keys, a key that a third of the documents share is one entry per block, and all
groups are bounded: blocks by ``block_bytes``, ranges by the number of ranges.

Everything is one lazy plan. A block is recomputed from the same exchange of texts in each
round (Spark reuses it), so a lost executor costs a recomputation and nothing else; the
order of keys in a block depends on its contents only.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from beaconry.llm.text import bounded_batches


class Blocks:
    """``docs`` dealt into blocks of about ``block_bytes`` bytes of text."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, block_bytes: int):
        bounded_batches(docs.sparkSession)
        self.names, self.schema = docs.columns, docs.schema
        self.id_at, self.text_at = f"c{self.names.index(id_col)}", f"c{self.names.index(text_col)}"
        docs = docs.toDF(*[f"c{i}" for i in range(len(self.names))])
        self.bytes = docs.agg(F.coalesce(F.sum(F.octet_length(self.text_at)), F.lit(0)).alias("n")).head().n
        self.count = max(1, -(-self.bytes // block_bytes))
        # The id alone may repeat; an id and text that repeat are one row's worth of work each.
        self.rows = docs.withColumn("b", F.pmod(F.xxhash64(self.id_at, self.text_at), F.lit(self.count)).cast("int"))

    def ask(self, keys: Callable, answers: DataFrame | None = None) -> DataFrame:
        """(shard, b, payload) from ``keys(table, answers)``, which gives {shard: bytes}."""
        order = [(self.id_at, "ascending"), (self.text_at, "ascending")]

        def packed(table: pa.Table, replies: dict) -> pa.Table:
            block = table["b"][0].as_py() if table.num_rows else 0
            sent = keys(_ordered(table, order), replies) if table.num_rows else {}
            return pa.table({"shard": pa.array(list(sent), pa.int32()), "b": pa.array([block] * len(sent), pa.int32()),
                             "payload": pa.array(list(sent.values()), pa.binary())})

        schema = "shard int, b int, payload binary"
        if answers is None:
            return self.rows.groupBy("b").applyInArrow(lambda t: packed(t, {}), schema)
        return self.rows.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(lambda t, a: packed(t, _replies(a)), schema)

    def finish(self, result: Callable, answers: DataFrame, extra: str) -> DataFrame:
        """The documents with the text and columns that ``result(table, answers)`` gives.

        It returns the new texts and a dict of the ``extra`` columns, which replace columns of
        the same names.
        """
        order, text_at = [(self.id_at, "ascending"), (self.text_at, "ascending")], self.text_at
        added = StructType.fromDDL(extra)
        kept = [(f"c{i}", f) for i, f in enumerate(self.schema.fields) if f.name not in added.names]
        out_schema = StructType([*[f for _, f in kept], *added.fields])

        def run(table: pa.Table, replies: pa.Table) -> pa.Table:
            if not table.num_rows:
                table = table.slice(0, 0)
                texts, columns = table[text_at] if text_at in table.column_names else pa.array([], pa.string()), {n: pa.array([], pa.int64()) for n in added.names}
            else:
                table = _ordered(table, order)
                texts, columns = result(table, _replies(replies))
            return pa.table([texts if c == text_at else table[c] for c, _ in kept] + [columns[n] for n in added.names], names=out_schema.names)

        return self.rows.groupBy("b").cogroup(answers.groupBy("b")).applyInArrow(run, out_schema)


def _ordered(table: pa.Table, order: list) -> pa.Table:
    """Documents by id, null first; rows that repeat an id by text."""
    return table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))


def _replies(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table["shard"].to_pylist(), table["payload"].to_pylist())) if table.num_rows else {}


def answer(asked: DataFrame, merge: Callable) -> DataFrame:
    """(b, shard, payload): ``merge(payloads, blocks)`` answers all arrays of a key range at once."""

    def run(table: pa.Table) -> pa.Table:
        return pa.table({"b": table["b"], "shard": table["shard"],
                         "payload": pa.array(merge(table["payload"].to_pylist(), table["b"].to_pylist()), pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, "b int, shard int, payload binary")


def cuts(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, first, last) of sorted 64-bit keys, by their upper 32 bits."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    edges = np.searchsorted(shard, np.arange(shards + 1))
    return [(s, int(a), int(b)) for s, a, b in zip(range(shards), edges, edges[1:]) if b > a]


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(replies: dict[int, bytes], parts: list[tuple[int, int, int]], offset: int, n: int) -> np.ndarray:
    """The answers to ``n`` keys that were cut into ``parts``."""
    out = np.zeros(n, bool)
    for shard, first, last in parts:
        out[first:last] = np.unpackbits(np.frombuffer(replies[shard + offset], np.uint8), count=last - first)
    return out
