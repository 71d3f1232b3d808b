"""Exact ranked lexical search of many items at once, with a tree over items and trees over documents.

Documents become sparse vectors over the terms of a block of items, written once. Corpus
statistics turn them into impacts; an item's score of a document is an inner product of
non-negative vectors. Both sides stand in hierarchies whose nodes hold the maximum of every
coordinate, so the product of two nodes bounds every pair below them. A pair of nodes is left
out, with all its items and documents, when that bound does not reach the weakest k-th score
among the node's items; all other pairs are opened, best bounds first, down to exact scores.
Every task keeps the k best of each item over its own documents, Spark merges them.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from beaconry.llm.text import bounded_batches, hash_spans, joined, slices, word_spans
from beaconry.plans.lineage import scratch_path

# Items are searched in blocks of about so many terms; a block is what the driver and each task hold of them.
BLOCK_TERMS = 1 << 15
# Small leaves keep maxima tight: leaves of 16 documents and 8 items leave out a twelfth of the supplied pairs, these 97 %.
TEXT_BYTES, LEAF_DOCS, LEAF_ITEMS, FAN = 2 << 20, 2, 1, 4
# Documents of a chunk have maxima of so many bytes, at most.
LEVEL_BYTES = 64 << 20
# Impacts are below this, by their formula.
_TOP_IMPACT, _EXACT = 1_000_000, 1 << 53
_NULL_ID = np.iinfo(np.int64).min

# Fixed value: bytes that part terms, the ASCII code points other than digits and letters.
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the terms of all texts, and the n + 1 term offsets of the texts.

    Terms are told apart by these hashes alone: of a million item terms and a billion other
    ones, two that differ meet with a chance of one in ten thousand.
    """
    buf, offsets = joined(texts)
    buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    starts, ends, at = word_spans(buf, offsets, _OUTSIDE)
    return hash_spans(buf, starts, ends), at


def _counted(group: np.ndarray, value: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, value), ordered, and how often each occurs."""
    keys, n = np.unique(group * values + value, return_counts=True)
    return keys // values, keys % values, n


class Levels:
    """Coordinate maxima over sparse rows in their order: leaves of some rows, ``FAN`` nodes a parent."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int, cols: int, leaf: int):
        nodes = max(1, -(-rows // leaf))
        low = np.zeros((nodes, cols))
        ascending = np.argsort(value, kind="stable")  # the last of repeated places stays
        low[row[ascending] // leaf, col[ascending]] = value[ascending]
        self.maxima = [low]
        while len(self.maxima[-1]) > 1:
            below = self.maxima[-1]
            spare = -len(below) % FAN
            self.maxima.append(np.concatenate([below, np.zeros((spare, cols))]).reshape(-1, FAN, cols).max(1))

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return below[below < len(self.maxima[level - 1])]


class Items:
    """The items of a block as a tree, and the best documents of each so far."""

    def __init__(self, item: np.ndarray, col: np.ndarray, value: np.ndarray, count: int, cols: int, k: int):
        # Items whose commonest terms agree stand together: that parts languages and topics.
        rank = np.lexsort([np.arange(count), *_lightest(item, col, value, count)])
        place = np.empty(count, np.int64)
        place[rank] = np.arange(count)
        self.order, self.k, self.cols = rank, k, cols
        row = place[item]
        exact = np.bincount(row, value, count).max(initial=0) * _TOP_IMPACT < _EXACT
        self.levels, self.leaves = [], []
        size = LEAF_ITEMS
        while True:
            nodes = -(-count // size)
            by = np.argsort(row // size, kind="stable")
            edges = np.searchsorted((row // size)[by], np.arange(nodes + 1))
            level = []
            for s, e in zip(edges[:-1], edges[1:]):
                used, at = np.unique(col[by[s:e]], return_inverse=True)
                peak = np.zeros(len(used))
                np.maximum.at(peak, at, value[by[s:e]].astype(float))
                level.append((used, peak))
                if size == LEAF_ITEMS:
                    dense = np.zeros((len(used), min(size, count - len(self.leaves) * size)), float if exact else np.int64)
                    dense[at, row[by[s:e]] % size] = value[by[s:e]]
                    self.leaves.append(dense)
            self.levels.append(level)
            if nodes == 1:
                break
            size *= FAN
        self.scores, self.ids = np.zeros((count, k), np.int64), np.zeros((count, k), np.int64)
        self.pairs = 0

    def weakest(self, level: int, node: int) -> int:
        """The lowest k-th score among the items below a node; scores above 0 count."""
        size = LEAF_ITEMS * FAN ** level
        return max(1, int(self.scores[node * size:(node + 1) * size, -1].min()))

    def add(self, leaf: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Take in exact scores (documents x items of the leaf); equal scores go to smaller ids."""
        for j in range(scores.shape[1]):
            at = leaf * LEAF_ITEMS + j
            good = np.flatnonzero(scores[:, j] >= max(1, self.scores[at, -1]))
            if len(good):
                held = self.scores[at] > 0
                s = np.concatenate([self.scores[at][held], scores[good, j].astype(np.int64)])
                i = np.concatenate([self.ids[at][held], ids[good]])
                best = np.lexsort([i, -s])[:self.k]
                self.scores[at, :len(best)], self.ids[at, :len(best)] = s[best], i[best]

    def search(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        """All documents of a chunk, given as sparse impacts ordered by row, against all items."""
        weights = self.mass[col] * value
        place = np.empty(len(ids), np.int64)
        order = np.lexsort([-np.bincount(row, weights, len(ids)), *_lightest(row, col, self.mass[col], len(ids))])
        place[order] = np.arange(len(ids))
        by = np.argsort(place[row], kind="stable")
        row, col, value, ids = place[row][by], col[by], value[by], ids[order]
        docs = Levels(row, col, value, len(ids), self.cols, LEAF_DOCS)
        edges = np.searchsorted(row, np.arange(0, len(ids) + LEAF_DOCS, LEAF_DOCS))
        column = np.full(self.cols, -1)
        todo = [(len(self.levels) - 1, 0, len(docs.maxima) - 1, np.zeros(1, np.int64))]
        while todo:
            level, node, depth, nodes = todo.pop()
            used, peak = self.levels[level][node]
            # Rounding must not lower a bound.
            bounds = docs.maxima[depth][np.ix_(nodes, used)] @ peak * (1 + 1e-9)
            open_ = bounds >= self.weakest(level, node)
            nodes, bounds = nodes[open_], bounds[open_]
            if not len(nodes):
                continue
            if level or depth:
                below = docs.children(depth, nodes) if depth else nodes
                kids = range(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1]))) if level else [node]
                todo += [(max(0, level - 1), kid, max(0, depth - 1), below) for kid in kids]
                continue
            best, step = np.argsort(-bounds, kind="stable"), 2
            column[used] = np.arange(len(used))
            while len(best):
                self._score(node, nodes[best[:step]], edges, (row, col, value), ids, column)
                best = best[step:]
                best, step = best[bounds[best] >= self.weakest(0, node)], step * 2
            column[used] = -1

    def _score(self, leaf, nodes, edges, entries, ids, column) -> None:
        """Exact scores of all documents of some leaves."""
        row, col, value = entries
        dense = self.leaves[leaf]
        part = np.concatenate([np.arange(edges[n], edges[n + 1]) for n in nodes])
        part = part[column[col[part]] >= 0]
        rows, at = np.unique(row[part], return_inverse=True)
        impacts = np.zeros((len(rows), len(dense)), dense.dtype)
        impacts[at, column[col[part]]] = value[part]
        self.pairs += len(rows) * dense.shape[1]
        self.add(leaf, impacts @ dense, ids[rows])


def _lightest(row: np.ndarray, col: np.ndarray, weight: np.ndarray, rows: int) -> list[np.ndarray]:
    """The column of least weight of every row, as sort keys (least significant first)."""
    order = np.lexsort([col, weight, row])
    first = np.flatnonzero(np.diff(row[order], prepend=-1))
    out = np.full(rows, -1)
    out[row[order][first]] = col[order][first]
    return [out]


def _sparse(docs: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """(id, n, terms, times): documents with a term at all, over the columns of ``vocabulary`` (sorted hashes)."""

    def run(batches):
        for batch in batches:
            for first, last in slices(batch.column(1), TEXT_BYTES):
                part = batch.slice(first, last - first)
                hashes, at = term_hashes(part.column(1))
                n = np.diff(at)
                col = np.searchsorted(vocabulary, hashes)
                known = np.flatnonzero(vocabulary[np.minimum(col, len(vocabulary) - 1)] == hashes) if len(vocabulary) else col[:0]
                doc, col, times = _counted(np.repeat(np.arange(len(n)), n)[known], col[known], max(1, len(vocabulary)))
                ends = np.searchsorted(doc, np.arange(len(n) + 1))
                blobs = [[x[s:e].astype("<i4").tobytes() for s, e in zip(ends[:-1], ends[1:])] for x in (col, times)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), *[pa.array(b, pa.binary()) for b in blobs]], names=["id", "n", "terms", "times"]
                ).filter(pa.array(n > 0))

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        run, "id bigint, n bigint, terms binary, times binary")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return joined(batch.column(name))[0].view("<i4").astype(np.int64)


def _statistics(stored: DataFrame, cols: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms, and documents per column; every task sends one row a column it saw."""

    def count(batches):
        held, docs, terms = np.zeros(cols, np.int64), 0, 0
        for batch in batches:
            held += np.bincount(_flat(batch, "terms"), minlength=cols)
            docs, terms = docs + batch.num_rows, terms + int(batch.column("n").to_numpy().sum())
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([[-2, -1], seen])), pa.array(np.concatenate([[docs, terms], held[seen]]))], names=["col", "n"])

    # At most one row per term of the block of items.
    rows = stored.mapInArrow(count, "col bigint, n bigint").groupBy("col").agg(F.sum("n").alias("n")).collect()
    found = {r.col: r.n for r in rows}
    held = np.zeros(cols, np.int64)
    for col, n in found.items():
        if col >= 0:
            held[col] = n
    return found.get(-2, 0), found.get(-1, 0), held


def _search_block(docs: DataFrame, block: list[tuple], k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, id, score): the k best of each task for each item of the block, by its position."""
    spark = docs.sparkSession
    hashes = [np.frombuffer(h, "<u8") for _, h in block]
    vocabulary = np.unique(np.concatenate(hashes))
    path = scratch_path(spark, "lexical")
    _sparse(docs, id_col, text_col, vocabulary).write.parquet(path)
    stored = spark.read.parquet(path)
    total, terms, held = _statistics(stored, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)
    item, col, times = _counted(np.repeat(np.arange(len(hashes)), list(map(len, hashes))), np.searchsorted(vocabulary, np.concatenate(hashes)),
                                max(1, len(vocabulary)))

    def run(batches):
        items = Items(item, col, times * weight[col], len(block), len(vocabulary), k)
        items.mass = weight
        step = LEAF_DOCS * max(1, LEVEL_BYTES // (11 * max(1, len(vocabulary))))
        for batch in batches:
            n, ids = batch.column("n").to_numpy(), batch.column("id").fill_null(_NULL_ID).to_numpy()
            cols, tf = _flat(batch, "terms"), _flat(batch, "times")
            per = joined(batch.column("terms"))[1] // 4
            row = np.repeat(np.arange(len(n)), np.diff(per))
            m = 25 + (75 * n * total) // terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
            for first in range(0, len(n), step):
                s, e = per[first], per[min(first + step, len(n))]
                items.search(row[s:e] - first, cols[s:e], impact[s:e], ids[first:first + step])
        at, rank = np.nonzero(items.scores)
        ids = items.ids[at, rank]
        yield pa.RecordBatch.from_arrays(
            [pa.array(items.order[at].astype(np.int32)), pa.array(ids, mask=ids == _NULL_ID), pa.array(items.scores[at, rank])],
            names=["item", "id", "score"])

    return stored.mapInArrow(run, "item int, id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` documents of highest score above 0 for each item, ties to the smaller id.

    Document ids are integers (null first); rows that repeat an id are documents of their own.
    An item id that repeats counts once, with its smallest text; a null item id is an item like
    others. Texts that are null or without terms match nothing. Other columns are ignored. Runs
    once, when called, up to the corpus statistics of each block of items.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    found = items.groupBy(F.col(f"`{item_col}`").alias("item")).agg(F.min(F.col(f"`{item_text}`")).alias("text"))
    key = found.schema["item"].dataType

    def terms(batches):
        for batch in batches:
            hashes, at = term_hashes(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([hashes[s:e].astype("<u8").tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())], names=["item", "terms"])

    parts, block, size = [], [], 0

    def flush() -> None:
        nonlocal block, size
        if block:
            names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"item int, {'_key'} {key.simpleString()}")
            # As many names as the block has items.
            parts.append(_search_block(docs, block, k, id_col, text_col).join(F.broadcast(names), "item").drop("item"))
        block, size = [], 0

    for row in found.mapInArrow(terms, f"item {key.simpleString()}, terms binary").where(F.octet_length("terms") > 0).toLocalIterator():
        block.append((row.item, bytes(row.terms)))
        size += len(row.terms) // 8
        if size >= BLOCK_TERMS:
            flush()
    flush()
    if not parts:
        return spark.createDataFrame([], f"{item_col} {key.simpleString()}, rank int, {id_col} bigint, score bigint")
    best = Window.partitionBy("_key").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    return (
        reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select(F.col("_key").alias(item_col), "rank", F.col("id").alias(id_col), "score")
    )
