"""Exact top-k inner products of integer vectors, score at a time.

Every shard of candidates is an impact-ordered index: per dimension the rows sorted by
value, cut into levels (the quantised impacts). A query walks all dimensions together by
descending impact and adds each segment's upper bound to the rows in it. It stops when at
most a few rows can still reach the k-th best lower bound, or nothing is left; those rows
are rescored exactly. Shards and query blocks form a grid that Spark deals out; each task
holds one shard and one block.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

LEVELS = 256
# Walked down to these parts of the largest impact before each look at the bounds.
STEPS = (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05, 0.0)
FEW = 64


class ImpactIndex:
    """Rows of one shard: per dimension their order by level and the values each level spans."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.by_id = np.argsort(ids, kind="stable")
        self.id_starts = np.flatnonzero(np.diff(ids[self.by_id], prepend=ids[self.by_id[:1]] - 1))
        low, span = vectors.min(0), np.ptp(vectors, axis=0) + 1
        levels = ((vectors - low) * LEVELS // span).astype(np.int16)
        self.order = np.argsort(levels, axis=0, kind="stable").T.astype(np.int32).copy()
        self.codes = np.take_along_axis(levels, self.order.T, axis=0).T.copy()
        bounds = low[:, None] - (-(span[:, None] * np.arange(LEVELS + 1)) // LEVELS)
        # Values of level l lie in [bounds[l], bounds[l + 1] - 1].
        self.lowest, self.highest = bounds[:, :-1], np.maximum(bounds[:, 1:] - 1, bounds[:, :-1])
        self.first = np.stack([np.searchsorted(c, np.arange(LEVELS + 1)) for c in self.codes])

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the k best ids, each at its best row; ties to the smaller id."""
        n, dims = self.vectors.shape
        ends = np.stack([query[:, None] * self.lowest, query[:, None] * self.highest])
        upper, lower = ends.max(0), ends.min(0)
        base = lower.min(1, keepdims=True)
        impact = upper - base  # of each (dimension, level); monotone in the level
        slack = int((upper - lower).max(1).sum())
        own = self.ids == query_id
        wanted = min(k, len(self.id_starts) - int(own.any()))
        if wanted <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sums = np.zeros(n, np.int64)
        sums[own] = -(1 << 62)
        rising = query >= 0
        done = np.zeros(dims, np.int64)  # levels walked, from the strong end
        for step in STEPS:
            limit = int(impact.max() * step)
            until = (impact >= limit).sum(1) if step else np.full(dims, LEVELS)
            for d in np.flatnonzero(until > done):
                a, b = (LEVELS - until[d], LEVELS - done[d]) if rising[d] else (done[d], until[d])
                part = slice(self.first[d, a], self.first[d, b])
                sums[self.order[d, part]] += impact[d][self.codes[d, part]]
            done = np.maximum(done, until)
            open_ = np.flatnonzero(done < LEVELS)
            next_level = np.where(rising[open_], LEVELS - 1 - done[open_], done[open_])
            rest = int(impact[open_, next_level].sum())
            # Rows of one id are one answer: the k-th best id, by what its best row has so far.
            reached = np.maximum.reduceat(sums[self.by_id], self.id_starts) if len(self.id_starts) < n else sums
            kth = np.partition(reached, len(reached) - wanted)[len(reached) - wanted]
            possible = np.flatnonzero(sums >= kth - slack - rest)
            if len(possible) <= max(FEW, wanted) or not len(open_):
                break
        possible = possible[~own[possible]]
        scores = self.vectors[possible] @ query
        best = np.lexsort((self.ids[possible], -scores))
        best = best[np.sort(np.unique(self.ids[possible][best], return_index=True)[1])[:k]]
        return possible[best], scores[best]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def usable(vector: Column) -> Column:
    """Not null, not empty and without null components."""
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))


def top_k_inner_product(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector",
                        shard_rows: int = 16384, block_queries: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product, for each row where ``is_query``.

    ``vector_col`` is array<bigint> whose inner products fit 64 bits. Ranks start at 1, ties go
    to the smaller id. Rows with the query's id are not its candidates; rows repeating id and
    vector count once; a query id with several vectors asks with the smallest. Null ids, and
    vectors that are null, empty or hold a null take no part; a query only meets vectors of its
    own length. Fewer than k candidates give fewer rows, an empty table none.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.groupBy("id", "v").agg(F.bool_or("q").alias("q")).withColumn("dim", F.size("v"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).head()
    shards, blocks = max(1, -(-sizes.n // shard_rows)), max(1, -(-sizes.q // block_queries))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.withColumns({"shard": F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"), "block": grid(blocks)}).drop("q")
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    queries = queries.withColumns({"block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "shard": grid(shards)})

    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and asked.num_rows:
            index = ImpactIndex(held["id"].to_numpy(), _matrix(held["v"]))
            for query_id, query in zip(asked["id"].to_pylist(), _matrix(asked["v"])):
                found, scores = index.search(query_id, query, k)
                out.append((np.full(len(found), query_id), index.ids[found], scores))
        columns = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else ((), (), ()))]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    by = ("dim", "shard", "block")
    found = candidates.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # An id with several vectors keeps its best score.
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
