"""Approximate nearest neighbours along shifted Hilbert curves.

Vectors are projected to a few dimensions, shifted and quantised, differently for every
curve, and ordered by their place on a Hilbert curve. Spark range-partitions each ordering
and ranks it; the ranks are cut into chunks. A query asks the chunks within ``window`` ranks
of its own on every curve, the answers merge, and distances are those of the original
vectors. How wide the window must be depends on the data (well separated clusters need
little, isotropic vectors much), so it is measured on a bounded sample against brute force.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from beaconry.llm.topk import usable
from beaconry.plans.ordered import position_in_group

# Curves, dimensions and bits of each; rows of the fitting sample and queries tried on it.
CURVES, DIMS, BITS = 12, 8, 7
SAMPLE_ROWS, SAMPLE_QUERIES = 4096, 256
TARGET_RECALL, LEAST_WINDOW = 0.97, 64
_SHARES = (0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.13, 0.16, 0.2, 0.25, 0.35, 0.5)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (n x dims, values below 2**bits)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(dims):
            up = (x[i] >> bit & 1).astype(bool)
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= flip
    place = np.zeros_like(flip)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            place = place << 1 | row >> bit & 1
    return place


class Curves:
    """Random projections and shifts for vectors of one length, scaled to a sample."""

    def __init__(self, length: int, sample: np.ndarray, count: int):
        rng = np.random.default_rng(length)
        self.mean = sample.mean(0) if len(sample) else np.zeros(length)
        dims = min(DIMS, length)
        self.bits = min(31, 56 // dims) if dims < DIMS else BITS
        self.axes = [np.linalg.qr(rng.normal(size=(length, dims)))[0] for _ in range(count)]
        self.scale = [((sample - self.mean) @ a).std(0) if len(sample) else np.ones(dims) for a in self.axes]
        self.shift = rng.random((count, dims))

    def places(self, vectors: np.ndarray, curve: int) -> np.ndarray:
        scale = np.where(self.scale[curve] > 0, self.scale[curve], 1.0)
        at = (np.clip((vectors - self.mean) @ self.axes[curve] / scale, -3, 3) + 3 + self.shift[curve]) / 7
        return hilbert((np.minimum(at, 0.9999999) * (1 << self.bits)).astype(np.int64), self.bits)


def _nearest(queries: np.ndarray, vectors: np.ndarray, k: int, ids: tuple | None = None):
    """For each query, the rows that can be among its k nearest (rounding allowed for) and their exact distances.

    ``ids`` (values and n + 1 edges) lists the ids of each row; then the k nearest distinct ids count.
    """
    norms, own = (vectors ** 2).sum(1), (queries ** 2).sum(1)
    if ids is not None:
        owner = np.repeat(np.arange(len(vectors)), np.diff(ids[1]))
        by_id = np.argsort(ids[0], kind="stable")
        starts = np.flatnonzero(np.diff(ids[0][by_id], prepend=ids[0][by_id[:1]] - 1))
        several = owner[by_id] if len(starts) < len(by_id) else None
    for q, query in enumerate(queries):
        rough = norms - 2 * (vectors @ query) + own[q]
        # An id with many near vectors is one neighbour, at its nearest.
        reached = rough if ids is None or several is None else np.minimum.reduceat(rough[several], starts)
        kth = np.partition(reached, min(k, len(reached)) - 1)[min(k, len(reached)) - 1]
        rows = np.flatnonzero(rough <= kth + 1e-9 * (own[q] + norms.max()))
        yield q, rows, np.sqrt(((vectors[rows] - query) ** 2).sum(1))


def measured_window(sample: np.ndarray, curves: Curves, k: int, target: float) -> float:
    """The smallest share of the rows, on either side, with which the sample reaches the recall."""
    n = len(sample)
    if n <= 4 * k:
        return 1.0
    asked = np.arange(0, n, max(1, n // SAMPLE_QUERIES))
    truth = np.array([rows[np.argsort(d, kind="stable")][:k + 1] for _, rows, d in _nearest(sample[asked], sample, k + 1)])
    found = np.full(truth.shape, n)
    for c in range(len(curves.axes)):
        rank = np.empty(n, np.int64)
        rank[np.argsort(curves.places(sample, c), kind="stable")] = np.arange(n)
        found = np.minimum(found, np.abs(rank[truth] - rank[asked][:, None]))
    found = found[truth != asked[:, None]]
    return next((s for s in _SHARES if (found <= s * n).mean() >= target), 1.0)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector",
                       curves: int = CURVES, target_recall: float = TARGET_RECALL, window: int | None = None,
                       chunk_rows: int = 4096, block_queries: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by Euclidean distance, for each row where ``is_query``.

    Ties go to the smaller id. Every row is indexed; ``window`` (ranks to either side) is measured
    on at most ``SAMPLE_ROWS`` rows if not given. Rows with the query's id are not its candidates;
    rows repeating id and vector count once, an id is returned once, at its smallest distance,
    and a query id with several vectors asks with the smallest. Equal vectors are indexed once,
    with their k + 1 smallest ids, so groups of copies stay small and ties exact. Null ids, and
    vectors that are null, empty, zero or hold a null or non-finite component take no part; a
    query only meets vectors of its own length. Empty tables give no rows.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows = rows.where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    rows = rows.groupBy("id", "v").agg(F.bool_or("q").alias("q"))
    rows = rows.withColumns({"dim": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    hashes = ["dim", "h1", "h2"]
    smallest = Window.partitionBy(*hashes).orderBy("id")
    # The limit is applied before the shuffle too.
    copies = rows.withColumn("at", F.row_number().over(smallest)).where(F.col("at") <= k + 1)
    distinct = copies.groupBy(*hashes).agg(F.first("v").alias("v"), F.array_sort(F.collect_set("id")).alias("ids"))
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v")).withColumns({"dim": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})

    sample: dict[int, list] = {}
    for r in distinct.select("dim", "v").orderBy(F.abs(F.xxhash64("h2"))).limit(SAMPLE_ROWS).collect():
        sample.setdefault(r.dim, []).append(r.v)
    fitted = {dim: Curves(dim, np.array(vs), curves) for dim, vs in sample.items()}
    n = distinct.count()
    if window is None:
        shares = [measured_window(np.array(vs), fitted[dim], k, target_recall) for dim, vs in sample.items()]
        window = max(LEAST_WINDOW, int(np.ceil(max(shares, default=0) * n)))

    def places(batches):
        made = dict(fitted)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in made:
                    made[dim] = Curves(dim, np.zeros((0, dim)), curves)
                matrix = _matrix(pa.chunked_array([part.column("v")]))
                for curve in range(curves):
                    yield pa.RecordBatch.from_arrays([
                        part.column("dim"), part.column("h1"), part.column("h2"), pa.array(np.full(len(matrix), curve, np.int32)),
                        pa.array(made[dim].places(matrix, curve))], names=[*hashes, "curve", "place"])

    placed = distinct.select(*hashes, "v").mapInArrow(places, "dim int, h1 bigint, h2 bigint, curve int, place bigint")
    ranked = position_in_group(placed, ["dim", "curve"], ["place", "h1", "h2"], "rank").drop("place")

    chunk = min(max(window, 256), chunk_rows)
    # Queries within reach of a chunk, if they are spread like the rows; each block of them is a task.
    share = max(1, queries.count()) / max(1, n)
    blocks = max(1, int(np.ceil((2 * window + chunk) * min(1.0, share) / block_queries)))
    chunk_of = lambda rank: F.floor(rank / chunk).cast("int")
    held = ranked.join(distinct, hashes).select("dim", "curve", chunk_of(F.col("rank")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "v", "ids")
    reach = F.sequence(chunk_of(F.greatest(F.col("rank") - window, F.lit(0))), chunk_of(F.col("rank") + window))
    asked = queries.join(ranked, hashes).select(
        F.col("dim").alias("dim"), F.col("curve").alias("curve"), F.explode(reach).alias("chunk"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "v")

    def search(held: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if held.num_rows and asked.num_rows:
            matrix, query_ids = _matrix(held["v"]), asked["id"].to_numpy()
            ids = held["ids"].combine_chunks()
            values, edges = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
            # The query's own vector may be a candidate, so one more is looked for.
            for q, found, distance in _nearest(_matrix(asked["v"]), matrix, k + 1, (values, edges)):
                counts = edges[found + 1] - edges[found]
                members = np.concatenate([values[edges[f]:edges[f + 1]] for f in found])
                far = np.repeat(distance, counts)
                other = members != query_ids[q]
                members, far = members[other], far[other]
                best = np.lexsort((members, far))
                best = best[np.sort(np.unique(members[best], return_index=True)[1])[:k]]
                out.append((np.full(len(best), query_ids[q]), members[best], far[best]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    by = ("dim", "curve", "chunk", "block")
    found = held.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
