"""Joins whose probe side may hold very many rows of one key."""

from pyspark.sql import DataFrame, functions as F

from beaconry.plans.lineage import cut
from beaconry.plans.sizing import broadcast_if_small

HOT_ROWS = 1_000_000
# A key at the limit has about this many rows in the sample.
_SEEN = 2_000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join ``left`` to ``right``, which has at most one row per key, on non-NULL keys.

    Adaptive execution cannot split a hot key when the other side was just aggregated on
    it. So keys with about ``hot_rows`` rows or more are found first, on a sample of the key
    columns (one narrow scan; only the sampled keys are shuffled); their rows stay where they
    are and meet their partners by broadcast, everything else takes the ordinary shuffle
    join. The sample decides the plan only, never a row.
    """
    share = min(1.0, _SEEN / max(1, hot_rows))
    sampled = left.select(*keys) if share == 1.0 else left.select(*keys).sample(share, seed=1)
    counts = sampled.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    hot = cut(counts.where(F.col("_n") > hot_rows * share).select(*keys))
    if hot.isEmpty():
        return left.join(right, keys, how)
    marked = broadcast_if_small(hot)
    partners = broadcast_if_small(cut(right.join(marked, keys, "left_semi")))
    return (
        left.join(marked, keys, "left_anti").join(right, keys, how)
        .unionByName(left.join(marked, keys, "left_semi").join(partners, keys, how))
    )
