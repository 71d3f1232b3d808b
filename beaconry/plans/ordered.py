"""Ordered computations over keys that may be hot.

A window over one key runs in one task. Here rows are range-partitioned by (keys, order), so the
rows of a hot key spread over several parts of like size, however close together they lie in
time. What a part needs from the parts before it (a sum, a last row, a minimum) is computed from
summaries, one row per key and part, and enters the part as one extra row in front of it. The
result is exact. There are as many parts as ``spark.sql.shuffle.partitions``; adaptive execution
merges small ones.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from beaconry.plans.lineage import cut
from beaconry.plans.sizing import broadcast_if_small

_PART, _ROW = "_part", "_row"


def _parted(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows with the number of their part, stored once: parts follow each other in ``order`` within a key."""
    return cut(df.repartitionByRange(*keys, *order).withColumns({_PART: F.spark_partition_id(), _ROW: F.lit(1)}))


def _with_carry(parted: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows plus the carry rows (``_row`` 0), which sort first in their part."""
    return parted.unionByName(carry.withColumn(_ROW, F.lit(0)), allowMissingColumns=True)


def _within(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys, _PART).orderBy(_ROW, *order)


def _rows_only(df: DataFrame) -> DataFrame:
    return df.where(F.col(_ROW) == 1).drop(_PART, _ROW)


def _before(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)


def running_total(df: DataFrame, keys: list[str], order: list, value: str, out: str) -> DataFrame:
    """Cumulative sum of ``value`` per key in ``order``."""
    parted = _parted(df, keys, order).withColumn(out, F.col(value))
    sums = parted.groupBy(*keys, _PART).agg(F.sum(value).alias("_sum"))
    carry = sums.select(*keys, _PART, F.sum("_sum").over(_before(keys)).alias(out)).where(F.col(out).isNotNull())
    upto = _within(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return _rows_only(_with_carry(parted, carry).withColumn(out, F.sum(out).over(upto)))


def previous_row(df: DataFrame, keys: list[str], order: list[str], columns: list[str], prefix: str = "prev_") -> DataFrame:
    """``lag(columns)`` per key in ``order``, as ``prev_<name>``."""
    parted = _parted(df, keys, order).withColumn("_carried", F.struct(*columns))
    lasts = parted.groupBy(*keys, _PART).agg(F.max_by("_carried", F.struct(*order)).alias("_last"))
    carry = lasts.select(
        *keys, _PART, F.lag("_last").over(Window.partitionBy(*keys).orderBy(_PART)).alias("_carried")
    ).where(F.col("_carried").isNotNull())
    lagged = _with_carry(parted, carry).withColumn("_prev", F.lag("_carried").over(_within(keys, order)))
    named = {f"{prefix}{c}": F.col("_prev").getField(c) for c in columns}
    return _rows_only(lagged.withColumns(named)).drop("_prev", "_carried")


def preceding_min(df: DataFrame, keys: list[str], order: list[str | Column], value: str, out: str) -> DataFrame:
    """Minimum of ``value`` over the rows before each row, per key in ``order``; NULL for the first row of a key."""
    parted = _parted(df, keys, order).withColumn("_value", F.col(value))
    lows = parted.groupBy(*keys, _PART).agg(F.min(value).alias("_min"))
    carry = lows.select(*keys, _PART, F.min("_min").over(_before(keys)).alias("_value")).where(F.col("_value").isNotNull())
    earlier = _within(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return _rows_only(_with_carry(parted, carry).withColumn(out, F.min("_value").over(earlier))).drop("_value")


def position_in_group(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """0-based position of each row in its group, for groups of any size.

    Rows are range-partitioned by (keys, order), so a large group spans many tasks; the
    row counts per (group, partition) give each task its offset.
    """
    ranged = (
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    fixed = cut(ranged)
    counts = fixed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = fixed.join(broadcast_if_small(offsets), [*keys, "_part"])
    return joined.withColumn(out, F.col("_pos") - F.col("_first") + F.col("_before")).drop(
        "_part", "_pos", "_first", "_before"
    )
