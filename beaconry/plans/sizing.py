"""Measured broadcasts: a side is only broadcast after its size has been checked."""

from pyspark.sql import DataFrame, functions as F

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Whether ``df`` stays within both bounds, measured on at most ``max_rows + 1`` rows."""
    row = df.limit(max_rows + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))), F.lit(0)).alias("b"),
    ).head()
    return row["n"] <= max_rows and row["b"] <= max_bytes


def broadcast_if_small(df: DataFrame, **bounds) -> DataFrame:
    """``df`` with a broadcast hint when it is small; unhinted (shuffle join) otherwise."""
    return F.broadcast(df) if is_small(df, **bounds) else df
