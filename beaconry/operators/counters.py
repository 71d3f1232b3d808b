"""Rates and growth of monotonic counters, for any table of samples."""

from pyspark.sql import DataFrame, functions as F

from beaconry.functions.times import ntz, seconds_between
from beaconry.plans.ordered import previous_row


def counter_rate(df: DataFrame, keys: list[str], ts: str, value: str, order: list[str] | None = None) -> DataFrame:
    """``max(0, Δvalue / Δseconds)`` to the previous sample of the key; 0 without one."""
    df = previous_row(df, keys, [ts, *(order or [])], [ts, value])
    elapsed = seconds_between(F.col(f"prev_{ts}"), F.col(ts)).cast("double")
    rate = F.greatest(F.lit(0.0), (F.col(value) - F.col(f"prev_{value}")) / F.nullif(elapsed, F.lit(0.0)))
    usable = F.coalesce(elapsed > 0, F.lit(False))
    return df.withColumn("Rate", F.when(usable, rate).otherwise(F.lit(0.0))).drop(f"prev_{ts}", f"prev_{value}")


def busy_percent(df: DataFrame, keys: list[str], ts: str, idle: str, total: str, order: list[str] | None = None) -> DataFrame:
    """100·(1 - Δidle/Δtotal) within 0..100; 0 when the total did not grow."""
    df = previous_row(df, keys, [ts, *(order or [])], [idle, total])
    d_total = F.col(total) - F.col(f"prev_{total}")
    d_idle = F.col(idle) - F.col(f"prev_{idle}")
    percent = (d_total - d_idle) * F.lit(100.0) / F.nullif(d_total, F.lit(0))
    clamped = F.least(F.lit(100.0), F.greatest(F.lit(0.0), percent))
    usable = F.coalesce(d_total > 0, F.lit(False))
    return df.withColumn("BusyPercent", F.when(usable, clamped).otherwise(F.lit(0.0))).drop(f"prev_{idle}", f"prev_{total}")


def growth_per_day(df: DataFrame, keys: list[str], ts: str, value: str, min_span_s: float, now=None) -> DataFrame:
    """(last - first) / days per key once the span reaches the minimum, plus its hours.

    The span ends at ``now`` when given, else at the newest sample.
    """
    edges = df.groupBy(*keys).agg(
        F.min(ts).alias("_t0"), F.max(ts).alias("_t1"), F.min_by(value, ts).alias("_v0"), F.max_by(value, ts).alias("_v1")
    )
    end = ntz(now) if now is not None else F.col("_t1")
    span = seconds_between(F.col("_t0"), end).cast("double")
    enough = (span >= F.lit(float(min_span_s))) & (span > 0)
    days = F.nullif(span, F.lit(0.0)) / F.lit(86_400.0)
    return edges.select(
        *keys, F.when(enough, (F.col("_v1") - F.col("_v0")) / days).alias("PerDay"),
        F.greatest(F.lit(0.0), span / F.lit(3600.0)).alias("SpanHours"),
    )
