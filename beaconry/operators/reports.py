"""Storage and query-latency reports over file metadata and a query log."""

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beaconry.functions.times import ntz
from beaconry.operators.filters import as_datetime
from beaconry.plans.quantiles import exact_quantiles

# Thresholds of the storage checks.
FRAGMENTED_FILES = 150
CONCENTRATION_PERCENT = 70.0
GROWTH_DAYS = 7
GROWTH_SKEW = 3.0
LOW_COMPRESSION = 2.0
SLOW_MS = 500.0
QUANTILES = {"P50Ms": 0.5, "P95Ms": 0.95, "P99Ms": 0.99}


def table_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(TableName, File, Bytes, Modified, Rows) of every Parquet file of the named tables."""
    def files(name, path):
        meta = spark.read.parquet(path).select(
            F.col("_metadata.file_path").alias("File"), F.col("_metadata.file_size").alias("Bytes"),
            F.col("_metadata.file_modification_time").alias("Modified"),
        )
        counted = meta.groupBy("File", "Bytes", "Modified").agg(F.count(F.lit(1)).alias("Rows"))
        return counted.select(F.lit(name).alias("TableName"), "File", "Bytes", "Modified", "Rows")

    return reduce(DataFrame.unionByName, [files(n, p) for n, p in paths.items()])


def table_storage(files: DataFrame) -> DataFrame:
    """Rows, files and bytes per table, largest first; many files mean fragmentation."""
    return (
        files.groupBy("TableName")
        .agg(F.sum("Rows").alias("Rows"), F.count(F.lit(1)).alias("Files"), F.sum("Bytes").alias("Bytes"))
        .withColumn("Fragmented", F.col("Files") >= FRAGMENTED_FILES)
        .orderBy(F.desc("Bytes"), "TableName")
    )


def storage_growth(files: DataFrame, now=None, days: int = 30) -> DataFrame:
    """Bytes and rows of the files written per day and table over the last ``days`` days."""
    end = F.current_timestamp() if now is None else ntz(as_datetime(now)).cast("timestamp")
    recent = files.where(F.col("Modified") >= end - F.make_dt_interval(days=F.lit(days)))
    return (
        recent.groupBy(F.to_date("Modified").alias("Day"), "TableName")
        .agg(F.sum("Bytes").alias("Bytes"), F.sum("Rows").alias("Rows")).orderBy("Day", "TableName")
    )


def in_signal(signal: str) -> Column:
    """Which tables count towards 'total', 'logs', 'traces' or 'metrics'."""
    name = F.col("TableName")
    return {
        "total": F.lit(True), "logs": name == "logs", "traces": name == "spans", "metrics": name.startswith("metrics_"),
    }[signal]


SIGNALS = ("total", "logs", "traces", "metrics")


def avg_daily_growth(growth: DataFrame, signals=SIGNALS) -> DataFrame:
    """Per signal: bytes and rows per day over the last seven days that are present at all.

    No rows when there is no growth data; a signal without growth of its own gets 0.
    """
    # ``growth`` has one row per day and table, so ranking its days is a small job.
    per_day = growth.groupBy("Day").agg(*[
        F.coalesce(F.sum(F.when(in_signal(s), F.col(c))), F.lit(0)).cast("double").alias(f"{s}_{c}")
        for s in signals for c in ("Bytes", "Rows")
    ])
    last = per_day.orderBy(F.desc("Day")).limit(GROWTH_DAYS)
    sums = last.agg(F.count(F.lit(1)).alias("WindowDays"), *[
        F.sum(f"{s}_{c}").alias(f"{s}_{c}") for s in signals for c in ("Bytes", "Rows")
    ]).where(F.col("WindowDays") > 0)
    rows = F.array(*[
        F.struct(F.lit(s).alias("Signal"), (F.col(f"{s}_Bytes") / F.col("WindowDays")).alias("BytesPerDay"),
                 (F.col(f"{s}_Rows") / F.col("WindowDays")).alias("RowsPerDay"))
        for s in signals
    ])
    return sums.select(F.inline(rows), "WindowDays").select("Signal", "BytesPerDay", "RowsPerDay", "WindowDays")


def storage_checks(storage: DataFrame, growth: DataFrame) -> DataFrame:
    """(Check, Tone, Value, Subject) for fragmentation, row concentration, growth and compression.

    ``Tone`` is good, warning or unavailable. ``storage`` may carry ``UncompressedBytes``.
    """
    raw = F.col("UncompressedBytes") if "UncompressedBytes" in storage.columns else F.lit(None).cast("bigint")
    # One row per table: a handful of rows.
    facts = storage.agg(
        F.sum("Bytes").alias("bytes"), F.sum(raw).alias("raw"), F.sum("Rows").alias("rows"),
        F.count_if("Fragmented").alias("fragmented"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("Fragmented"), F.col("TableName")))), ", ").alias("names"),
        F.max("Rows").alias("most"), F.min_by("TableName", F.struct((-F.col("Rows")).alias("r"), F.col("TableName"))).alias("largest"),
    )
    rates = avg_daily_growth(growth, SIGNALS[1:]).agg(
        F.count_if(F.col("BytesPerDay") > 0).alias("growing"), F.max("BytesPerDay").alias("fast"), F.min("BytesPerDay").alias("slow"),
        F.min_by("Signal", F.struct((-F.col("BytesPerDay")).alias("b"), F.col("Signal"))).alias("fastest"),
    )
    both = facts.withColumn("_k", F.lit(1)).join(rates.withColumn("_k", F.lit(1)), "_k")
    none = F.coalesce("rows", F.lit(0)) <= 0
    ratio = F.col("raw") / F.nullif(F.col("bytes"), F.lit(0))
    share = F.col("most") / F.nullif(F.col("rows"), F.lit(0)) * 100
    skew = F.col("fast") / F.nullif(F.col("slow"), F.lit(0.0))
    warn_if = lambda c: F.when(F.coalesce(c, F.lit(False)), "warning").otherwise("good")
    check = lambda name, tone, value, subject: F.struct(
        F.lit(name).alias("Check"), tone.alias("Tone"), value.cast("double").alias("Value"), subject.alias("Subject"))
    enough = ~none & (F.col("growing") >= 2)
    return both.select(F.inline(F.array(
        check("compression", F.when(F.col("raw").isNull() & ~none, "unavailable").otherwise(warn_if(ratio < LOW_COMPRESSION)), ratio, F.lit("")),
        check("parts", warn_if(F.col("fragmented") > 0), F.col("fragmented"), F.col("names")),
        check("row-concentration", warn_if(~none & (share >= CONCENTRATION_PERCENT)), share, F.col("largest")),
        check("growth-skew", warn_if(enough & ((F.col("slow") <= 0) | (skew >= GROWTH_SKEW))), F.when(enough, skew), F.coalesce("fastest", F.lit(""))),
    )))


def query_latency(log: DataFrame, now, minutes: int = 60, slow_ms: float = SLOW_MS) -> DataFrame:
    """One row: exact p50 / p95 / p99, slow queries and samples of the last ``minutes``."""
    now = as_datetime(now)
    recent = log.where((F.col("EventTime") >= ntz(now - dt.timedelta(minutes=minutes))) & (F.col("EventTime") <= ntz(now)))
    totals = recent.agg(F.count_if(F.col("DurationMs") > slow_ms).alias("SlowCount"), F.count("DurationMs").alias("SampleCount"))
    found = exact_quantiles(recent, "DurationMs", QUANTILES)
    wide = found.agg(*[F.max(F.when(F.col("Name") == n, F.col("Value"))).alias(n) for n in QUANTILES])
    return totals.withColumn("_k", F.lit(1)).join(wide.withColumn("_k", F.lit(1)), "_k").select(
        *QUANTILES, "SlowCount", "SampleCount"
    )
