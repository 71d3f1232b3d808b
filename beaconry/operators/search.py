"""Keyset-paged search, trace lookup, per-trace top-n and log/span correlation."""

from pyspark.sql import DataFrame, Window, functions as F

from beaconry.functions.times import ntz
from beaconry.operators.filters import log_filter, span_filter
from beaconry.plans.skew import HOT_ROWS, join_unique

DEFAULT_PAGE_SIZE = 200


def page_limit(page_size) -> int:
    if (page_size or DEFAULT_PAGE_SIZE) < 1:
        raise ValueError("a page has at least one row")
    return page_size or DEFAULT_PAGE_SIZE


def keyset_page(df: DataFrame, keys: list[str], cursor, page_size) -> DataFrame:
    """The newest ``page_size + 1`` rows strictly before ``cursor`` in descending key order.

    The extra row tells whether another page exists. The first key is also compared on its
    own, because only a scalar comparison reaches the Parquet scan.
    """
    if cursor is not None:
        first, *rest = cursor
        values = [ntz(first), *[F.lit(v) for v in rest]]
        df = df.where(F.col(keys[0]) <= values[0])
        df = df.where(F.struct(*keys) < F.struct(*[v.alias(k) for v, k in zip(values, keys)]))
    return df.orderBy(*[F.col(k).desc() for k in keys]).limit(page_limit(page_size) + 1)


def log_search(df: DataFrame, cursor=None, page_size=None, **predicates) -> DataFrame:
    """Matching logs, newest first by (Timestamp, EventId)."""
    return keyset_page(log_filter(df, **predicates), ["Timestamp", "EventId"], cursor, page_size)


def span_search(df: DataFrame, cursor=None, page_size=None, **predicates) -> DataFrame:
    """Matching spans, newest first by (StartTime, TraceId, SpanId)."""
    return keyset_page(span_filter(df, **predicates), ["StartTime", "TraceId", "SpanId"], cursor, page_size)


def trace_by_id(df: DataFrame, trace_id: str, cap: int | None = None) -> DataFrame:
    """The spans of one trace by start time, with no time bound; the first ``cap`` if one is given."""
    spans = df.where(F.col("TraceId") == trace_id).orderBy("StartTime", "SpanId")
    return spans if cap is None else spans.limit(cap)


def slowest_spans(df: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` longest spans of every trace, with their rank."""
    order = Window.partitionBy("TraceId").orderBy(F.desc("DurationNano"), "StartTime", "SpanId")
    return df.withColumn("Rank", F.row_number().over(order)).where(F.col("Rank") <= n)


def with_span_duration(logs: DataFrame, spans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Logs with the duration of their enclosing span (NULL when there is none).

    Logs without ids can never match and pass the join by.
    """
    has_ids = F.coalesce((F.col("TraceId") != "") & (F.col("SpanId") != ""), F.lit(False))
    durations = spans.where(has_ids).groupBy("TraceId", "SpanId").agg(F.max("DurationNano").alias("SpanDurationNano"))
    matched = join_unique(logs.where(has_ids), durations, ["TraceId", "SpanId"], hot_rows=hot_rows)
    unmatched = logs.where(~has_ids).withColumn("SpanDurationNano", F.lit(None).cast(durations.schema["SpanDurationNano"].dataType))
    return matched.unionByName(unmatched)


def with_span_count(roots: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows with the number of spans their trace holds over the whole table (default 1)."""
    counts = spans.groupBy("TraceId").agg(F.count(F.lit(1)).alias("SpanCount"))
    return roots.join(counts, ["TraceId"], "left").withColumn("SpanCount", F.coalesce("SpanCount", F.lit(1).cast("bigint")))


def trace_logs(logs: DataFrame, spans: DataFrame, by_span: bool = False) -> DataFrame:
    """Logs that belong to the given spans' traces (or to exactly those spans)."""
    keys = ["TraceId", "SpanId"] if by_span else ["TraceId"]
    wanted = spans.select(*keys)
    for key in keys:
        wanted = wanted.where(F.col(key) != "")
        logs = logs.where(F.col(key) != "")
    return join_unique(logs, wanted.distinct(), keys, "left_semi")
