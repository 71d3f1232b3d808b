"""Row predicates over logs, spans and metric points.

Every function takes a DataFrame first, so ``df.transform(log_filter, frm=..., to=...)``
works. An absent predicate (``None``, empty list, empty string) does not filter. When the
table has a ``month`` partition column, the time bound is repeated on it so that
partition pruning fires.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from beaconry.functions.attributes import attribute
from beaconry.functions.columns import as_column
from beaconry.functions.severity import in_severity_buckets
from beaconry.functions.times import ntz

DEFAULT_LOOKBACK = dt.timedelta(hours=1)
MONTH = "month"

LOG_BAGS = {"log": "LogAttributes", "resource": "ResourceAttributes", "scope": "ScopeAttributes"}
SPAN_BAGS = {"span": "SpanAttributes", "resource": "ResourceAttributes", "scope": "ScopeAttributes"}
METRIC_BAGS = {"datapoint": "DataPointAttributes"}


def as_datetime(value) -> dt.datetime:
    value = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    if value.tzinfo is not None:
        value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return value


def resolve_range(frm=None, to=None, now=None, lookback: dt.timedelta = DEFAULT_LOOKBACK):
    """``[frm, to)`` with the defaults ``now - lookback`` and ``now``."""
    if (frm is None or to is None) and now is None:
        raise ValueError("now is required when either end of the time range is open")
    frm = as_datetime(frm) if frm is not None else as_datetime(now) - lookback
    to = as_datetime(to) if to is not None else as_datetime(now)
    return frm, to


def time_bound(df: DataFrame, column: str, frm=None, to=None, now=None) -> DataFrame:
    """Rows of the half-open range ``[frm, to)``."""
    frm, to = resolve_range(frm, to, now)
    if MONTH in df.columns:
        df = df.where(F.col(MONTH).between(frm.strftime("%Y-%m"), to.strftime("%Y-%m")))
    ts = F.col(column)
    return df.where((ts >= ntz(frm)) & (ts < ntz(to)))


def one_of(df: DataFrame, column: str, values) -> DataFrame:
    return df.where(F.col(column).isin(list(values))) if values else df


def equals(df: DataFrame, column: str, value) -> DataFrame:
    return df.where(F.col(column) == value) if value else df


def body_matches(term: str, column="Body") -> Column:
    """Case-insensitive pattern search; ``%`` and ``_`` inside the term are wildcards."""
    return as_column(column).ilike(f"%{term}%")


def body_contains(term: str, column="Body") -> Column:
    """Case-insensitive literal search."""
    return F.lower(as_column(column)).contains(term.lower())


def attribute_equals(bag_column: str, key: str, value: str) -> Column:
    """Stored rows: a missing key reads as ``''``."""
    return attribute(bag_column, key) == F.lit(value)


def attribute_present_and_equals(bag_column: str, key: str, value: str) -> Column:
    """Live rows: a missing key never matches."""
    return F.coalesce(F.col(bag_column)[key] == F.lit(value), F.lit(False))


def attributes_match(df: DataFrame, bags: dict, attributes, default_bag: str) -> DataFrame:
    """Every ``(bag, key, value)`` (or ``(key, value)``) of ``attributes`` holds."""
    for item in attributes or ():
        bag, key, value = item if len(item) == 3 else (default_bag, *item)
        df = df.where(attribute_equals(bags[bag], key, value))
    return df


def severity_filter(df: DataFrame, buckets) -> DataFrame:
    """Rows whose severity number falls in one of the named buckets."""
    return df.where(in_severity_buckets("SeverityNumber", buckets)) if buckets else df


def log_filter(df: DataFrame, frm=None, to=None, now=None, services=None, severities=None, trace_id=None,
               span_id=None, pattern_id=None, search=None, attributes=None) -> DataFrame:
    """Logs satisfying every present predicate."""
    df = time_bound(df, "Timestamp", frm, to, now)
    df = one_of(df, "ServiceName", services)
    df = one_of(df, "SeverityNumber", severities)
    df = equals(df, "TraceId", trace_id)
    df = equals(df, "SpanId", span_id)
    df = equals(df, "PatternId", pattern_id)
    if search:
        df = df.where(body_matches(search))
    return attributes_match(df, LOG_BAGS, attributes, "log")


def span_filter(df: DataFrame, frm=None, to=None, now=None, services=None, kinds=None, status_codes=None,
                trace_id=None, root_only=False, min_duration=None, max_duration=None,
                attributes=None) -> DataFrame:
    """Spans satisfying every present predicate; duration bounds (ns) are inclusive."""
    df = time_bound(df, "StartTime", frm, to, now)
    df = one_of(df, "ServiceName", services)
    df = one_of(df, "Kind", kinds)
    df = one_of(df, "StatusCode", status_codes)
    df = equals(df, "TraceId", trace_id)
    if root_only:
        df = df.where(F.col("ParentSpanId") == "")
    if min_duration is not None:
        df = df.where(F.col("DurationNano") >= min_duration)
    if max_duration is not None:
        df = df.where(F.col("DurationNano") <= max_duration)
    return attributes_match(df, SPAN_BAGS, attributes, "span")


def metric_filter(df: DataFrame, frm=None, to=None, now=None, services=None, attributes=None,
                  metric=None) -> DataFrame:
    """Metric points satisfying every present predicate."""
    df = equals(df, "MetricName", metric)
    df = time_bound(df, "Time", frm, to, now)
    df = one_of(df, "ServiceName", services)
    return attributes_match(df, METRIC_BAGS, attributes, "datapoint")
