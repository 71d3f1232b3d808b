"""Aggregations over logs and the ad-hoc log query."""

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, functions as F, types as T

from beaconry.functions.attributes import attribute, numeric_or_null
from beaconry.functions.severity import ERROR_FLOOR
from beaconry.functions.times import bucket_start, ntz, seconds_between
from beaconry.operators.filters import resolve_range, time_bound

DEFAULT_TOP_PATTERNS = 200
DEFAULT_SAMPLE = 4000
COLUMN_TABLE_ROWS = 100
VALUE_BINS = 24

GROUP_COLUMNS = {"none": None, "service": "ServiceName", "level": "SeverityText"}
QUERY_COLUMNS = {
    "service": "ServiceName", "level": "SeverityText", "body": "Body", "traceid": "TraceId",
    "spanid": "SpanId", "severitynumber": "SeverityNumber",
}


def _bucketed(df: DataFrame, width_s: int, group_by: str, aggregate) -> DataFrame:
    keys = [bucket_start(F.col("Timestamp"), width_s).alias("BucketStart")]
    column = GROUP_COLUMNS[group_by or "none"]
    if column:
        keys.append(F.col(column).alias("GroupKey"))
    return df.groupBy(*keys).agg(aggregate).orderBy("BucketStart", *(["GroupKey"] if column else []))


def _aggregate(function: str, column: str = "SeverityNumber"):
    """count / avg / sum as one double, 0 on empty input."""
    if function == "count":
        return F.count(F.lit(1)).cast("double")
    value = {"avg": F.avg, "sum": F.sum}[function](F.col(column)).cast("double")
    return F.coalesce(value, F.lit(0.0))


def log_volume(df: DataFrame, width_s: int, group_by: str = "none") -> DataFrame:
    """Events per time bucket, optionally per service or severity text."""
    return _bucketed(df, width_s, group_by, F.count(F.lit(1)).alias("Count"))


def log_scalar(df: DataFrame, function: str = "count", column: str = "SeverityNumber") -> DataFrame:
    return df.agg(_aggregate(function, column).alias("Value"))


def log_series(df: DataFrame, function: str, width_s: int, group_by: str = "none",
               column: str = "SeverityNumber") -> DataFrame:
    return _bucketed(df, width_s, group_by, _aggregate(function, column).alias("Value"))


def log_patterns(df: DataFrame, top_n: int = DEFAULT_TOP_PATTERNS) -> DataFrame:
    """The most frequent templates with error counts and first / last sighting.

    The raw rows are grouped by (id, template) so that the first aggregation keeps
    fixed-width buffers; folding the few templates of an id comes second.
    """
    top_n = top_n or DEFAULT_TOP_PATTERNS
    if top_n < 1:
        raise ValueError("top_n is at least 1")
    per_template = (
        df.where(F.col("PatternId") != "")
        .groupBy("PatternId", "PatternTemplate")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("SeverityNumber") >= ERROR_FLOOR).alias("e"),
            F.min("Timestamp").alias("a"),
            F.max("Timestamp").alias("z"),
        )
    )
    return (
        per_template.groupBy("PatternId")
        .agg(
            F.min("PatternTemplate").alias("Template"),
            F.sum("n").alias("Count"),
            F.sum("e").alias("ErrorCount"),
            F.min("a").alias("FirstSeen"),
            F.max("z").alias("LastSeen"),
        )
        .orderBy(F.desc("Count"), "PatternId")
        .limit(top_n)
    )


def active_services(df: DataFrame, now, window_s: int = 300) -> DataFrame:
    """Services seen since ``now - window_s``, most recent first."""
    since = ntz(now) - F.make_dt_interval(secs=F.lit(window_s))
    return (
        df.where((F.col("ServiceName") != "") & (F.col("Timestamp") >= since))
        .groupBy("ServiceName").agg(F.max("Timestamp").alias("LastSeen"))
        .orderBy(F.desc("LastSeen"), "ServiceName")
    )


def known_services(df: DataFrame) -> DataFrame:
    return df.select("ServiceName").where(F.col("ServiceName") != "").distinct().orderBy("ServiceName")


def numeric_attribute_keys(df: DataFrame) -> DataFrame:
    """Log-attribute keys with numeric values and how many rows carry one."""
    entries = df.select(F.explode("LogAttributes").alias("Key", "Raw"))
    return (
        entries.where(numeric_or_null("Raw").isNotNull())
        .groupBy("Key").agg(F.count(F.lit(1)).alias("NumericCount"))
        .orderBy(F.desc("NumericCount"), "Key")
    )


def numeric_values(df: DataFrame, key: str) -> DataFrame:
    """(EventId, Timestamp, Value) of the rows whose attribute ``key`` is numeric."""
    value = numeric_or_null(attribute("LogAttributes", key))
    return df.select("EventId", "Timestamp", value.alias("Value")).where(F.col("Value").isNotNull())


def value_sample(df: DataFrame, key: str, n: int = DEFAULT_SAMPLE, seed: int = 0) -> DataFrame:
    """A uniform, reproducible sample of ``n`` numeric values: the smallest seeded hashes."""
    if not key or n <= 0:
        raise ValueError("value_sample needs an attribute key and a positive sample size")
    order = F.md5(F.concat(F.col("EventId").cast("string"), F.lit(f"#{seed}")).cast("binary"))
    return (
        numeric_values(df, key).withColumn("_h", order)
        .orderBy("_h", "EventId").limit(n).select("Timestamp", "Value")
    )


def value_heatmap(points: DataFrame, frm, to, width_s: int, bins: int = VALUE_BINS,
                  log_scale: bool = False) -> DataFrame:
    """Cell counts of (time bucket, value bin) over all (Timestamp, Value) points.

    Value range = min..max of the points, widened by one on each side when they are equal;
    on a log scale non-positive values are dropped.
    """
    frm, to = resolve_range(frm, to)
    buckets = max(1, int((to - frm).total_seconds() / width_s + 0.5))
    if log_scale:
        points = points.where(F.col("Value") > 0)
    # One-row scalar subqueries: the range never leaves the executors' plan.
    low = points.agg(F.min("Value")).scalar()
    high = points.agg(F.max("Value")).scalar()
    ranged = points.withColumns({"_lo": low, "_hi": high})
    same = F.col("_lo") == F.col("_hi")
    lo, hi = F.when(same, F.col("_lo") - 1).otherwise(F.col("_lo")), F.when(same, F.col("_hi") + 1).otherwise(F.col("_hi"))
    x = F.col("Value")
    if log_scale:
        lo, hi, x = F.ln(lo), F.ln(hi), F.ln(x)
    position = F.when((hi == lo) | lo.isNull(), F.lit(0.0)).otherwise((x - lo) / (hi - lo))
    value_bin = F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(position * bins).cast("int")))
    offset = seconds_between(ntz(frm), F.col("Timestamp")) / F.lit(width_s)
    time_bin = F.least(F.lit(buckets - 1), F.greatest(F.lit(0), F.floor(offset).cast("int")))
    return (
        ranged.groupBy(time_bin.alias("TimeIndex"), value_bin.alias("ValueIndex"))
        .agg(F.count(F.lit(1)).alias("Count"))
    )


def _case_insensitive_like(where: str) -> str:
    """``like`` outside quoted text becomes ``ilike``; the rest is Spark SQL as written."""
    parts = re.split(r"('(?:[^']|'')*')", where)
    return "".join(p if i % 2 else re.sub(r"\blike\b", "ilike", p, flags=re.I) for i, p in enumerate(parts))


def query_where(df: DataFrame, where: str | None) -> DataFrame:
    """Rows satisfying a Spark SQL predicate over the short query columns and nothing else.

    The predicate is analysed on a table of those columns first; other columns, subqueries and
    text that is no predicate raise ValueError.
    """
    if not where:
        return df
    predicate = _case_insensitive_like(where)
    if re.search(r"\bselect\b", re.sub(r"'(?:[^']|'')*'", "''", where), flags=re.I):
        raise ValueError(f"subqueries are not allowed in {where!r}")
    try:
        # An empty table: a projection would still let a filter see the columns below it.
        allowed = T.StructType([T.StructField(n, df.schema[c].dataType) for n, c in QUERY_COLUMNS.items() if c in df.columns])
        df.sparkSession.createDataFrame([], allowed).where(F.expr(predicate))
    except (AnalysisException, ParseException) as error:
        raise ValueError(f"{where!r} is no predicate over {sorted(QUERY_COLUMNS)}") from error
    short = {n: F.col(c) for n, c in QUERY_COLUMNS.items() if n != c.lower()}
    return df.withColumns(short).where(F.expr(predicate)).drop(*short)


def column_table(df: DataFrame, columns: list[str], rows: int = COLUMN_TABLE_ROWS) -> DataFrame:
    """Chosen columns, newest first, with one row more than shown (is there more?)."""
    unknown = [c for c in columns if c.lower() not in QUERY_COLUMNS]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; choose from {sorted(QUERY_COLUMNS)}")
    chosen = [F.col(QUERY_COLUMNS[c.lower()]).alias(c.lower()) for c in columns]
    return df.orderBy(F.desc("Timestamp"), F.desc("EventId")).limit(rows + 1).select(*chosen)


def log_query(df: DataFrame, select="*", where: str | None = None, group_time: int | None = None,
              group_by: str = "none", frm=None, to=None, now=None, rows: int = COLUMN_TABLE_ROWS) -> DataFrame:
    """One ad-hoc query over the log stream.

    ``select`` is ``"*"`` (full rows), a list of column names (column table), or an
    aggregate: ``"count"``, ``("avg", column)``, ``("sum", column)``. With ``group_time``
    seconds an aggregate becomes a time series. ``where`` is a Spark SQL predicate over
    service, level, body, traceid, spanid and severitynumber, ``like`` ignoring case.
    Rows and column tables show ``rows`` rows and one more if there are more.
    """
    matched = query_where(time_bound(df, "Timestamp", frm, to, now), where)
    if select == "count" or isinstance(select, tuple):
        function, column = ("count", "severitynumber") if select == "count" else select
        column = QUERY_COLUMNS[column.lower()]
        if group_time:
            return log_series(matched, function, group_time, group_by, column)
        return log_scalar(matched, function, column)
    if group_time:
        raise ValueError("grouping needs an aggregate select")
    if select == "*":
        return matched.orderBy(F.desc("Timestamp"), F.desc("EventId")).limit(rows + 1)
    return column_table(matched, select, rows)
