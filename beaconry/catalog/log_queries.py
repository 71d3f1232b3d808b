"""Registered queries over logs: filters, search, aggregations."""

from pyspark.sql import functions as F

from beaconry.catalog import tables as t
from beaconry.catalog.tables import oracle
from beaconry.operators import filters, logs as ops, search
from beaconry.functions.severity import severity_bucket

MONTH = dict(frm="2024-01-01", to="2024-02-01")
MID = dict(frm="2024-01-10", to="2024-01-20")
IN_MID = "Timestamp >= TIMESTAMP '2024-01-10' AND Timestamp < TIMESTAMP '2024-01-20'"
CUT = "2024-01-15 00:00:00"
NUMERIC = r"regexp_full_match({0}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"

QUERIES, ORACLES = {}, {}


def register(name, build, tables=None, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = oracle(tables, sql)


SLIM = ["EventId", "Timestamp", "ServiceName", "SeverityNumber", "Body"]
SLIM_SQL = ", ".join(SLIM)

register(
    "f1_log_filter",
    lambda spark, d: filters.log_filter(
        t.pattern_logs(spark, d), **MID, services=["svc-1", "svc-3"], severities=[17, 9], search="USER",
        attributes=[("resource", "host.name", "host-3"), ("log", "event_type", "click")],
    ).select(*SLIM),
    "pattern_logs",
    f"""SELECT {SLIM_SQL} FROM pattern_logs WHERE {IN_MID} AND ServiceName IN ('svc-1','svc-3')
    AND SeverityNumber IN (17, 9) AND Body ILIKE '%USER%' AND ResourceAttributes['host.name']='host-3'
    AND LogAttributes['event_type']='click'""",
)
register(
    "f2_default_time_bound",
    lambda spark, d: filters.log_filter(t.logs(spark, d), now="2024-01-20 12:00:00").select(*SLIM),
    "logs",
    f"""SELECT {SLIM_SQL} FROM logs WHERE Timestamp >= TIMESTAMP '2024-01-20 11:00:00'
    AND Timestamp < TIMESTAMP '2024-01-20 12:00:00'""",
)
register(
    "f3_search",
    lambda spark, d: t.logs(spark, d).select(
        "EventId", filters.body_matches("user 1_ took").alias("ilike_hit"),
        filters.body_contains("user 1_ took").alias("contains_hit"),
        filters.body_contains("ERROR BY").alias("literal_hit"),
    ),
    "logs",
    """SELECT EventId, Body ILIKE '%user 1_ took%' AS ilike_hit,
    contains(lower(Body), 'user 1_ took') AS contains_hit, contains(lower(Body), 'error by') AS literal_hit FROM logs""",
)
register(
    "f4_attribute_equality",
    lambda spark, d: t.spans(spark, d).select(
        "SpanId", filters.attribute_equals("SpanAttributes", "peer.service", "").alias("stored_missing"),
        filters.attribute_present_and_equals("SpanAttributes", "peer.service", "").alias("live_missing"),
        filters.attribute_equals("SpanAttributes", "peer.service", "ext-db").alias("stored_hit"),
    ),
    "spans",
    """SELECT SpanId, coalesce(SpanAttributes['peer.service'],'')='' AS stored_missing,
    coalesce(SpanAttributes['peer.service']='', false) AS live_missing,
    coalesce(SpanAttributes['peer.service'],'')='ext-db' AS stored_hit FROM spans""",
)
register(
    "f5_severity_buckets",
    lambda spark, d: filters.severity_filter(t.logs(spark, d), ["warn", "ERROR", "fatal"])
    .groupBy(severity_bucket("SeverityNumber").alias("Bucket"), "ServiceName").agg(F.count(F.lit(1)).alias("n")),
    "logs",
    """SELECT CASE WHEN SeverityNumber BETWEEN 13 AND 16 THEN 'WARN' WHEN SeverityNumber BETWEEN 17 AND 20 THEN 'ERROR'
    ELSE 'FATAL' END AS Bucket, ServiceName, count(*) AS n FROM logs WHERE SeverityNumber BETWEEN 13 AND 24 GROUP BY 1,2""",
)
register(
    "f6_span_filter",
    lambda spark, d: filters.span_filter(
        t.spans(spark, d), **MID, services=["svc-2", "svc-4"], kinds=[0, 2, 4], root_only=True,
        status_codes=["STATUS_CODE_OK", "STATUS_CODE_ERROR"], min_duration=1_000_000, max_duration=60_000_000,
        attributes=[("db.system", "")],
    ).select("TraceId", "SpanId", "StartTime", "DurationNano"),
    "spans",
    """SELECT TraceId, SpanId, StartTime, DurationNano FROM spans WHERE StartTime >= TIMESTAMP '2024-01-10'
    AND StartTime < TIMESTAMP '2024-01-20' AND ServiceName IN ('svc-2','svc-4') AND Kind IN (0,2,4) AND ParentSpanId=''
    AND StatusCode IN ('STATUS_CODE_OK','STATUS_CODE_ERROR') AND DurationNano BETWEEN 1000000 AND 60000000
    AND coalesce(SpanAttributes['db.system'],'')=''""",
)
register(
    "f7_metric_filter",
    lambda spark, d: filters.metric_filter(
        t.gauge(spark, d), **MID, services=["svc-5"], attributes=[("region", "1")], metric="app.click"
    ).select("Time", "Value", "ServiceName"),
    "gauge",
    """SELECT Time, Value, ServiceName FROM gauge WHERE Time >= TIMESTAMP '2024-01-10' AND Time < TIMESTAMP '2024-01-20'
    AND ServiceName='svc-5' AND DataPointAttributes['region']='1' AND MetricName='app.click'""",
)
WHERE = "(service = 'svc-1' or level != 'Debug') and not body like '%CLICK%' and body like '%USER 1%'"
WHERE_SQL = "(ServiceName='svc-1' OR SeverityText<>'Debug') AND NOT (Body ILIKE '%CLICK%') AND Body ILIKE '%USER 1%'"
register(
    "f8_log_query_series",
    lambda spark, d: ops.log_query(t.logs(spark, d), "count", WHERE, 3600, "service", **MID),
    "logs",
    f"""SELECT time_bucket(INTERVAL 3600 SECONDS, Timestamp) AS BucketStart, ServiceName AS GroupKey,
    CAST(count(*) AS DOUBLE) AS Value FROM logs WHERE {IN_MID} AND {WHERE_SQL} GROUP BY 1,2""",
)
register(
    "f8_log_query_scalar",
    lambda spark, d: ops.log_query(t.logs(spark, d), ("avg", "severitynumber"), WHERE, **MID)
    .select(F.round("Value", 6).alias("Value")),
    "logs",
    f"SELECT round(coalesce(avg(SeverityNumber),0.0),6) AS Value FROM logs WHERE {IN_MID} AND {WHERE_SQL}",
)
register(
    "f8_log_query_rows",
    lambda spark, d: ops.log_query(t.logs(spark, d), "*", WHERE, **MID).select(*SLIM),
    "logs",
    f"SELECT {SLIM_SQL} FROM logs WHERE {IN_MID} AND {WHERE_SQL} ORDER BY Timestamp DESC, EventId DESC LIMIT 101",
)
register(
    "f9_column_table",
    lambda spark, d: ops.log_query(t.logs(spark, d), ["service", "level", "body"], "level = 'Error'", **MID),
    "logs",
    f"""SELECT ServiceName AS service, SeverityText AS level, Body AS body FROM logs WHERE {IN_MID} AND SeverityText='Error'
    ORDER BY Timestamp DESC, EventId DESC LIMIT 101""",
)

register(
    "k1_log_search",
    lambda spark, d: search.log_search(
        t.logs(spark, d), cursor=(CUT, 5000), page_size=200, **MONTH, services=["svc-1", "svc-2", "svc-3"]
    ).select(*SLIM),
    "logs",
    f"""SELECT {SLIM_SQL} FROM logs WHERE Timestamp >= TIMESTAMP '2024-01-01' AND Timestamp < TIMESTAMP '2024-02-01'
    AND ServiceName IN ('svc-1','svc-2','svc-3') AND (Timestamp, EventId) < (TIMESTAMP '{CUT}', 5000)
    ORDER BY Timestamp DESC, EventId DESC LIMIT 201""",
)
register(
    "k2_span_search",
    lambda spark, d: search.span_search(
        t.spans(spark, d), cursor=(CUT, "8", "8"), page_size=1000, **MONTH
    ).select("TraceId", "SpanId", "StartTime", "DurationNano"),
    "spans",
    f"""SELECT TraceId, SpanId, StartTime, DurationNano FROM spans WHERE StartTime >= TIMESTAMP '2024-01-01'
    AND StartTime < TIMESTAMP '2024-02-01' AND (StartTime, TraceId, SpanId) < (TIMESTAMP '{CUT}', '8', '8')
    ORDER BY StartTime DESC, TraceId DESC, SpanId DESC LIMIT 1001""",
)
register(
    "k3_trace_by_id",
    lambda spark, d: search.trace_by_id(t.spans(spark, d), "f899139df5e1059396431415e770c6dd")
    .select("TraceId", "SpanId", "ParentSpanId", "StartTime", "DurationNano"),
    "spans",
    """SELECT TraceId, SpanId, ParentSpanId, StartTime, DurationNano FROM spans
    WHERE TraceId='f899139df5e1059396431415e770c6dd' ORDER BY StartTime, SpanId LIMIT 10000""",
)
register(
    "k4_slowest_spans",
    lambda spark, d: search.slowest_spans(t.spans(spark, d)).select("TraceId", "SpanId", "DurationNano", "Rank"),
    "spans",
    """SELECT * FROM (SELECT TraceId, SpanId, DurationNano, CAST(row_number() OVER
    (PARTITION BY TraceId ORDER BY DurationNano DESC, StartTime, SpanId) AS INT) AS Rank FROM spans) WHERE Rank <= 5""",
)
# Every third log loses its trace context, so the no-ids path is exercised too.
def _bare(logs):
    return logs.withColumn("SpanId", F.when(F.col("EventId") % 3 == 0, "").otherwise(F.col("SpanId")))


register(
    "j1_with_span_duration",
    lambda spark, d: search.with_span_duration(
        _bare(t.logs(spark, d)), t.spans(spark, d)
    ).select("EventId", "TraceId", "SpanId", "SpanDurationNano"),
    "logs spans",
    """+l AS (SELECT EventId, TraceId, CASE WHEN EventId % 3 = 0 THEN '' ELSE SpanId END AS SpanId FROM logs)
    SELECT EventId, l.TraceId, l.SpanId, s.n AS SpanDurationNano FROM l LEFT JOIN
    (SELECT TraceId, SpanId, max(DurationNano) AS n FROM spans GROUP BY 1,2) s ON l.TraceId=s.TraceId AND l.SpanId=s.SpanId""",
)
register(
    "j2_with_span_count",
    lambda spark, d: search.with_span_count(
        filters.span_filter(t.spans(spark, d), **MID, root_only=True), t.spans(spark, d)
    ).select("TraceId", "SpanId", "SpanCount"),
    "spans",
    """SELECT r.TraceId, r.SpanId, coalesce(c.n, 1) AS SpanCount FROM spans r LEFT JOIN
    (SELECT TraceId, count(*) AS n FROM spans GROUP BY 1) c ON r.TraceId=c.TraceId WHERE r.ParentSpanId=''
    AND r.StartTime >= TIMESTAMP '2024-01-10' AND r.StartTime < TIMESTAMP '2024-01-20'""",
)
register(
    "j4_trace_logs",
    lambda spark, d: search.trace_logs(
        t.logs(spark, d), filters.span_filter(t.spans(spark, d), **MID, status_codes=["STATUS_CODE_ERROR"])
    ).select("EventId", "TraceId", "Body"),
    "logs spans",
    """SELECT EventId, TraceId, Body FROM logs WHERE TraceId IN (SELECT TraceId FROM spans WHERE StatusCode='STATUS_CODE_ERROR'
    AND StartTime >= TIMESTAMP '2024-01-10' AND StartTime < TIMESTAMP '2024-01-20')""",
)

register(
    "e1_log_volume",
    lambda spark, d: ops.log_volume(filters.time_bound(t.logs(spark, d), "Timestamp", **MONTH), 3600, "service"),
    "logs",
    """SELECT time_bucket(INTERVAL 3600 SECONDS, Timestamp) AS BucketStart, ServiceName AS GroupKey, count(*) AS Count
    FROM logs WHERE Timestamp >= TIMESTAMP '2024-01-01' AND Timestamp < TIMESTAMP '2024-02-01' GROUP BY 1,2""",
)
register(
    "e1_log_volume_level",
    lambda spark, d: ops.log_volume(filters.time_bound(t.logs(spark, d), "Timestamp", **MONTH), 300, "level"),
    "logs",
    """SELECT time_bucket(INTERVAL 300 SECONDS, Timestamp) AS BucketStart, SeverityText AS GroupKey, count(*) AS Count
    FROM logs WHERE Timestamp >= TIMESTAMP '2024-01-01' AND Timestamp < TIMESTAMP '2024-02-01' GROUP BY 1,2""",
)
register(
    "e2_log_scalar",
    lambda spark, d: ops.log_scalar(t.logs(spark, d).where("ServiceName = 'nobody'"), "avg")
    .select(F.lit("empty").alias("Case"), "Value")
    .unionByName(ops.log_scalar(t.logs(spark, d), "sum").select(F.lit("sum").alias("Case"), "Value"))
    .unionByName(ops.log_scalar(t.logs(spark, d), "count").select(F.lit("count").alias("Case"), "Value")),
    "logs",
    """SELECT 'empty' AS "Case", 0.0::DOUBLE AS Value UNION ALL SELECT 'sum', CAST(sum(SeverityNumber) AS DOUBLE) FROM logs
    UNION ALL SELECT 'count', CAST(count(*) AS DOUBLE) FROM logs""",
)
register(
    "e3_log_series",
    lambda spark, d: ops.log_series(t.logs(spark, d), "avg", 7200, "service")
    .select("BucketStart", "GroupKey", F.round("Value", 6).alias("Value")),
    "logs",
    """SELECT time_bucket(INTERVAL 7200 SECONDS, Timestamp) AS BucketStart, ServiceName AS GroupKey,
    round(avg(SeverityNumber),6) AS Value FROM logs GROUP BY 1,2""",
)
register(
    "e4_log_patterns",
    lambda spark, d: ops.log_patterns(t.pattern_logs(spark, d)),
    "pattern_logs",
    """SELECT PatternId, min(PatternTemplate) AS Template, count(*) AS Count,
    count(*) FILTER (SeverityNumber >= 17) AS ErrorCount, min(Timestamp) AS FirstSeen, max(Timestamp) AS LastSeen
    FROM pattern_logs WHERE PatternId<>'' GROUP BY 1 ORDER BY Count DESC, PatternId LIMIT 200""",
)
register(
    "e5_active_services",
    lambda spark, d: ops.active_services(t.logs(spark, d), "2024-01-15 00:00:00", 3600),
    "logs",
    """SELECT ServiceName, max(Timestamp) AS LastSeen FROM logs WHERE ServiceName<>''
    AND Timestamp >= TIMESTAMP '2024-01-14 23:00:00' GROUP BY 1""",
)
register(
    "e6_numeric_attribute_keys",
    lambda spark, d: ops.numeric_attribute_keys(t.logs(spark, d)),
    "logs",
    f"""SELECT e.key AS Key, count(*) AS NumericCount FROM (SELECT unnest(map_entries(LogAttributes)) AS e FROM logs)
    WHERE {NUMERIC.format('e.value')} GROUP BY 1""",
)
register(
    "e7_value_sample",
    lambda spark, d: ops.value_sample(t.logs(spark, d), "value", seed=7),
    "logs",
    f"""SELECT Timestamp, CAST(LogAttributes['value'] AS DOUBLE) AS Value FROM logs
    WHERE {NUMERIC.format("LogAttributes['value']")} ORDER BY md5(concat(EventId, '#7')), EventId LIMIT 4000""",
)


def _heatmap_sql(log_scale):
    keep = "Value > 0" if log_scale else "true"
    f = "ln({0})" if log_scale else "{0}"
    return f"""+p AS (SELECT Timestamp, CAST(LogAttributes['value'] AS DOUBLE) AS Value FROM logs
      WHERE {NUMERIC.format("LogAttributes['value']")}),
    q AS (SELECT * FROM p WHERE {keep}), r AS (SELECT min(Value) AS a, max(Value) AS b FROM q),
    s AS (SELECT {f.format('CASE WHEN a=b THEN a-1 ELSE a END')} AS lo, {f.format('CASE WHEN a=b THEN b+1 ELSE b END')} AS hi FROM r)
    SELECT CAST(least(29, greatest(0, floor(epoch_us(Timestamp - TIMESTAMP '2024-01-01') / 86400000000.0))) AS INT) AS TimeIndex,
    CAST(least(23, greatest(0, floor(({f.format('Value')} - lo)/(hi - lo)*24))) AS INT) AS ValueIndex, count(*) AS Count
    FROM q, s GROUP BY 1,2"""


register(
    "e8_value_heatmap",
    lambda spark, d: ops.value_heatmap(ops.numeric_values(t.logs(spark, d), "value"), "2024-01-01", "2024-01-31", 86_400),
    "logs", _heatmap_sql(False),
)
register(
    "e8_value_heatmap_log",
    lambda spark, d: ops.value_heatmap(
        ops.numeric_values(t.logs(spark, d), "value"), "2024-01-01", "2024-01-31", 86_400, log_scale=True
    ),
    "logs", _heatmap_sql(True),
)
register(
    "e21_known_services",
    lambda spark, d: ops.known_services(t.logs(spark, d)),
    "logs", "SELECT DISTINCT ServiceName FROM logs WHERE ServiceName<>''",
)
