"""Registered queries over sources, sinks and stored tables.

Export requests and scrape texts are derived from the supplied events, eight events each,
and read back through the sources; the oracles state the rows directly.
"""

from pyspark.sql import Window, functions as F

from beaconry.catalog import tables as t
from beaconry.catalog.tables import oracle
from beaconry.functions.times import epoch_us
from beaconry.plans.lineage import scratch_path
from beaconry.sources import otlp, prometheus, tables as stored

QUERIES, ORACLES = {}, {}


def register(name, build, tables=None, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = oracle(tables, sql)


def _nano(column):
    return (epoch_us(F.col(column)) * 1000).cast("string")


def _attributes(*pairs):
    """Attribute list whose values have different types: unset fields are left out of the JSON."""
    kinds = {"stringValue": "string", "intValue": "string", "doubleValue": "double", "boolValue": "boolean"}
    fields = lambda kind, column: F.struct(*[
        (column if k == kind else F.lit(None)).cast(kinds[k]).alias(k) for k in kinds
    ])
    return F.array(*[F.struct(F.lit(key).alias("key"), fields(kind, column).alias("value")) for key, kind, column in pairs])


def log_requests(events):
    """OTLP/JSON log export requests: one resource per event, eight events per request."""
    row = t.logs_of(events).withColumn("value", F.col("LogAttributes")["value"].cast("double"))
    record = F.struct(
        _nano("Timestamp").alias("timeUnixNano"), F.col("SeverityNumber").alias("severityNumber"),
        F.col("SeverityText").alias("severityText"), F.struct(F.col("Body").alias("stringValue")).alias("body"),
        F.upper("TraceId").alias("traceId"), F.col("SpanId").alias("spanId"),
        _attributes(("event_type", "stringValue", F.col("LogAttributes")["event_type"]),
                    ("k", "intValue", F.col("LogAttributes")["k"]), ("value", "doubleValue", F.col("value"))).alias("attributes"),
    )
    resource = F.struct(
        F.struct(_attributes(("service.name", "stringValue", F.col("ServiceName"))).alias("attributes")).alias("resource"),
        F.array(F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), F.array(record).alias("logRecords"))).alias("scopeLogs"),
    )
    return row.groupBy("TraceId").agg(F.collect_list(resource).alias("resourceLogs")).select(
        F.to_json(F.struct("resourceLogs")).alias("value")
    )


FLAT = ["Timestamp", "TraceId", "SpanId", "SeverityNumber", "SeverityText", "ServiceName", "Body"]
FLAT_SQL = ", ".join(FLAT)
DOUBLE_TEXT = "regexp_replace(LogAttributes['value'], '\\.0$', '')"
register(
    "s1_otlp_logs",
    lambda spark, d: otlp.otlp_logs(log_requests(t.read(spark, d, "events"))).select(
        *FLAT, F.col("LogAttributes")["event_type"].alias("EventType"), F.col("LogAttributes")["k"].alias("K"),
        F.col("LogAttributes")["value"].alias("Value"), "ScopeName"),
    "logs",
    f"""SELECT {FLAT_SQL}, LogAttributes['event_type'] AS EventType, LogAttributes['k'] AS K, {DOUBLE_TEXT} AS Value,
    'lib' AS ScopeName FROM logs""",
)


def span_requests(spark, d):
    span = F.struct(
        F.col("TraceId").alias("traceId"), F.col("SpanId").alias("spanId"), F.col("ParentSpanId").alias("parentSpanId"),
        F.col("Name").alias("name"), F.col("Kind").alias("kind"), _nano("StartTime").alias("startTimeUnixNano"),
        (epoch_us(F.col("StartTime")) * 1000 + F.col("DurationNano")).cast("string").alias("endTimeUnixNano"),
        F.struct(F.col("StatusCode").alias("code")).alias("status"),
        F.array(F.struct(_nano("StartTime").alias("timeUnixNano"), F.col("Name").alias("name"))).alias("events"),
        _attributes(("peer.service", "stringValue", F.col("SpanAttributes")["peer.service"])).alias("attributes"),
    )
    resource = F.struct(
        F.struct(_attributes(("service.name", "stringValue", F.col("ServiceName"))).alias("attributes")).alias("resource"),
        F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"),
    )
    return t.spans(spark, d).groupBy("TraceId").agg(F.collect_list(resource).alias("resourceSpans")).select(
        F.to_json(F.struct("resourceSpans")).alias("value")
    )


register(
    "s2_otlp_spans",
    lambda spark, d: otlp.otlp_spans(span_requests(spark, d)).select(
        "TraceId", "SpanId", "ParentSpanId", "Name", "Kind", "StatusCode", "ServiceName", "StartTime", "EndTime", "DurationNano",
        F.col("SpanAttributes")["peer.service"].alias("Peer"), F.element_at("Events", 1)["Timestamp"].alias("EventTime"),
        F.element_at("Events", 1)["Name"].alias("EventName")),
    "spans",
    """SELECT TraceId, SpanId, ParentSpanId, Name, Kind, StatusCode, ServiceName, StartTime, EndTime, DurationNano,
    SpanAttributes['peer.service'] AS Peer, StartTime AS EventTime, Name AS EventName FROM spans""",
)


def metric_requests(spark, d):
    """One request per event: a gauge, a sum, a histogram, and a summary for signups."""
    row = t.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    point = lambda **m: F.array(F.struct(
        _nano("ts").alias("timeUnixNano"),
        _attributes(("event_type", "stringValue", F.col("event_type")), ("id", "intValue", F.col("event_id"))).alias("attributes"),
        *[c.alias(n) for n, c in m.items()]))
    one = lambda c: F.when(c, "1").otherwise("0")
    v = F.col("value")
    metrics = [
        ("app.value", "gauge", F.struct(point(asDouble=v).alias("dataPoints"))),
        ("app.k", "sum", F.struct(point(asInt=F.col("k")).alias("dataPoints"), F.lit(1).alias("aggregationTemporality"), F.lit(True).alias("isMonotonic"))),
        ("app.dist", "histogram", F.struct(point(
            count=F.lit("1"), sum=v, bucketCounts=F.array(one(v <= 10), one((v > 10) & (v <= 50)), one(v > 50)),
            explicitBounds=F.array(F.lit(10.0), F.lit(50.0))).alias("dataPoints"), F.lit(2).alias("aggregationTemporality"))),
        ("app.summary", "summary", F.when(F.col("event_type") == "signup", F.struct(F.array().alias("dataPoints")))),
    ]
    text = F.concat(F.lit("["), F.concat_ws(",", *[
        F.when(body.isNotNull(), F.to_json(F.struct(F.lit(name).alias("name"), body.alias(kind)))) for name, kind, body in metrics
    ]), F.lit("]"))
    return row.select(F.concat(
        F.lit('{"resourceMetrics":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"svc-'), (F.col("user_id") % 10).cast("string"),
        F.lit('"}}]},"scopeMetrics":[{"metrics":'), text, F.lit("}]}]}"),
    ).alias("value"))


POINT_SQL = "concat('svc-', user_id % 10) AS ServiceName, event_type AS EventType, CAST(event_id AS VARCHAR) AS Id, ts AS Time"


def _point(df, *more):
    return df.select("MetricName", "ServiceName", F.col("DataPointAttributes")["event_type"].alias("EventType"),
                     F.col("DataPointAttributes")["id"].alias("Id"), "Time", *more)


register("s3_otlp_gauge", lambda spark, d: _point(otlp.otlp_metrics(metric_requests(spark, d)).gauge, "Value"),
         "", f"SELECT 'app.value' AS MetricName, {POINT_SQL}, value AS Value FROM events")
register("s3_otlp_sum", lambda spark, d: _point(otlp.otlp_metrics(metric_requests(spark, d)).sum, "Value", "AggregationTemporality", "IsMonotonic"),
         "", f"""SELECT 'app.k' AS MetricName, {POINT_SQL}, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS Value,
         'AGGREGATION_TEMPORALITY_DELTA' AS AggregationTemporality, true AS IsMonotonic FROM events""")
TEXT = lambda c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",")
register("s3_otlp_histogram", lambda spark, d: _point(
    otlp.otlp_metrics(metric_requests(spark, d)).histogram, "Count", "Sum", TEXT("BucketCounts").alias("Counts"), TEXT("ExplicitBounds").alias("Bounds")),
    "", f"""SELECT 'app.dist' AS MetricName, {POINT_SQL}, CAST(1 AS BIGINT) AS Count, value AS Sum, CASE WHEN value<=10 THEN '1,0,0'
    WHEN value<=50 THEN '0,1,0' ELSE '0,0,1' END AS Counts, '10,50' AS Bounds FROM events""")
register("s3_otlp_unsupported", lambda spark, d: otlp.otlp_metrics(metric_requests(spark, d)).unsupported,
         "", "SELECT 'app.summary' AS MetricName FROM events WHERE event_type='signup' LIMIT 1")


def _flattened(spark, d):
    """Typed values of all kinds; lists within lists as many as the id says, up to twelve."""
    levels = (F.col("event_id") % 13).cast("int")
    text = F.format_string(
        '[{"key":"arr","value":{"arrayValue":{"values":[{"intValue":"%s"},{"stringValue":"%s"},{}]}}},'
        '{"key":"kv","value":{"kvlistValue":{"values":[{"key":"v","value":{"doubleValue":%s}},{"key":"in","value":{"arrayValue":{"values":[{"boolValue":true}]}}}]}}},'
        '{"key":"deep","value":%s{"kvlistValue":{"values":[{"key":"id","value":{"intValue":"%s"}}]}}%s},'
        '{"key":"dup","value":{"stringValue":"first"}},{"key":"dup","value":{"stringValue":"%s"}},{"key":"none","value":{}}]',
        F.col("event_id").cast("string"), F.col("event_type"), F.col("value").cast("string"),
        F.repeat(F.lit('{"arrayValue":{"values":['), levels), F.col("event_id").cast("string"), F.repeat(F.lit("]}}"), levels), F.col("user_id").cast("string"))
    return t.read(spark, d, "events").select("event_id", F.from_json(text, otlp.ATTRIBUTE_LIST).alias("a")).select(
        "event_id", otlp.flatten_attributes("a").alias("m"))


register(
    "s4_flatten_attributes",
    lambda spark, d: _flattened(spark, d).select(
        "event_id", *[F.col("m")[k].alias(k) for k in ("arr", "kv", "deep", "dup")], F.size("m").alias("keys")),
    "", r"""SELECT event_id, concat('[', event_id, ',', event_type, ',]') AS arr,
    concat('{v=', regexp_replace(CAST(value AS VARCHAR), '\.0$', ''), ',in=[true]}') AS kv,
    concat(repeat('[', event_id % 13), '{id=', event_id, '}', repeat(']', event_id % 13)) AS deep, CAST(user_id AS VARCHAR) AS dup, 4 AS keys FROM events""",
)


def scrapes(spark, d):
    """Scrape texts of eight events each, with comments, blanks and malformed lines in between."""
    row = t.read(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    s, v = lambda c: F.col(c).cast("string"), F.col("value")
    label = lambda *more: F.concat(F.lit('{id="'), s("event_id"), F.lit('"'), *more, F.lit("}"))
    le = lambda bound, hit: F.concat(F.lit("lat_bucket"), label(F.lit(f',le="{bound}"')), F.lit(" "), F.when(hit, "1").otherwise("0"))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("app_value"), label(F.lit(',t="a\\"b\\\\",type="'), F.col("event_type"), F.lit('"')), F.lit(" "), s("value"), F.lit(" "),
                 F.floor(epoch_us(F.col("ts")) / 1000).cast("string")),
        F.concat(F.lit("app_hits"), label(), F.lit(" "), F.col("k")), F.concat(F.lit("free{broken "), s("event_id")),
        F.concat(F.lit("plain "), s("event_id")),
        le("50", v <= 50), le("10", v <= 10), le("+Inf", F.lit(True)),
        F.concat(F.lit("lat_sum"), label(), F.lit(" "), s("value")), F.concat(F.lit("lat_count"), label(), F.lit(" 1")),
        F.concat(F.lit('rpc{quantile="0.5"} '), s("value")), F.lit("rpc_count 3"),
    )
    head = ("# HELP app_value Value\\nper event\n# TYPE app_value gauge\n# TYPE app_hits counter\n# TYPE lat histogram\n"
            "# TYPE rpc summary\n\n# a comment\n")
    return row.groupBy(F.call_function("div", F.col("event_id"), F.lit(8)).alias("ScrapeId")).agg(
        F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(lines)), "\n")).alias("Body"), F.min("ts").alias("ScrapeTime"),
    ).select("ScrapeId", F.lit("shop").alias("Job"), F.lit("https://target.example:8443/metrics").alias("Url"),
             F.create_map(F.lit("zone"), F.lit("z1")).alias("TargetLabels"), "ScrapeTime", "Body")


MS = "date_trunc('millisecond', ts)"
AT = "(SELECT event_id // 8 AS g, min(ts) AS t0 FROM events GROUP BY 1) a"
register(
    "s5_prometheus_samples",
    lambda spark, d: prometheus.prometheus_samples(scrapes(spark, d)).select(
        "ScrapeId", "Name", F.col("Labels")["id"].alias("Id"), F.col("Labels")["t"].alias("T"), F.col("Labels")["le"].alias("Le"),
        F.col("Labels")["quantile"].alias("Quantile"), "Value", "TimestampMs", "Type", "Help", "Family", "FamilyType"),
    "", f"""WITH e AS (SELECT *, event_id // 8 AS g, CAST(event_id AS VARCHAR) AS id FROM events)
    SELECT g AS ScrapeId, 'app_value' AS Name, id AS Id, 'a"b\\' AS T, NULL AS Le, NULL AS Quantile, value AS Value,
    epoch_ms({MS}) AS TimestampMs, 'gauge' AS Type, 'Value' || chr(10) || 'per event' AS Help, 'app_value' AS Family, 'gauge' AS FamilyType FROM e
    UNION ALL SELECT g, 'app_hits', id, NULL, NULL, NULL, CAST(json_extract_string(props,'$.k') AS DOUBLE), NULL, 'counter', NULL, 'app_hits', 'counter' FROM e
    UNION ALL SELECT g, 'plain', NULL, NULL, NULL, NULL, event_id, NULL, 'untyped', NULL, 'plain', NULL FROM e
    UNION ALL SELECT g, 'lat_bucket', id, NULL, le, NULL, CASE WHEN value <= bound THEN 1 ELSE 0 END, NULL, 'untyped', NULL, 'lat', 'histogram'
      FROM e, (VALUES ('10', 10.0::DOUBLE), ('50', 50.0::DOUBLE), ('+Inf', 'inf'::DOUBLE)) b(le, bound)
    UNION ALL SELECT g, 'lat_sum', id, NULL, NULL, NULL, value, NULL, 'untyped', NULL, 'lat', 'histogram' FROM e
    UNION ALL SELECT g, 'lat_count', id, NULL, NULL, NULL, 1, NULL, 'untyped', NULL, 'lat', 'histogram' FROM e
    UNION ALL SELECT g, 'rpc', NULL, NULL, NULL, '0.5', value, NULL, 'summary', NULL, 'rpc', 'summary' FROM e
    UNION ALL SELECT g, 'rpc_count', NULL, NULL, NULL, NULL, 3, NULL, 'untyped', NULL, 'rpc', 'summary' FROM e""",
)
RESOURCE = """'shop' AS ServiceName, 'target.example:8443' AS Instance, 'z1' AS Zone"""


def _prometheus(df, *more):
    r = F.col("ResourceAttributes")
    return df.select("MetricName", "ServiceName", r["service.instance.id"].alias("Instance"), r["zone"].alias("Zone"), "Time",
                     F.col("DataPointAttributes")["id"].alias("Id"), *more)


register("s6_prometheus_gauges", lambda spark, d: _prometheus(prometheus.prometheus_points(scrapes(spark, d)).gauge, "Value"), "",
         f"""SELECT 'app_value' AS MetricName, {RESOURCE}, {MS} AS Time, CAST(event_id AS VARCHAR) AS Id, value AS Value FROM events
         UNION ALL SELECT 'plain', {RESOURCE}, t0, NULL, event_id FROM events JOIN {AT} ON g = event_id // 8""")
register("s6_prometheus_sums", lambda spark, d: _prometheus(
    prometheus.prometheus_points(scrapes(spark, d)).sum, "Value", "AggregationTemporality", "IsMonotonic"), "",
    f"""SELECT 'app_hits' AS MetricName, {RESOURCE}, t0 AS Time, CAST(event_id AS VARCHAR) AS Id, CAST(json_extract_string(props,'$.k') AS DOUBLE) AS Value,
    'AGGREGATION_TEMPORALITY_CUMULATIVE' AS AggregationTemporality, true AS IsMonotonic FROM events JOIN {AT} ON g = event_id // 8""")
register("s6_prometheus_unsupported", lambda spark, d: prometheus.prometheus_points(scrapes(spark, d)).unsupported, "",
         "SELECT 'rpc' AS MetricName FROM events LIMIT 1")
register("s7_prometheus_histograms", lambda spark, d: _prometheus(
    prometheus.prometheus_histograms(prometheus.prometheus_samples(scrapes(spark, d))), "Count", "Sum",
    TEXT("BucketCounts").alias("Counts"), TEXT("ExplicitBounds").alias("Bounds")), "",
    f"""SELECT 'lat' AS MetricName, {RESOURCE}, t0 AS Time, CAST(event_id AS VARCHAR) AS Id, CAST(1 AS BIGINT) AS Count, value AS Sum,
    CASE WHEN value<=10 THEN '1,0,0' WHEN value<=50 THEN '0,1,0' ELSE '0,0,1' END AS Counts, '10,50' AS Bounds FROM events JOIN {AT} ON g = event_id // 8""")

register(
    "s8_normalize_logs",
    lambda spark, d: otlp.normalize_rows(
        t.logs(spark, d).withColumns({
            "ServiceName": F.nullif(F.col("ServiceName"), F.lit("svc-3")), "ObservedTimestamp": F.lit(None).cast("timestamp_ntz"),
            "SeverityNumber": F.nullif(F.col("SeverityNumber"), F.lit(9))}), "logs",
    ).select("EventId", "Timestamp", "ObservedTimestamp", "ServiceName", "SeverityNumber", "ScopeName", "PatternId", F.size("ScopeAttributes").alias("n")),
    "logs",
    """SELECT CAST(EventId AS VARCHAR) AS EventId, Timestamp, Timestamp AS ObservedTimestamp, CASE WHEN ServiceName='svc-3' THEN '' ELSE ServiceName END AS ServiceName,
    CASE WHEN SeverityNumber=9 THEN 0 ELSE SeverityNumber END AS SeverityNumber, '' AS ScopeName, '' AS PatternId, 0 AS n FROM logs""",
)
register(
    "s8_normalize_spans",
    lambda spark, d: otlp.normalize_rows(t.spans(spark, d).withColumn("StatusCode", F.col("Kind") - 1), "spans")
    .select("SpanId", "StatusCode", "TraceState", "EndTime"),
    "spans",
    """SELECT SpanId, CASE Kind WHEN 2 THEN 'STATUS_CODE_OK' WHEN 3 THEN 'STATUS_CODE_ERROR' ELSE 'STATUS_CODE_UNSET' END AS StatusCode,
    '' AS TraceState, EndTime FROM spans""",
)


def _gaps(df, service, *columns):
    """NULL in some columns of one service's rows."""
    return df.withColumns({c: F.when(F.col("ServiceName") != service, F.col(c)) for c in columns})


NO_SCOPE = "ServiceName, Time AS StartTime, Time, '' AS ScopeName, 0 AS n"
bare = lambda: ["ServiceName", "StartTime", "Time", "ScopeName", F.size("ResourceAttributes").alias("n")]
register(
    "s8_normalize_gauges",
    lambda spark, d: otlp.normalize_rows(_gaps(t.gauge(spark, d), "svc-3", "MetricName", "Unit", "Value", "DataPointAttributes"), "metrics_gauge")
    .select("MetricName", *bare(), "Unit", "Value", F.coalesce(F.col("DataPointAttributes")["region"], F.lit("none")).alias("Region")),
    "gauge",
    f"""SELECT CASE WHEN ServiceName='svc-3' THEN '' ELSE MetricName END AS MetricName, {NO_SCOPE}, CASE WHEN ServiceName='svc-3' THEN '' ELSE Unit END AS Unit,
    CASE WHEN ServiceName='svc-3' THEN 0 ELSE Value END AS Value, CASE WHEN ServiceName='svc-3' THEN 'none' ELSE DataPointAttributes['region'] END AS Region FROM gauge""",
)
register(
    "s8_normalize_sums",
    lambda spark, d: otlp.normalize_rows(
        _gaps(t.sums(spark, d), "svc-5", "IsMonotonic").withColumn("AggregationTemporality", F.right("ServiceName", F.lit(1)).cast("int") % 4), "metrics_sum",
    ).select("MetricName", *bare(), "Value", "AggregationTemporality", "IsMonotonic"),
    "sums",
    f"""SELECT MetricName, {NO_SCOPE}, Value, CASE CAST(right(ServiceName, 1) AS INT) % 4 WHEN 1 THEN 'AGGREGATION_TEMPORALITY_DELTA'
    WHEN 2 THEN 'AGGREGATION_TEMPORALITY_CUMULATIVE' ELSE 'AGGREGATION_TEMPORALITY_UNSPECIFIED' END AS AggregationTemporality, ServiceName <> 'svc-5' AS IsMonotonic FROM sums""",
)
register(
    "s8_normalize_histograms",
    lambda spark, d: otlp.normalize_rows(_gaps(t.histogram(spark, d), "svc-2", "Count", "Sum", "BucketCounts", "ExplicitBounds"), "metrics_histogram")
    .select("MetricName", *bare(), "AggregationTemporality", "Count", "Sum", TEXT("BucketCounts").alias("Counts"), F.size("ExplicitBounds").alias("Bounds")),
    "histogram",
    f"""SELECT MetricName, {NO_SCOPE}, 'AGGREGATION_TEMPORALITY_UNSPECIFIED' AS AggregationTemporality, CASE WHEN ServiceName='svc-2' THEN 0 ELSE Count END AS Count,
    CASE WHEN ServiceName='svc-2' THEN 0 ELSE Sum END AS Sum, CASE WHEN ServiceName='svc-2' THEN '' ELSE array_to_string(BucketCounts, ',') END AS Counts,
    CASE WHEN ServiceName='svc-2' THEN 0 ELSE 4 END AS Bounds FROM histogram""",
)


def _mixed(spark, d):
    """Requests of error events arrive cut short."""
    rows = metric_requests(spark, d)
    return rows.withColumn("value", F.when(F.col("value").contains('"error"'), F.substr("value", F.lit(1), F.length("value") - 4)).otherwise(F.col("value")))


register(
    "s10_quarantine",
    lambda spark, d: otlp.quarantine(_mixed(spark, d), "metrics")[0].agg(F.count(F.lit(1)).alias("n")).select(F.lit("good").alias("Kind"), "n")
    .unionByName(otlp.quarantine(_mixed(spark, d), "metrics")[1].agg(F.count(F.lit(1)).alias("n")).select(F.lit("bad").alias("Kind"), "n")),
    "", """SELECT 'good' AS Kind, count(*) FILTER (event_type<>'error') AS n FROM events UNION ALL
    SELECT 'bad', count(*) FILTER (event_type='error') FROM events""",
)


def _stored(spark, d, kind, df):
    path = scratch_path(spark, f"table-{kind}")
    stored.write_telemetry(otlp.normalize_rows(df, kind), path, kind)
    return path


register(
    "s11_read_logs",
    lambda spark, d: stored.read_logs(spark, _stored(spark, d, "logs", t.logs(spark, d))).where(F.col("month") == "2024-01")
    .select("EventId", "Timestamp", "ServiceName", "Body", F.col("LogAttributes")["k"].alias("K"), "month"),
    "logs", """SELECT CAST(EventId AS VARCHAR) AS EventId, Timestamp, ServiceName, Body, LogAttributes['k'] AS K, '2024-01' AS month FROM logs
    WHERE Timestamp >= TIMESTAMP '2024-01-01' AND Timestamp < TIMESTAMP '2024-02-01'""",
)
register(
    "s11_read_spans",
    lambda spark, d: stored.read_spans(spark, _stored(spark, d, "spans", t.spans(spark, d))).select("TraceId", "SpanId", "StartTime", "DurationNano", "month"),
    "spans", "SELECT TraceId, SpanId, StartTime, DurationNano, strftime(StartTime, '%Y-%m') AS month FROM spans",
)
register(
    "s11_read_gauges",
    lambda spark, d: stored.read_gauges(spark, _stored(spark, d, "metrics_gauge", t.gauge(spark, d))).select("MetricName", "Time", "StartTime", "Value"),
    "gauge", "SELECT MetricName, Time, Time AS StartTime, Value FROM gauge",
)
register(
    "s11_read_sums",
    lambda spark, d: stored.read_sums(spark, _stored(spark, d, "metrics_sum", t.sums(spark, d))).select("ServiceName", "Time", "Value", "AggregationTemporality", "IsMonotonic"),
    "sums", "SELECT ServiceName, Time, Value, AggregationTemporality, IsMonotonic FROM sums",
)
register(
    "s11_read_histograms",
    lambda spark, d: stored.read_histograms(spark, _stored(spark, d, "metrics_histogram", t.histogram(spark, d)))
    .select("ServiceName", "Time", "Count", "Sum", TEXT("BucketCounts").alias("Counts")),
    "histogram", "SELECT ServiceName, Time, Count, Sum, array_to_string(BucketCounts, ',') AS Counts FROM histogram",
)
register(
    "s12_write_telemetry",
    lambda spark, d: spark.read.parquet(_stored(spark, d, "logs", t.logs(spark, d)))
    .groupBy("month", F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n")).groupBy("month").agg(F.sum("n").alias("Rows")),
    "logs", "SELECT strftime(Timestamp, '%Y-%m') AS month, count(*) AS Rows FROM logs GROUP BY 1",
)


def _layout(spark, d):
    """Per month: rows, rows out of order in their file, files that begin before an earlier one ends."""
    path = scratch_path(spark, "table-layout")
    stored.write_telemetry(otlp.normalize_rows(t.logs(spark, d), "logs"), path, "logs", rows_per_task=5000)
    key = F.struct(*stored.LAYOUT["logs"][1]).alias("key")
    rows = spark.read.parquet(path).select("month", key, F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    before = F.lag("key").over(Window.partitionBy("f").orderBy("i"))
    files = rows.withColumn("off", (before > F.col("key")).cast("int")).groupBy("month", "f").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("off"), F.lit(0)).alias("off"), F.min("key").alias("first"), F.max("key").alias("last"))
    overlaps = F.lag("last").over(Window.partitionBy("month").orderBy("first")) > F.col("first")
    return files.withColumn("over", overlaps.cast("int")).groupBy("month").agg(
        F.sum("n").alias("Rows"), F.sum("off").alias("OutOfOrder"), F.coalesce(F.sum("over"), F.lit(0)).alias("Overlapping"))


register(
    "s12_layout", _layout, "logs",
    """SELECT strftime(Timestamp, '%Y-%m') AS month, count(*) AS Rows, CAST(0 AS BIGINT) AS OutOfOrder, CAST(0 AS BIGINT) AS Overlapping
    FROM logs GROUP BY 1""",
)
register(
    "s13_export_logs",
    lambda spark, d: stored.export_logs(t.logs(spark, d)),
    "logs",
    """SELECT EventId, Timestamp, SeverityText AS Severity, SeverityNumber, ServiceName AS Service, '' AS EventName, Body AS Message,
    TraceId, SpanId, CAST(to_json(LogAttributes) AS VARCHAR) AS LogAttributesJson FROM logs""",
)


def _written_export(spark, d):
    """The JSON export, written and read back."""
    path = scratch_path(spark, "export")
    stored.write_export(stored.export_logs(t.logs(spark, d)), path, "json")
    schema = ("eventId string, timestamp timestamp_ntz, severity string, severityNumber int, service string, eventName string, message string, "
              "traceId string, spanId string, logAttributes map<string,string>")
    return spark.read.schema(schema).json(path)


register(
    "s13_write_export_json",
    lambda spark, d: _written_export(spark, d).withColumn("logAttributes", F.to_json("logAttributes")),
    "logs",
    """SELECT CAST(EventId AS VARCHAR) AS "eventId", Timestamp AS "timestamp", SeverityText AS "severity", SeverityNumber AS "severityNumber", ServiceName AS "service",
    '' AS "eventName", Body AS "message", TraceId AS "traceId", SpanId AS "spanId", CAST(to_json(LogAttributes) AS VARCHAR) AS "logAttributes" FROM logs""",
)
