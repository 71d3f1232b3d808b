"""Telemetry-shaped tables derived from the supplied Parquet files.

Each table has a Spark form and the DuckDB text that rebuilds the same rows for the
oracle. Window frames in the Spark forms are split so that no key needs one task.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from beaconry.plans.ordered import running_total

NOW = "2024-01-31 00:00:00"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _events(spark, sf_dir):
    return read(spark, sf_dir, "events")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs_of(_events(spark, sf_dir))


def logs_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS EventId", "ts AS Timestamp", "ts AS ObservedTimestamp",
        "md5(CAST(event_id DIV 8 AS STRING)) AS TraceId",
        "substr(md5(CAST(event_id AS STRING)),1,16) AS SpanId",
        "CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 WHEN 'view' THEN 5 ELSE 9 END AS SeverityNumber",
        "CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' WHEN 'view' THEN 'Debug' ELSE 'Information' END AS SeverityText",
        "concat('svc-', user_id % 10) AS ServiceName",
        "concat(event_type,' by user ',user_id,' took ',CAST(value AS STRING),'ms k=',get_json_object(props,'$.k')) AS Body",
        "map('service.name',concat('svc-', user_id % 10),'host.name',concat('host-', user_id % 20)) AS ResourceAttributes",
        "map('event_type',event_type,'k',get_json_object(props,'$.k'),'value',CAST(value AS STRING)) AS LogAttributes",
    )


LOGS_SQL = """
SELECT event_id AS EventId, ts AS Timestamp, ts AS ObservedTimestamp,
  md5(CAST(event_id // 8 AS VARCHAR)) AS TraceId,
  substr(md5(CAST(event_id AS VARCHAR)),1,16) AS SpanId,
  CASE event_type WHEN 'error' THEN 17 WHEN 'signup' THEN 13 WHEN 'view' THEN 5 ELSE 9 END AS SeverityNumber,
  CASE event_type WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Warning' WHEN 'view' THEN 'Debug' ELSE 'Information' END AS SeverityText,
  concat('svc-', user_id % 10) AS ServiceName,
  concat(event_type,' by user ',user_id,' took ',CAST(value AS VARCHAR),'ms k=',json_extract_string(props,'$.k')) AS Body,
  MAP {'service.name': concat('svc-', user_id % 10), 'host.name': concat('host-', user_id % 20)} AS ResourceAttributes,
  MAP {'event_type': event_type, 'k': json_extract_string(props,'$.k'), 'value': CAST(value AS VARCHAR)} AS LogAttributes
FROM events"""


def pattern_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs carrying a template per event type (empty for 'purchase' rows)."""
    template = F.concat(F.col("LogAttributes")["event_type"], F.lit(" by user <*> took <*>ms k=<*>"))
    df = logs(spark, sf_dir).withColumn(
        "PatternTemplate", F.when(F.col("LogAttributes")["event_type"] == "purchase", "").otherwise(template)
    )
    return df.withColumn(
        "PatternId",
        F.when(F.col("PatternTemplate") == "", "").otherwise(F.substring(F.sha2("PatternTemplate", 256), 1, 16)),
    )


PATTERN_LOGS_SQL = """
SELECT *, CASE WHEN PatternTemplate='' THEN '' ELSE substr(sha256(PatternTemplate),1,16) END AS PatternId FROM (
  SELECT *, CASE WHEN LogAttributes['event_type']='purchase' THEN ''
    ELSE concat(LogAttributes['event_type'],' by user <*> took <*>ms k=<*>') END AS PatternTemplate FROM logs) t"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Partitioned by TraceId itself (8 rows each), so later per-trace work needs no shuffle.
    return _events(spark, sf_dir).selectExpr(
        "md5(CAST(event_id DIV 8 AS STRING)) AS TraceId",
        "substr(md5(CAST(event_id AS STRING)),1,16) AS SpanId",
        "CASE WHEN event_id % 8 = 0 THEN '' ELSE substr(md5(CAST((event_id DIV 8)*8 + ((event_id % 8)-1) DIV 2 AS STRING)),1,16) END AS ParentSpanId",
        "event_type AS Name", "CAST(event_id % 6 AS INT) AS Kind",
        "CASE event_type WHEN 'error' THEN 'STATUS_CODE_ERROR' WHEN 'view' THEN 'STATUS_CODE_UNSET' ELSE 'STATUS_CODE_OK' END AS StatusCode",
        "concat('svc-', user_id % 10) AS ServiceName",
        "event_id", "ts",
        "CAST(round(value*1000) AS BIGINT)*1000 AS DurationNano",
        "CASE WHEN event_id % 7 = 0 THEN map('peer.service','ext-db') ELSE map('db.system','') END AS SpanAttributes",
    ).selectExpr(
        "TraceId", "SpanId", "ParentSpanId", "Name", "Kind", "StatusCode", "ServiceName",
        "min(ts) OVER (PARTITION BY TraceId) + make_dt_interval(0,0,0,(event_id % 8)*0.02) AS StartTime",
        "DurationNano", "SpanAttributes",
    ).selectExpr("*", "timestampadd(MICROSECOND, DurationNano DIV 1000, StartTime) AS EndTime")


SPANS_SQL = """
SELECT *, StartTime + to_microseconds(DurationNano // 1000) AS EndTime FROM (
SELECT md5(CAST(event_id // 8 AS VARCHAR)) AS TraceId,
  substr(md5(CAST(event_id AS VARCHAR)),1,16) AS SpanId,
  CASE WHEN event_id % 8 = 0 THEN '' ELSE substr(md5(CAST((event_id // 8)*8 + ((event_id % 8)-1) // 2 AS VARCHAR)),1,16) END AS ParentSpanId,
  event_type AS Name, CAST(event_id % 6 AS INT) AS Kind,
  CASE event_type WHEN 'error' THEN 'STATUS_CODE_ERROR' WHEN 'view' THEN 'STATUS_CODE_UNSET' ELSE 'STATUS_CODE_OK' END AS StatusCode,
  concat('svc-', user_id % 10) AS ServiceName,
  min(ts) OVER (PARTITION BY event_id // 8) + to_milliseconds((event_id % 8)*20) AS StartTime,
  CAST(round(value*1000) AS BIGINT)*1000 AS DurationNano,
  CASE WHEN event_id % 7 = 0 THEN MAP {'peer.service': 'ext-db'} ELSE MAP {'db.system': ''} END AS SpanAttributes
FROM events) s"""


def gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "concat('app.', event_type) AS MetricName", "'' AS Description", "'ms' AS Unit",
        "concat('svc-', user_id % 10) AS ServiceName",
        "map('region',CAST(user_id % 3 AS STRING),'k10',CAST(CAST(get_json_object(props,'$.k') AS BIGINT) % 10 AS STRING)) AS DataPointAttributes",
        "ts AS Time", "value AS Value",
    )


GAUGE_SQL = """
SELECT concat('app.', event_type) AS MetricName, '' AS Description, 'ms' AS Unit, concat('svc-', user_id % 10) AS ServiceName,
  MAP {'region': CAST(user_id % 3 AS VARCHAR), 'k10': CAST(CAST(json_extract_string(props,'$.k') AS BIGINT) % 10 AS VARCHAR)} AS DataPointAttributes,
  ts AS Time, value AS Value FROM events"""


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = _events(spark, sf_dir).selectExpr(
        "event_id", "ts", "event_type", "user_id % 10 AS s", "CAST(round(value*100) AS BIGINT) AS c"
    )
    total = running_total(cents, ["s", "event_type"], ["ts", "event_id"], "c", "total")
    return total.selectExpr(
        "'app.total' AS MetricName", "'' AS Description", "'1' AS Unit", "concat('svc-', s) AS ServiceName",
        "map('event_type',event_type) AS DataPointAttributes", "ts AS Time", "CAST(total AS DOUBLE) AS Value",
        "'AGGREGATION_TEMPORALITY_CUMULATIVE' AS AggregationTemporality", "true AS IsMonotonic",
    )


SUM_SQL = """
SELECT 'app.total' AS MetricName, '' AS Description, '1' AS Unit, concat('svc-', user_id % 10) AS ServiceName,
  MAP {'event_type': event_type} AS DataPointAttributes, ts AS Time,
  CAST(sum(CAST(round(value*100) AS BIGINT)) OVER (PARTITION BY user_id % 10, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS Value,
  'AGGREGATION_TEMPORALITY_CUMULATIVE' AS AggregationTemporality, true AS IsMonotonic FROM events"""


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = lambda low, high: F.count_if(
        (F.lit(True) if low is None else F.col("value") > low) & (F.lit(True) if high is None else F.col("value") <= high)
    )
    grouped = (
        _events(spark, sf_dir)
        .groupBy(
            F.concat(F.lit("svc-"), F.col("user_id") % 10).alias("ServiceName"), "event_type",
            F.window("ts", "3600 seconds").getField("start").alias("Time"),
        )
        .agg(
            F.count(F.lit(1)).alias("Count"), F.round(F.sum("value"), 4).alias("Sum"),
            bucket(None, 5).alias("b0"), bucket(5, 10).alias("b1"), bucket(10, 50).alias("b2"),
            bucket(50, 100).alias("b3"), bucket(100, None).alias("b4"),
        )
    )
    return grouped.selectExpr(
        "'app.latency' AS MetricName", "'' AS Description", "'ms' AS Unit", "ServiceName",
        "map('event_type',event_type) AS DataPointAttributes", "Time", "Count", "Sum",
        "array(b0,b1,b2,b3,b4) AS BucketCounts", "array(5.0D,10.0D,50.0D,100.0D) AS ExplicitBounds",
    )


HISTOGRAM_SQL = """
SELECT 'app.latency' AS MetricName, '' AS Description, 'ms' AS Unit, ServiceName, MAP {'event_type': event_type} AS DataPointAttributes, h AS Time,
  n AS Count, s AS Sum, [b0,b1,b2,b3,b4] AS BucketCounts, [5.0,10.0,50.0,100.0]::DOUBLE[] AS ExplicitBounds
FROM (SELECT concat('svc-', user_id % 10) AS ServiceName, event_type, date_trunc('hour',ts) AS h, count(*) AS n, round(sum(value),4) AS s,
  count(CASE WHEN value<=5 THEN 1 END) AS b0, count(CASE WHEN value>5 AND value<=10 THEN 1 END) AS b1,
  count(CASE WHEN value>10 AND value<=50 THEN 1 END) AS b2, count(CASE WHEN value>50 AND value<=100 THEN 1 END) AS b3,
  count(CASE WHEN value>100 THEN 1 END) AS b4 FROM events GROUP BY 1,2,3) t"""


def ingest_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest_requests_of(_events(spark, sf_dir))


def ingest_requests_of(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "event_id AS RequestId", "ts AS ReceivedAt",
        "CASE event_id % 3 WHEN 0 THEN 'Logs' WHEN 1 THEN 'Traces' ELSE 'Metrics' END AS Signal",
        "CASE (event_id DIV 3) % 3 WHEN 0 THEN 'Grpc' WHEN 1 THEN 'Http' ELSE 'Scrape' END AS Protocol",
        "CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('svc-', user_id % 10) END AS ServiceName",
        "CASE WHEN event_type='error' THEN 0 ELSE CAST(get_json_object(props,'$.k') AS BIGINT)+1 END AS Records",
        "CASE WHEN event_type='error' THEN 0 ELSE (CAST(get_json_object(props,'$.k') AS BIGINT)+1)*256 + event_id % 97 END AS Bytes",
        "event_type='error' AS Rejected",
        "CASE WHEN event_type='error' THEN concat('invalid-payload:', CAST(CAST(get_json_object(props,'$.k') AS BIGINT) % 4 AS STRING)) ELSE '' END AS Reason",
    )


INGEST_SQL = """
SELECT event_id AS RequestId, ts AS ReceivedAt,
  CASE event_id % 3 WHEN 0 THEN 'Logs' WHEN 1 THEN 'Traces' ELSE 'Metrics' END AS Signal,
  CASE (event_id // 3) % 3 WHEN 0 THEN 'Grpc' WHEN 1 THEN 'Http' ELSE 'Scrape' END AS Protocol,
  CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('svc-', user_id % 10) END AS ServiceName,
  CASE WHEN event_type='error' THEN 0 ELSE CAST(json_extract_string(props,'$.k') AS BIGINT)+1 END AS Records,
  CASE WHEN event_type='error' THEN 0 ELSE (CAST(json_extract_string(props,'$.k') AS BIGINT)+1)*256 + event_id % 97 END AS Bytes,
  event_type='error' AS Rejected,
  CASE WHEN event_type='error' THEN concat('invalid-payload:', CAST(CAST(json_extract_string(props,'$.k') AS BIGINT) % 4 AS VARCHAR)) ELSE '' END AS Reason FROM events"""


def flush_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(
        "event_id AS FlushId",
        "CASE event_id % 3 WHEN 0 THEN 'Logs' WHEN 1 THEN 'Traces' ELSE 'Metrics' END AS Signal",
        "ts AS FlushedAt", "CAST(get_json_object(props,'$.k') AS BIGINT) AS BatchSize",
        "event_type='error' AS Failed", "CASE WHEN event_type='error' THEN 'timeout' ELSE '' END AS Error",
    )


FLUSH_SQL = """
SELECT event_id AS FlushId, CASE event_id % 3 WHEN 0 THEN 'Logs' WHEN 1 THEN 'Traces' ELSE 'Metrics' END AS Signal,
  ts AS FlushedAt, CAST(json_extract_string(props,'$.k') AS BIGINT) AS BatchSize, event_type='error' AS Failed,
  CASE WHEN event_type='error' THEN 'timeout' ELSE '' END AS Error FROM events"""


def rule_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS Id", "concat('rule-', o_custkey) AS Name", "o_orderstatus='F' AS IsDeleted",
        "o_orderpriority<>'5-LOW' AS Enabled", "CAST(o_orderkey % 50 AS BIGINT) AS ThresholdCount",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'LessThan' ELSE 'GreaterThanOrEqual' END AS ThresholdComparator",
        "CAST(60*(1 + o_orderkey % 1440) AS INT) AS WindowSeconds", "CAST(300 AS INT) AS CooldownSeconds",
        "concat('svc-', o_custkey % 10) AS ConditionService", "o_orderdate AS UpdatedAt", "o_orderkey AS InsertOrdinal",
    )


RULES_SQL = """
SELECT o_custkey AS Id, concat('rule-', o_custkey) AS Name, o_orderstatus='F' AS IsDeleted, o_orderpriority<>'5-LOW' AS Enabled,
  CAST(o_orderkey % 50 AS BIGINT) AS ThresholdCount, CASE WHEN o_orderkey % 4 = 0 THEN 'LessThan' ELSE 'GreaterThanOrEqual' END AS ThresholdComparator,
  CAST(60*(1 + o_orderkey % 1440) AS INT) AS WindowSeconds, CAST(300 AS INT) AS CooldownSeconds,
  concat('svc-', o_custkey % 10) AS ConditionService, o_orderdate AS UpdatedAt, o_orderkey AS InsertOrdinal FROM orders"""


def alert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Firing history: every error event as a past firing of the rule of its user."""
    return _events(spark, sf_dir).where("event_type = 'error'").selectExpr(
        "event_id AS EventId", "user_id AS RuleId", "concat('rule-', user_id) AS RuleName", "ts AS FiredAt",
        "CAST(get_json_object(props,'$.k') AS BIGINT) AS ObservedCount", "'Sent' AS NotificationStatus",
    )


ALERT_EVENTS_SQL = """
SELECT event_id AS EventId, user_id AS RuleId, concat('rule-', user_id) AS RuleName, ts AS FiredAt,
  CAST(json_extract_string(props,'$.k') AS BIGINT) AS ObservedCount, 'Sent' AS NotificationStatus
FROM events WHERE event_type = 'error'"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr("event_id AS QueryId", "ts AS EventTime", "value*10 AS DurationMs")


QUERY_LOG_SQL = "SELECT event_id AS QueryId, ts AS EventTime, value*10 AS DurationMs FROM events"

ORACLE_TABLES = {
    "logs": LOGS_SQL, "pattern_logs": PATTERN_LOGS_SQL, "spans": SPANS_SQL, "gauge": GAUGE_SQL,
    "sums": SUM_SQL, "histogram": HISTOGRAM_SQL, "ingest_requests": INGEST_SQL, "flush_log": FLUSH_SQL,
    "rule_versions": RULES_SQL, "alert_events": ALERT_EVENTS_SQL, "query_log": QUERY_LOG_SQL,
}
_NEEDS = {"pattern_logs": ["logs"]}


def oracle(tables: str, body: str) -> str:
    """``body`` behind WITH clauses for the named derived tables; a leading ``+`` in
    ``body`` continues the WITH list."""
    names: list[str] = []
    for name in tables.split():
        names += [n for n in [*_NEEDS.get(name, []), name] if n not in names]
    ctes = ",\n".join(f"{n} AS ({ORACLE_TABLES[n]})" for n in names)
    body = body.strip()
    if not names:
        return body
    return f"WITH {ctes}{', ' + body[1:] if body.startswith('+') else chr(10) + body}"
