"""Explicit schemas of the telemetry tables.

Absent strings are stored as ``''`` and absent maps as empty maps; timestamps are
``TIMESTAMP_NTZ`` holding UTC wall-clock time, so no session zone can shift them.
"""

from pyspark.sql import types as T

_S, _NTZ, _L, _I, _D, _B = (
    T.StringType(), T.TimestampNTZType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(),
)
ATTRIBUTES = T.MapType(_S, _S)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SPAN_EVENT = _struct(Timestamp=_NTZ, Name=_S, Attributes=ATTRIBUTES)

LOGS = _struct(
    Timestamp=_NTZ, ObservedTimestamp=_NTZ, TraceId=_S, SpanId=_S, TraceFlags=_I, SeverityText=_S,
    SeverityNumber=_I, ServiceName=_S, Body=_S, ResourceSchemaUrl=_S, ResourceAttributes=ATTRIBUTES,
    ScopeSchemaUrl=_S, ScopeName=_S, ScopeVersion=_S, ScopeAttributes=ATTRIBUTES,
    LogAttributes=ATTRIBUTES, EventName=_S, EventId=_S, PatternId=_S, PatternTemplate=_S,
)

SPANS = _struct(
    TraceId=_S, SpanId=_S, ParentSpanId=_S, TraceState=_S, Name=_S, Kind=_I, StartTime=_NTZ,
    EndTime=_NTZ, DurationNano=_L, StatusCode=_S, StatusMessage=_S, ServiceName=_S,
    ResourceSchemaUrl=_S, ResourceAttributes=ATTRIBUTES, ScopeSchemaUrl=_S, ScopeName=_S,
    ScopeVersion=_S, ScopeAttributes=ATTRIBUTES, SpanAttributes=ATTRIBUTES,
    Events=T.ArrayType(SPAN_EVENT),
)

_METRIC = dict(
    MetricName=_S, Description=_S, Unit=_S, ServiceName=_S, ResourceSchemaUrl=_S,
    ResourceAttributes=ATTRIBUTES, ScopeSchemaUrl=_S, ScopeName=_S, ScopeVersion=_S,
    ScopeAttributes=ATTRIBUTES, DataPointAttributes=ATTRIBUTES, StartTime=_NTZ, Time=_NTZ,
)
GAUGE = _struct(**_METRIC, Value=_D)
SUM = _struct(**_METRIC, Value=_D, AggregationTemporality=_S, IsMonotonic=_B)
HISTOGRAM = _struct(
    **_METRIC, AggregationTemporality=_S, Count=_L, Sum=_D,
    BucketCounts=T.ArrayType(_L), ExplicitBounds=T.ArrayType(_D),
)

ALERT_RULES = _struct(
    Id=_S, Name=_S, Description=_S, Enabled=_B, IsDeleted=_B, ConditionJson=_S, ThresholdCount=_L,
    ThresholdComparator=_S, WindowSeconds=_I, CooldownSeconds=_I, CreatedAt=_NTZ, UpdatedAt=_NTZ,
)
SAVED_VIEWS = _struct(
    Id=_S, Name=_S, PageType=_S, StateJson=_S, IsDeleted=_B, CreatedAt=_NTZ, UpdatedAt=_NTZ,
)
ALERT_EVENTS = _struct(
    EventId=_S, RuleId=_S, RuleName=_S, FiredAt=_NTZ, ObservedCount=_L, ThresholdCount=_L,
    WindowSeconds=_I, NotificationStatus=_S, NotificationStatusCode=_I, NotificationError=_S,
)
INGEST_REQUESTS = _struct(
    RequestId=_L, ReceivedAt=_NTZ, Signal=_S, Protocol=_S, ServiceName=_S, Records=_L, Bytes=_L,
    Rejected=_B, Reason=_S,
)
FLUSH_LOG = _struct(
    FlushId=_L, Signal=_S, FlushedAt=_NTZ, BatchSize=_L, Failed=_B, Error=_S,
)
QUERY_LOG = _struct(QueryId=_L, EventTime=_NTZ, DurationMs=_D)

# The log filter a rule's ConditionJson decodes to (its own time bounds are ignored).
LOG_FILTER = T.StructType([
    T.StructField("services", T.ArrayType(_S)),
    T.StructField("severityNumbers", T.ArrayType(_I)),
    T.StructField("traceId", _S),
    T.StructField("spanId", _S),
    T.StructField("patternId", _S),
    T.StructField("search", _S),
    T.StructField("attributes", T.ArrayType(_struct(bag=_S, key=_S, value=_S))),
])

TABLES = {
    "logs": LOGS, "spans": SPANS, "metrics_gauge": GAUGE, "metrics_sum": SUM,
    "metrics_histogram": HISTOGRAM, "alert_rules": ALERT_RULES, "saved_views": SAVED_VIEWS,
    "alert_events": ALERT_EVENTS, "ingest_requests": INGEST_REQUESTS, "flush_log": FLUSH_LOG,
    "query_log": QUERY_LOG,
}
