"""OTLP/JSON export requests to flat telemetry rows.

Input frames hold one export request per row in a text column. The same plans run on
batch and streaming frames: schema-driven JSON decoding, three explodes, one projection.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from beaconry import schemas
from beaconry.functions.columns import let
from beaconry.functions.numbers import invariant_double_sql
from beaconry.functions.times import from_unix_nano

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


# One typed value. Numbers are read as text: 64-bit integers arrive quoted, doubles may be "NaN".
# Arrays and key-value lists stay JSON text, so that values may nest to any depth.
ANY_VALUE = _struct(stringValue=_S, boolValue=T.BooleanType(), intValue=_S, doubleValue=_S, bytesValue=_S, arrayValue=_S, kvlistValue=_S)
ATTRIBUTE_LIST = T.ArrayType(_struct(key=_S, value=ANY_VALUE))
_RESOURCE = _struct(attributes=ATTRIBUTE_LIST)
_SCOPE = _struct(name=_S, version=_S, attributes=ATTRIBUTE_LIST)


def _request(resources: str, scopes: str, records: str, record: T.StructType) -> T.StructType:
    scope = T.StructType([T.StructField("scope", _SCOPE), T.StructField(records, T.ArrayType(record)), T.StructField("schemaUrl", _S)])
    resource = T.StructType([
        T.StructField("resource", _RESOURCE), T.StructField(scopes, T.ArrayType(scope)), T.StructField("schemaUrl", _S)
    ])
    return T.StructType([T.StructField(resources, T.ArrayType(resource))])


LOG_REQUEST = _request("resourceLogs", "scopeLogs", "logRecords", _struct(
    timeUnixNano=_S, observedTimeUnixNano=_S, severityNumber=_S, severityText=_S, body=ANY_VALUE,
    attributes=ATTRIBUTE_LIST, flags=_S, traceId=_S, spanId=_S, eventName=_S,
))
_EVENT_LIST = T.ArrayType(_struct(timeUnixNano=_S, name=_S, attributes=ATTRIBUTE_LIST))
SPAN_REQUEST = _request("resourceSpans", "scopeSpans", "spans", _struct(
    traceId=_S, spanId=_S, parentSpanId=_S, traceState=_S, name=_S, kind=_S, startTimeUnixNano=_S, endTimeUnixNano=_S,
    attributes=ATTRIBUTE_LIST, events=_EVENT_LIST,
    status=_struct(code=_S, message=_S),
))
_NUMBER_POINT = _struct(attributes=ATTRIBUTE_LIST, startTimeUnixNano=_S, timeUnixNano=_S, asDouble=_S, asInt=_S)
_HISTOGRAM_POINT = _struct(
    attributes=ATTRIBUTE_LIST, startTimeUnixNano=_S, timeUnixNano=_S, count=_S, sum=_S,
    bucketCounts=T.ArrayType(_S), explicitBounds=T.ArrayType(_S),
)
METRIC_REQUEST = _request("resourceMetrics", "scopeMetrics", "metrics", _struct(
    name=_S, description=_S, unit=_S,
    gauge=_struct(dataPoints=T.ArrayType(_NUMBER_POINT)),
    sum=_struct(dataPoints=T.ArrayType(_NUMBER_POINT), aggregationTemporality=_S, isMonotonic=T.BooleanType()),
    histogram=_struct(dataPoints=T.ArrayType(_HISTOGRAM_POINT), aggregationTemporality=_S),
))

# Enum names in number order.
SEVERITY_NAMES = ["SEVERITY_NUMBER_UNSPECIFIED"] + [
    f"SEVERITY_NUMBER_{level}{n or ''}" for level in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL") for n in (0, 2, 3, 4)
]
SPAN_KIND_NAMES = [f"SPAN_KIND_{k}" for k in ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")]
STATUS_CODES = ["STATUS_CODE_UNSET", "STATUS_CODE_OK", "STATUS_CODE_ERROR"]
TEMPORALITIES = [f"AGGREGATION_TEMPORALITY_{k}" for k in ("UNSPECIFIED", "DELTA", "CUMULATIVE")]


def enum_number(text: Column, names: list[str]) -> Column:
    """An enum given by number or by name; 0 when absent or unknown."""
    by_name = F.array_position(F.array(*map(F.lit, names)), text).cast("int") - 1
    return F.coalesce(text.try_cast("int"), F.greatest(by_name, F.lit(0)), F.lit(0))


def _scalar_sql(value: str) -> str:
    return (
        f"coalesce({value}.stringValue, cast({value}.boolValue as string), {value}.intValue, "
        f"{invariant_double_sql(f'{value}.doubleValue', 'dt')}, {value}.bytesValue)"
    )


def _piece_sql(value: str) -> str:
    """SQL of one piece of a value's text: finished (``text``), or a list still to be unfolded."""
    return (
        f"element_at(transform(array({_scalar_sql(value)}), sc -> CASE "
        f"WHEN sc IS NULL AND {value}.arrayValue LIKE '{{%' THEN named_struct('text', '', 'arr', {value}.arrayValue, 'kv', cast(NULL as string)) "
        f"WHEN sc IS NULL AND {value}.kvlistValue LIKE '{{%' THEN named_struct('text', '', 'arr', cast(NULL as string), 'kv', {value}.kvlistValue) "
        "ELSE named_struct('text', coalesce(sc, ''), 'arr', cast(NULL as string), 'kv', cast(NULL as string)) END), 1)"
    )


def _levels_sql(text: str) -> str:
    """SQL of how many levels a list's JSON text can have: two braces each, those in strings left out."""
    unescaped = f"replace(replace({text}, '\\\\\\\\', ''), '\\\\\"', '')"
    braces = f"regexp_replace(regexp_replace({unescaped}, '\"[^\"]*\"', ''), '[^{{}}]', '')"
    deeper = "IF(br = '{', bs.d + 1, bs.d - 1)"
    return (
        f"aggregate(split({braces}, ''), named_struct('d', 0, 'm', 0), "
        f"(bs, br) -> named_struct('d', {deeper}, 'm', greatest(bs.m, {deeper})), bs -> (bs.m + 1) div 2)"
    )


def value_sql(value: str) -> str:
    """SQL for the text of one typed value; NULL for an unset one.

    Arrays read ``[a,b]`` and key-value lists ``{k=v}``, at any depth: the text is a row of
    pieces, and each pass unfolds every list among them by one level, as many times as the
    value has levels.
    """
    text = lambda t: f"array(named_struct('text', {t}, 'arr', cast(NULL as string), 'kv', cast(NULL as string)))"
    comma = lambda i: f"IF({i} > 0, ',', '')"
    fields = ANY_VALUE.simpleString()
    items = f"from_json(pc.arr, 'values array<{fields}>').values"
    entries = f"from_json(pc.kv, 'values array<struct<key:string,value:{fields}>>').values"
    none = f"slice({text(repr(''))}, 1, 0)"
    listed = f"flatten(transform({items}, (av, ai) -> concat({text(comma('ai'))}, array({_piece_sql('av')}))))"
    pairs = (
        "flatten(transform({0}, (ke, ki) -> concat({1}, array({2}))))".format(
            entries, text(f"concat({comma('ki')}, coalesce(ke.key, ''), '=')"), _piece_sql("ke.value"))
    )
    unfolded = (
        f"CASE WHEN pc.arr IS NOT NULL THEN concat({text(repr('['))}, coalesce({listed}, {none}), {text(repr(']'))}) "
        f"WHEN pc.kv IS NOT NULL THEN concat({text(repr('{'))}, coalesce({pairs}, {none}), {text(repr('}'))}) ELSE array(pc) END"
    )
    whole = (
        f"aggregate(sequence(1, {_levels_sql('coalesce(rt.arr, rt.kv)')}), array(rt), "
        f"(ps, lv) -> flatten(transform(ps, pc -> {unfolded})), ps -> array_join(transform(ps, pc -> pc.text), ''))"
    )
    is_list = f"({value}.arrayValue LIKE '{{%' OR {value}.kvlistValue LIKE '{{%')"
    return f"coalesce({_scalar_sql(value)}, IF({is_list}, element_at(transform(array({_piece_sql(value)}), rt -> {whole}), 1), NULL))"


def value_text(value: str) -> Column:
    return F.expr(value_sql(value))


def flatten_sql(attributes: str) -> str:
    """SQL for a typed attribute list as string map: unset values dropped, the last duplicate wins."""
    entries = (
        f"filter(transform({attributes}, a -> named_struct('key', a.key, 'value', {value_sql('a.value')})), "
        "e -> e.key IS NOT NULL AND e.value IS NOT NULL)"
    )
    # The one-element array names the entries, so that they are written once in the plan.
    last = (
        f"element_at(transform(array({entries}), es -> filter(es, (e, i) -> "
        "NOT exists(slice(es, i + 2, size(es)), later -> later.key = e.key))), 1)"
    )
    return f"coalesce(map_from_entries({last}), cast(map() as map<string,string>))"


def flatten_attributes(attributes: str) -> Column:
    return F.expr(flatten_sql(attributes))


def _nano(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def hex_id(value: Column, encoding: str) -> Column:
    """Ids as lower-case hex; ``encoding`` is 'hex' (the OTLP/JSON rule) or 'base64'."""
    value = _text(value)
    return F.lower(F.hex(F.unbase64(value))) if encoding == "base64" else F.lower(value)


def _expanded(requests: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """One row per record: resource and scope columns, plus the record as ``r``."""
    resources = schema.fields[0]
    scopes = resources.dataType.elementType.fields[1]
    records = scopes.dataType.elementType.fields[1]
    decoded = requests.select(F.explode(F.from_json(column, schema)[resources.name]).alias("a"))
    # Attributes are flattened once per resource and once per scope, before the next explode.
    resource = decoded.select(
        flatten_attributes("a.resource.attributes").alias("ResourceAttributes"),
        _text(F.col("a.schemaUrl")).alias("ResourceSchemaUrl"), F.explode(F.col("a")[scopes.name]).alias("b"),
    )
    return resource.select(
        "ResourceAttributes", "ResourceSchemaUrl", _text(F.col("ResourceAttributes")["service.name"]).alias("ServiceName"),
        flatten_attributes("b.scope.attributes").alias("ScopeAttributes"), _text(F.col("b.schemaUrl")).alias("ScopeSchemaUrl"),
        _text(F.col("b.scope.name")).alias("ScopeName"), _text(F.col("b.scope.version")).alias("ScopeVersion"),
        F.explode(F.col("b")[records.name]).alias("r"),
    )


def otlp_logs(requests: DataFrame, column: str = "value", id_encoding: str = "hex") -> DataFrame:
    """Log export requests to ``schemas.LOGS`` rows, each with a new EventId."""
    r = F.col
    observed = _nano(r("r.observedTimeUnixNano"))
    time = F.when(_nano(r("r.timeUnixNano")) != 0, _nano(r("r.timeUnixNano"))).otherwise(observed)
    return _expanded(requests, column, LOG_REQUEST).select(
        from_unix_nano(time).alias("Timestamp"),
        from_unix_nano(F.when(observed != 0, observed).otherwise(time)).alias("ObservedTimestamp"),
        hex_id(r("r.traceId"), id_encoding).alias("TraceId"), hex_id(r("r.spanId"), id_encoding).alias("SpanId"),
        F.coalesce(r("r.flags").try_cast("bigint"), F.lit(0)).bitwiseAND(F.lit(0xFF)).cast("int").alias("TraceFlags"),
        _text(r("r.severityText")).alias("SeverityText"), enum_number(r("r.severityNumber"), SEVERITY_NAMES).alias("SeverityNumber"),
        "ServiceName", _text(value_text("r.body")).alias("Body"), "ResourceSchemaUrl", "ResourceAttributes",
        "ScopeSchemaUrl", "ScopeName", "ScopeVersion", "ScopeAttributes",
        flatten_attributes("r.attributes").alias("LogAttributes"), _text(r("r.eventName")).alias("EventName"),
        F.uuid().alias("EventId"), F.lit("").alias("PatternId"), F.lit("").alias("PatternTemplate"),
    )


def otlp_spans(requests: DataFrame, column: str = "value", id_encoding: str = "hex") -> DataFrame:
    """Trace export requests to ``schemas.SPANS`` rows; duration from the raw nanoseconds."""
    r = F.col
    start, end = _nano(r("r.startTimeUnixNano")), _nano(r("r.endTimeUnixNano"))
    code = enum_number(r("r.status.code"), STATUS_CODES)
    events = F.expr(
        "transform(r.events, ev -> named_struct('Timestamp', timestampadd(MICROSECOND, "
        "coalesce(try_cast(ev.timeUnixNano as bigint), 0L) div 1000, TIMESTAMP_NTZ'1970-01-01 00:00:00'), "
        f"'Name', coalesce(ev.name, ''), 'Attributes', {flatten_sql('ev.attributes')}))"
    )
    events = F.coalesce(events, F.array().cast(schemas.SPANS["Events"].dataType))
    return _expanded(requests, column, SPAN_REQUEST).select(
        hex_id(r("r.traceId"), id_encoding).alias("TraceId"), hex_id(r("r.spanId"), id_encoding).alias("SpanId"),
        hex_id(r("r.parentSpanId"), id_encoding).alias("ParentSpanId"), _text(r("r.traceState")).alias("TraceState"),
        _text(r("r.name")).alias("Name"), enum_number(r("r.kind"), SPAN_KIND_NAMES).alias("Kind"),
        from_unix_nano(start).alias("StartTime"), from_unix_nano(end).alias("EndTime"), (end - start).alias("DurationNano"),
        label(code, STATUS_CODES).alias("StatusCode"), _text(r("r.status.message")).alias("StatusMessage"), "ServiceName",
        "ResourceSchemaUrl", "ResourceAttributes", "ScopeSchemaUrl", "ScopeName", "ScopeVersion", "ScopeAttributes",
        flatten_attributes("r.attributes").alias("SpanAttributes"), events.alias("Events"),
    )


def label(number: Column, labels: list[str]) -> Column:
    """Enum label of a number; the first label for anything out of range."""
    return F.coalesce(F.get(F.array(*map(F.lit, labels)), F.when(number >= 0, number)), F.lit(labels[0]))


class MetricFrames(NamedTuple):
    gauge: DataFrame
    sum: DataFrame
    histogram: DataFrame
    unsupported: DataFrame


def otlp_metrics(requests: DataFrame, column: str = "value") -> MetricFrames:
    """Metric export requests split by point type; other shapes are named in ``unsupported``."""
    metrics = _expanded(requests, column, METRIC_REQUEST)

    def points(kind: str, *measures: Column) -> DataFrame:
        exploded = metrics.where(F.col(f"r.{kind}").isNotNull()).withColumn("p", F.explode(f"r.{kind}.dataPoints"))
        time, start = _nano(F.col("p.timeUnixNano")), _nano(F.col("p.startTimeUnixNano"))
        return exploded.select(
            _text(F.col("r.name")).alias("MetricName"), _text(F.col("r.description")).alias("Description"),
            _text(F.col("r.unit")).alias("Unit"), "ServiceName", "ResourceSchemaUrl", "ResourceAttributes",
            "ScopeSchemaUrl", "ScopeName", "ScopeVersion", "ScopeAttributes",
            flatten_attributes("p.attributes").alias("DataPointAttributes"),
            from_unix_nano(F.when(start != 0, start).otherwise(time)).alias("StartTime"), from_unix_nano(time).alias("Time"),
            *measures,
        )

    value = F.coalesce(F.col("p.asDouble").try_cast("double"), F.col("p.asInt").try_cast("double"), F.lit(0.0)).alias("Value")
    temporality = lambda kind: label(enum_number(F.col(f"r.{kind}.aggregationTemporality"), TEMPORALITIES), TEMPORALITIES).alias("AggregationTemporality")
    none = F.lit(True)
    for kind in ("gauge", "sum", "histogram"):
        none = none & F.col(f"r.{kind}").isNull()
    return MetricFrames(
        points("gauge", value),
        points("sum", value, temporality("sum"), F.coalesce("r.sum.isMonotonic", F.lit(False)).alias("IsMonotonic")),
        points(
            "histogram", temporality("histogram"), _nano(F.col("p.count")).alias("Count"),
            F.coalesce(F.col("p.sum").try_cast("double"), F.lit(0.0)).alias("Sum"),
            F.coalesce(F.transform("p.bucketCounts", lambda c: _nano(c)), F.array().cast("array<bigint>")).alias("BucketCounts"),
            F.coalesce(F.transform("p.explicitBounds", lambda b: b.try_cast("double")), F.array().cast("array<double>")).alias("ExplicitBounds"),
        ),
        metrics.where(none).select(_text(F.col("r.name")).alias("MetricName")).distinct(),
    )


REQUEST_SCHEMAS = {"logs": LOG_REQUEST, "spans": SPAN_REQUEST, "metrics": METRIC_REQUEST}


def quarantine(requests: DataFrame, kind: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(decodable, undecodable) requests. Decoding is deterministic, so nothing is retried."""
    schema = T.StructType([*REQUEST_SCHEMAS[kind].fields, T.StructField("_corrupt", _S)])
    decoded = F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    undecodable = let(decoded, lambda request: request.isNull() | request["_corrupt"].isNotNull())
    bad = F.col(column).isNull() | (F.trim(F.col(column)) == "") | undecodable
    flagged = requests.withColumn("_bad", bad)
    return flagged.where(~F.col("_bad")).drop("_bad"), flagged.where(F.col("_bad")).drop("_bad")


def normalize_rows(df: DataFrame, kind: str) -> DataFrame:
    """Rows in stored form: column order, ``''`` and empty maps for NULL, labels, default times.

    ``kind`` is a telemetry table of ``schemas.TABLES``; absent columns get their default.
    StatusCode and AggregationTemporality may still be numbers.
    """
    schema = schemas.TABLES[kind]
    columns = set(df.columns)
    labels = {"StatusCode": STATUS_CODES, "AggregationTemporality": TEMPORALITIES}
    fallback = {"ObservedTimestamp": "Timestamp", "StartTime": "Time"}

    def stored(field: T.StructField) -> Column:
        name, kind_ = field.name, field.dataType
        given = F.col(name) if name in columns else F.lit(None)
        if name in labels:
            known = F.array_contains(F.array(*map(F.lit, labels[name])), given.cast("string"))
            named = label(F.coalesce(given.cast("string").try_cast("int"), F.lit(0)), labels[name])
            return F.when(F.coalesce(known, F.lit(False)), given.cast("string")).otherwise(named)
        if isinstance(kind_, T.StringType):
            return F.coalesce(given.cast("string"), F.lit(""))
        if isinstance(kind_, T.MapType):
            return F.coalesce(given.cast(kind_), F.create_map().cast(kind_))
        if isinstance(kind_, T.ArrayType):
            return F.coalesce(given.cast(kind_), F.array().cast(kind_))
        if isinstance(kind_, T.TimestampNTZType):
            other = fallback.get(name)
            return F.coalesce(given.cast(kind_), F.col(other)) if other in columns else given.cast(kind_)
        return F.coalesce(given.cast(kind_), F.lit(False if isinstance(kind_, T.BooleanType) else 0).cast(kind_))

    return df.select(*[stored(f).alias(f.name) for f in schema.fields])
