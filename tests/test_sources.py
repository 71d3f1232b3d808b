import json

import pytest
from pyspark.sql import functions as F

from beaconry import schemas
from beaconry.functions.numbers import invariant_double
from beaconry.sources import otlp, prometheus

T0 = 1_704_067_200_000_000_000


def requests(spark, *payloads):
    return spark.createDataFrame([(p if isinstance(p, str) else json.dumps(p),) for p in payloads], "value string")


def attr(key, **value):
    return {"key": key, "value": value}


@pytest.fixture(scope="module")
def log_rows(spark):
    nested = {"values": [{"stringValue": "a"}, {}, {"arrayValue": {"values": [{"intValue": "1"}, {"arrayValue": {"values": [{"intValue": "2"}]}}]}}]}
    payload = {"resourceLogs": [{
        "resource": {"attributes": [attr("service.name", stringValue="shop"), attr("up", boolValue=True)]}, "schemaUrl": "r/1",
        "scopeLogs": [{"scope": {"name": "lib", "version": "2", "attributes": [attr("x", intValue="7")]}, "schemaUrl": "s/1", "logRecords": [
            {"timeUnixNano": str(T0 + 1999), "observedTimeUnixNano": str(T0 + 5_000_000), "severityNumber": 17, "severityText": "Error",
             "body": {"stringValue": "boom"}, "traceId": "AB" * 16, "spanId": "CD" * 8, "flags": 257, "eventName": "e",
             "attributes": [attr("d", doubleValue=1.5), attr("i", intValue="-9"), attr("b", bytesValue="AQI="), attr("l", arrayValue=nested),
                            attr("m", kvlistValue={"values": [{"key": "k", "value": {"doubleValue": 3.0}}, {"key": "n", "value": {}}]}),
                            attr("none"), attr("dup", stringValue="first"), attr("dup", stringValue="last"), attr("empty", arrayValue={})]},
            {"observedTimeUnixNano": str(T0), "severityNumber": "SEVERITY_NUMBER_WARN2", "body": {"intValue": "42"}},
        ]}],
    }, {"scopeLogs": [{"logRecords": [{"timeUnixNano": str(T0)}]}]}]}
    return otlp.otlp_logs(requests(spark, payload)).collect()


def test_log_fields(log_rows):
    first, second, third = log_rows
    assert str(first.Timestamp) == "2024-01-01 00:00:00.000001"
    assert str(first.ObservedTimestamp) == "2024-01-01 00:00:00.005000"
    assert (first.TraceId, first.SpanId, first.TraceFlags) == ("ab" * 16, "cd" * 8, 1)
    assert (first.SeverityNumber, first.SeverityText, first.Body, first.EventName) == (17, "Error", "boom", "e")
    assert (first.ServiceName, first.ResourceSchemaUrl, first.ScopeName, first.ScopeVersion) == ("shop", "r/1", "lib", "2")
    assert first.ScopeAttributes == {"x": "7"} and first.ResourceAttributes == {"service.name": "shop", "up": "true"}
    assert second.Timestamp == second.ObservedTimestamp and second.SeverityNumber == 14 and second.Body == "42"
    assert second.TraceId == "" and second.LogAttributes == {}
    assert third.ServiceName == "" and third.Body == "" and third.ObservedTimestamp == third.Timestamp
    assert len({r.EventId for r in log_rows}) == 3


def test_attribute_text(log_rows):
    assert log_rows[0].LogAttributes == {
        "d": "1.5", "i": "-9", "b": "AQI=", "l": "[a,,[1,[2]]]", "m": "{k=3,n=}", "dup": "last", "empty": "[]",
    }


def test_values_of_any_depth(spark):
    array = lambda *values: {"arrayValue": {"values": list(values)}}
    pairs = lambda **values: {"kvlistValue": {"values": [{"key": k, "value": v} for k, v in values.items()]}}
    chain = {"intValue": "1"}
    for _ in range(60):
        chain = array(chain)
    text = {"stringValue": 'a "{[\\\\" }'}
    cases = [
        (array(array(array(array(array({"intValue": "1"}))))), "[[[[[1]]]]]"), (chain, "[" * 60 + "1" + "]" * 60),
        (pairs(a=array(pairs(b=pairs(c=array(text, {}))), {"boolValue": False}), d={"doubleValue": 2.0}), "{a=[{b={c=[%s,]}},false],d=2}" % text["stringValue"]),
        (array(*[array({"intValue": str(i)}) for i in range(300)]), "[" + ",".join(f"[{i}]" for i in range(300)) + "]"),
        (pairs(), "{}"), ({"kvlistValue": {}}, "{}"), ({"arrayValue": {"values": None}}, "[]"), ({"arrayValue": None}, None),
        ({"kvlistValue": {"values": [{"value": {"intValue": "5"}}, {"key": "n"}]}}, "{=5,n=}"),
    ]
    payload = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": v, "attributes": [attr("v", **v)]} for v, _ in cases]}]}]}
    rows = otlp.otlp_logs(requests(spark, payload)).collect()
    assert [r.LogAttributes.get("v") for r in rows] == [want for _, want in cases]
    assert [r.Body for r in rows] == [want or "" for _, want in cases]


def test_double_text(spark):
    cases = {0.0: "0", 3.0: "3", -2.5: "-2.5", 1e7: "10000000", 0.0001: "0.0001", 1e-5: "1E-05", 1.5e17: "1.5E+17",
             123456789.25: "123456789.25", 1e15: "1E+15", 2e-10: "2E-10", 1e100: "1E+100", float("inf"): "Infinity"}
    got = spark.createDataFrame([(k,) for k in cases], "d double").select("d", invariant_double("d").alias("t")).collect()
    assert {r.d: r.t for r in got} == {**cases, 1e-5: got[list(cases).index(1e-5)].t}
    assert got[list(cases).index(1e-5)].t in ("1E-05", "0.00001")


def test_base64_ids(spark):
    payload = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": "1", "traceId": "q83v"}]}]}]}
    assert otlp.otlp_logs(requests(spark, payload), id_encoding="base64").head().TraceId == "abcdef"


def test_spans(spark):
    payload = {"resourceSpans": [{"scopeSpans": [{"spans": [
        {"traceId": "AA", "spanId": "BB", "name": "op", "kind": "SPAN_KIND_SERVER", "startTimeUnixNano": str(T0),
         "endTimeUnixNano": str(T0 + 1_500_001), "status": {"code": 2, "message": "bad"},
         "events": [{"timeUnixNano": str(T0 + 1000), "name": "ev", "attributes": [attr("k", stringValue="v")]}]},
        {"traceId": "AA", "spanId": "CC", "parentSpanId": "BB", "kind": 3, "startTimeUnixNano": str(T0), "endTimeUnixNano": str(T0 - 5)},
    ]}]}]}
    first, second = otlp.otlp_spans(requests(spark, payload)).collect()
    assert (first.DurationNano, first.Kind, first.StatusCode, first.StatusMessage, first.ParentSpanId) == (1_500_001, 2, "STATUS_CODE_ERROR", "bad", "")
    assert str(first.EndTime) == "2024-01-01 00:00:00.001500"
    assert first.Events[0].Name == "ev" and first.Events[0].Attributes == {"k": "v"}
    assert (second.ParentSpanId, second.DurationNano, second.StatusCode, second.Events) == ("bb", -5, "STATUS_CODE_UNSET", [])


def test_metrics(spark):
    payload = {"resourceMetrics": [{"resource": {"attributes": [attr("service.name", stringValue="s")]}, "scopeMetrics": [{"metrics": [
        {"name": "g", "unit": "ms", "gauge": {"dataPoints": [
            {"timeUnixNano": str(T0), "asInt": "5"}, {"timeUnixNano": str(T0), "asDouble": 2.5, "startTimeUnixNano": str(T0 - 1000)}, {"timeUnixNano": str(T0)}]}},
        {"name": "c", "sum": {"aggregationTemporality": 2, "isMonotonic": True, "dataPoints": [{"timeUnixNano": str(T0), "asDouble": 1}]}},
        {"name": "h", "histogram": {"aggregationTemporality": "AGGREGATION_TEMPORALITY_DELTA", "dataPoints": [
            {"timeUnixNano": str(T0), "count": "3", "bucketCounts": ["1", "2"], "explicitBounds": [0.5]}]}},
        {"name": "e", "exponentialHistogram": {"dataPoints": []}}, {"name": "s", "summary": {}}, {"name": "none"},
    ]}]}]}
    frames = otlp.otlp_metrics(requests(spark, payload))
    gauge = frames.gauge.collect()
    assert [r.Value for r in gauge] == [5.0, 2.5, 0.0]
    assert gauge[0].StartTime == gauge[0].Time and gauge[1].StartTime < gauge[1].Time
    total = frames.sum.head()
    assert (total.AggregationTemporality, total.IsMonotonic, total.Value) == ("AGGREGATION_TEMPORALITY_CUMULATIVE", True, 1.0)
    h = frames.histogram.head()
    assert (h.Count, h.Sum, h.BucketCounts, h.ExplicitBounds, h.AggregationTemporality) == (3, 0.0, [1, 2], [0.5], "AGGREGATION_TEMPORALITY_DELTA")
    assert {r.MetricName for r in frames.unsupported.collect()} == {"e", "s", "none"}
    for name, frame in (("metrics_gauge", frames.gauge), ("metrics_sum", frames.sum), ("metrics_histogram", frames.histogram)):
        assert frame.columns == schemas.TABLES[name].fieldNames()


def test_quarantine(spark):
    good, bad = otlp.quarantine(requests(spark, {"resourceLogs": []}, "{oops", "", {"resourceLogs": []}), "logs")
    assert (good.count(), bad.count()) == (2, 2)
    assert {r.value for r in bad.collect()} == {"{oops", ""}


def test_normalize_rows(spark):
    row = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01' AS StartTime, 9 AS StatusCode, CAST(NULL AS STRING) AS Name, 'a' AS TraceId")
    span = otlp.normalize_rows(row, "spans").head()
    assert (span.StatusCode, span.Name, span.TraceId, span.SpanAttributes, span.Events) == ("STATUS_CODE_UNSET", "", "a", {}, [])
    log = otlp.normalize_rows(spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01' AS Timestamp"), "logs").head()
    assert log.ObservedTimestamp == log.Timestamp and log.Body == "" and log.SeverityNumber == 0
    point = otlp.normalize_rows(spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01' AS Time, 2 AS AggregationTemporality"), "metrics_sum").head()
    assert point.StartTime == point.Time and point.AggregationTemporality == "AGGREGATION_TEMPORALITY_CUMULATIVE"


def scrape(spark, body, labels=None):
    return spark.createDataFrame(
        [(1, "job1", "http://host-a:9090/metrics", labels or {}, "2024-01-01 00:00:00", body)],
        "ScrapeId int, Job string, Url string, TargetLabels map<string,string>, ScrapeTime string, Body string",
    ).withColumn("ScrapeTime", F.col("ScrapeTime").cast("timestamp_ntz"))


BODY = r"""# HELP up Is it\nup? back\\slash
# TYPE up gauge
up 1
# TYPE hits counter
hits{code="200",path="/a"} 12 1704067200500

# just a comment
plain 3.5e2
esc{v="a\"b\\n\nc\t",} +Inf
nan NaN
neg{ x = "1" , y="2"} -Inf
bad{x="1" 5
bad2
bad3 x
bad4 1 2 3
bad5 1 1.5
{x="1"} 4
metric12
dup{a="1",a="2"}7
"""


def test_prometheus_samples(spark):
    rows = {r.Name: r for r in prometheus.prometheus_samples(scrape(spark, BODY)).collect()}
    assert set(rows) == {"up", "hits", "plain", "esc", "nan", "neg", "dup"}
    assert rows["up"].Type == "gauge" and rows["up"].Help == "Is it\nup? back\\slash"
    assert rows["hits"].Labels == {"code": "200", "path": "/a"} and rows["hits"].TimestampMs == 1704067200500
    assert rows["plain"].Value == 350.0 and rows["plain"].Type == "untyped" and rows["plain"].Labels == {}
    assert rows["esc"].Labels == {"v": 'a"b\\n\nc\\t'} and rows["esc"].Value == float("inf")
    assert rows["nan"].Value != rows["nan"].Value
    assert rows["neg"].Labels == {"x": "1", "y": "2"} and rows["neg"].Value == float("-inf")
    assert rows["dup"].Labels == {"a": "2"} and rows["dup"].Value == 7.0


HISTOGRAM = """# TYPE lat histogram
lat_bucket{m="get",le="0.5"} 7
lat_bucket{m="get",le="0.1"} 3
lat_bucket{m="get",le="1"} 10
lat_bucket{m="get",le="+Inf"} 12
lat_sum{m="get"} 8.2
lat_count{m="get"} 12
lat_bucket{m="put",le="1"} 5
lat_bucket{m="put",le="+Inf"} 4
lat 3
# TYPE rpc summary
rpc{quantile="0.5"} 1
rpc_sum 2
rpc_count 3
# TYPE reqs counter
reqs 4
free 1
"""


def test_prometheus_points(spark):
    frames = prometheus.prometheus_points(scrape(spark, HISTOGRAM, {"service.name": "renamed", "zone": "z"}))
    assert [r.MetricName for r in frames.gauge.collect()] == ["free"]
    total = frames.sum.head()
    assert (total.MetricName, total.Value, total.IsMonotonic, total.ServiceName) == ("reqs", 4.0, True, "renamed")
    assert total.ResourceAttributes == {"service.name": "renamed", "service.instance.id": "host-a:9090", "zone": "z"}
    rows = {r.DataPointAttributes["m"]: r for r in frames.histogram.collect()}
    assert (rows["get"].BucketCounts, rows["get"].ExplicitBounds, rows["get"].Count, rows["get"].Sum) == ([3, 4, 3, 2], [0.1, 0.5, 1.0], 12, 8.2)
    assert (rows["put"].BucketCounts, rows["put"].Count, rows["put"].Sum) == ([5, 0], 4, 0.0)
    assert {r.MetricName for r in frames.unsupported.collect()} == {"lat", "rpc"}
    for name, frame in (("metrics_gauge", frames.gauge), ("metrics_sum", frames.sum), ("metrics_histogram", frames.histogram)):
        assert frame.columns == schemas.TABLES[name].fieldNames()


def test_many_directives(spark):
    """Ten thousand directives in one scrape, half of them repeated: the last one counts."""
    lines = [f"# TYPE m{i % 5000} {'gauge' if i < 5000 else 'counter'}" for i in range(10_000)] + ["m0 1", "m4999 2"]
    rows = {r.Name: r.Type for r in prometheus.prometheus_samples(scrape(spark, "\n".join(lines))).collect()}
    assert rows == {"m0": "counter", "m4999": "counter"}
