import datetime as dt

import pytest
from pyspark.sql import functions as F

from beaconry import schemas
from beaconry.operators import ingest, reports
from beaconry.operators.counters import counter_rate, growth_per_day

NOW = dt.datetime(2024, 1, 1, 12, 0, 30)


def frame(spark, rows, schema):
    names = [f.name for f in schema.fields if isinstance(f.dataType, type(schemas.LOGS["Timestamp"].dataType))]
    text = ", ".join(f"{f.name} {'string' if f.name in names else f.dataType.simpleString()}" for f in schema.fields)
    df = spark.createDataFrame([tuple(str(v) if isinstance(v, dt.datetime) else v for v in r) for r in rows], text)
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names})


def requests(spark, rows):
    return frame(spark, [(i, at, sig, proto, svc, n, b, rej, "") for i, (at, sig, proto, svc, n, b, rej) in enumerate(rows)], schemas.INGEST_REQUESTS)


def flushes(spark, rows):
    return frame(spark, [(i, sig, at, n, bad, "boom" if bad else "") for i, (sig, at, n, bad) in enumerate(rows)], schemas.FLUSH_LOG)


def ago(seconds):
    return NOW - dt.timedelta(seconds=seconds)


def test_minutes_clamp():
    assert [ingest.window_minutes(m) for m in (None, 0, -5, 1, 60, 9999)] == [60, 60, 60, 1, 60, 9999]


def test_dense_grid_without_data(spark):
    rows = ingest.ingest_buckets(requests(spark, []), NOW, 3).collect()
    assert len(rows) == 27 and all(r.Requests == r.Rejected == 0 for r in rows)
    assert {str(r.BucketStart)[11:16] for r in rows} == {"11:58", "11:59", "12:00"}


def test_totals_use_the_current_minute_only(spark):
    df = requests(spark, [(ago(10), "Logs", "Grpc", "a", 5, 100, False), (ago(70), "Logs", "Grpc", "a", 7, 200, False),
                          (ago(5), "Traces", "Http", "", 0, 0, True), (ago(9999), "Logs", "Grpc", "a", 1, 1, False)])
    row = ingest.ingest_totals(df, NOW, 60).head()
    assert tuple(row) == (1, 5, 100, 2, 1)


@pytest.mark.parametrize("accepted, rejected, status", [(0, 0, "idle"), (3, 0, "healthy"), (2, 2, "down"), (3, 1, "degraded"), (0, 2, "idle")])
def test_receiver_status(spark, accepted, rejected, status):
    df = requests(spark, [(ago(5), "Logs", "Http", "a", 1, 1, i >= accepted) for i in range(accepted + rejected)])
    assert {r.Protocol: r.Status for r in ingest.receiver_status(df, NOW).collect()}["Http"] == status


def test_service_share(spark):
    df = spark.createDataFrame([(1, "a", 2, 100), (1, "", 1, 100), (1, "a", 1, 100), (2, "b", 0, 9)], "RequestId bigint, ServiceName string, Records bigint, Bytes bigint")
    got = {(r.RequestId, r.ServiceName): (r.Records, r.Bytes) for r in ingest.service_share(df).collect()}
    assert got == {(1, "a"): (3, 75), (1, "unknown_service"): (1, 25), (2, "b"): (0, 0)}


def test_top_services_fold(spark):
    df = spark.createDataFrame([("Logs", f"s{i}", 10 - (i // 2), 1) for i in range(8)], "Signal string, ServiceName string, Records bigint, Bytes bigint")
    rows = {r.ServiceName: r for r in ingest.top_services(df).collect()}
    assert [n for n, r in sorted(rows.items(), key=lambda x: (x[1].Rank or 99))] == ["s0", "s1", "s2", "s3", "s4", "other"]
    assert (rows["other"].Services, rows["other"].Records, rows["other"].Bytes) == (3, 8 + 7 + 7, 3)


def state(spark, flush_rows, request_rows, capacity=1000):
    req, fl = requests(spark, request_rows), flushes(spark, flush_rows)
    return ingest.flush_health(fl), ingest.stream_backlog(req, fl, NOW, capacity), ingest.ingest_buckets(req, NOW, 60), ingest.ingest_totals(req, NOW, 60)


CASES = [
    ("down", [("Logs", ago(9), 5, False), ("Logs", ago(8), 0, True), ("Logs", ago(7), 0, True), ("Logs", ago(6), 0, True)], []),
    ("retrying", [("Logs", ago(9), 5, False), ("Logs", ago(8), 0, True)], []),
    ("stuck", [("Logs", ago(9), 5, False)], [(ago(900), "Logs", "Grpc", "a", 5, 1, False), (ago(400), "Logs", "Grpc", "a", 3, 1, False)]),
    ("stale", [("Logs", ago(100), 9, False)], [(ago(30), "Logs", "Grpc", "a", 9, 1, False)]),
    ("recovered", [("Logs", ago(9), 0, True), ("Logs", ago(8), 5, False)], []),
    ("idle", [], []),
    ("healthy", [("Logs", ago(8), 5, False)], []),
]


@pytest.mark.parametrize("expected, flush_rows, request_rows", CASES)
def test_flush_status(spark, expected, flush_rows, request_rows):
    health, backlog, buckets, _ = state(spark, flush_rows, request_rows)
    assert {r.Signal: r.Status for r in ingest.flush_status(health, backlog, buckets, NOW).collect()}["Logs"] == expected


def test_verdicts(spark):
    def verdict(flush_rows, request_rows, capacity=1000):
        return tuple(ingest.ingest_verdict(*state(spark, flush_rows, request_rows, capacity), NOW).head())

    assert verdict([], []) == ("healthy", "All receivers operational · 0% rejected · no pipeline backlog")
    ok = ("Logs", ago(5), 5, False)
    assert verdict([ok], [(ago(20), "Logs", "Grpc", "a", 8, 1, False), (ago(10), "Logs", "Http", "a", 0, 0, True)]) == (
        "degraded", "Logs backlog building (3 buffered) · 100% rejected (1)")
    assert verdict([ok], [(ago(20), "Logs", "Grpc", "a", 97, 1, False)], 100) == (
        "down", "Logs buffer at 92% capacity, oldest entries at risk of being dropped")
    assert verdict([ok], [(ago(20), "Logs", "Grpc", "a", 80, 1, False)], 100) == ("degraded", "Logs buffer at 75% capacity")
    down = [("Traces", ago(9 - i), 0, True) for i in range(3)]
    assert verdict(down, [(ago(20), "Traces", "Grpc", "a", 4, 1, False)]) == ("down", "Traces exporter unavailable · 4 buffered (0%)")


def test_flush_health_without_rows(spark):
    rows = ingest.flush_health(flushes(spark, [])).collect()
    assert [(r.LastFlushAt, r.LastError, r.ConsecutiveErrors) for r in rows] == [(None, None, 0)] * 3


def test_counter_rates(spark):
    rows = [("a", ago(30), 10.0), ("a", ago(20), 30.0), ("a", ago(20), 40.0), ("a", ago(10), 5.0), ("b", ago(1), 1.0)]
    df = spark.createDataFrame([(k, str(t), v) for k, t, v in rows], "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = sorted((r.k, r.v, r.Rate) for r in counter_rate(df, ["k"], "t", "v", ["v"]).collect())
    assert got == [("a", 5.0, 0.0), ("a", 10.0, 0.0), ("a", 30.0, 2.0), ("a", 40.0, 0.0), ("b", 1.0, 0.0)]
    grown = {r.k: (r.PerDay, r.SpanHours) for r in growth_per_day(df, ["k"], "t", "v", 10, NOW).collect()}
    assert grown["b"][0] is None and grown["a"][0] == pytest.approx((5.0 - 10.0) / (30 / 86_400))


def test_reports_without_data(spark):
    log = spark.createDataFrame([], schemas.QUERY_LOG)
    assert tuple(reports.query_latency(log, NOW).head()) == (None, None, None, 0, 0)
    growth = spark.createDataFrame([], "Day date, TableName string, Bytes bigint, Rows bigint")
    assert reports.avg_daily_growth(growth).count() == 0
