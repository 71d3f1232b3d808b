"""Nothing is capped, clamped or lost without being asked for."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from beaconry import schemas
from beaconry.operators import logs as log_ops, search
from beaconry.plans.ordered import preceding_min, previous_row, running_total
from beaconry.sources import prometheus, tables
from beaconry.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def test_a_trace_above_ten_thousand_spans_is_whole(spark):
    spans = spark.range(10_500).select(F.lit("t").alias("TraceId"), F.col("id").cast("string").alias("SpanId"), F.lit(T0).cast("timestamp_ntz").alias("StartTime"))
    assert search.trace_by_id(spans, "t").count() == 10_500
    assert search.trace_by_id(spans, "t", 7).count() == 7


def test_more_than_a_thousand_patterns(spark):
    rows = spark.range(1500).select(
        F.col("id").cast("string").alias("PatternId"), F.lit("x").alias("PatternTemplate"), F.lit(9).alias("SeverityNumber"), F.lit(T0).cast("timestamp_ntz").alias("Timestamp"))
    assert log_ops.log_patterns(rows, 1400).count() == 1400
    with pytest.raises(ValueError):
        log_ops.log_patterns(rows, -1)


def test_export_is_whole_by_default(spark):
    rows = spark.range(26_000).select(
        F.col("id").cast("string").alias("EventId"), F.lit(T0).cast("timestamp_ntz").alias("Timestamp"), F.lit("").alias("SeverityText"), F.lit(9).alias("SeverityNumber"),
        F.lit("s").alias("ServiceName"), F.lit("b").alias("Body"), F.lit("").alias("TraceId"), F.lit("").alias("SpanId"), F.create_map(F.lit("a"), F.lit("b")).alias("LogAttributes"))
    assert tables.export_logs(rows).count() == 26_000 and tables.export_logs(rows, 10).count() == 11


def test_rows_without_time_stay(spark):
    rows = [("k", None, 5), ("k", T0, 1), ("k", T0 + dt.timedelta(days=2), 2), ("j", None, 7)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v int")
    got = {(r.k, r.ts): (r.prev_v, r.total) for r in running_total(previous_row(df, ["k"], ["ts"], ["v"]), ["k"], ["ts"], "v", "total").collect()}
    assert got == {("k", None): (None, 5), ("k", T0): (5, 6), ("k", T0 + dt.timedelta(days=2)): (1, 8), ("j", None): (None, 7)}
    least = {(r.k, r.ts): r.m for r in preceding_min(df, ["k"], [F.desc("ts")], "v", "m").collect()}
    assert least == {("k", None): 1, ("k", T0): 2, ("k", T0 + dt.timedelta(days=2)): None, ("j", None): None}


def test_histograms_with_nan_and_infinity(spark):
    body = "\n".join(["# TYPE lat histogram", 'lat_bucket{le="1"} NaN', 'lat_bucket{le="2"} 3', 'lat_bucket{le="+Inf"} +Inf', "lat_sum 4", "lat_count NaN",
                      "# TYPE big histogram", 'big_bucket{le="+Inf"} 2', "big_sum 1", "big_count +Inf"])
    scrapes = spark.createDataFrame(
        [("s", "http://h:1/metrics", "job", body, T0, {})], "ScrapeId string, Url string, Job string, Body string, ScrapeTime timestamp_ntz, TargetLabels map<string,string>")
    got = {r.MetricName: r for r in prometheus.prometheus_points(scrapes).histogram.collect()}
    assert got["lat"].Count == 0 and got["lat"].BucketCounts[0] == 0 and got["lat"].BucketCounts[2] > 1 << 62
    assert got["big"].Count > 1 << 62


def test_late_events_of_a_stream_are_kept(spark, tmp_path):
    stamps = [T0 + dt.timedelta(hours=4), T0 + dt.timedelta(hours=5), T0, T0 + dt.timedelta(hours=6), T0]
    for i, (ts, name) in enumerate(zip(stamps, "abcdc")):
        spark.createDataFrame([(name, ts)], "EventId string, Timestamp timestamp_ntz").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("EventId string, Timestamp timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = jobs.dedupe_events(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.EventId for r in spark.read.parquet(out).collect()) == ["a", "b", "c", "d"]


def test_stream_and_batch_share_a_table(spark, tmp_path):
    path, source = str(tmp_path / "table"), str(tmp_path / "in")
    empty = spark.createDataFrame([], schemas.TABLES["logs"])
    rows = lambda ids: empty.unionByName(spark.createDataFrame([(f"e{i}", T0 + dt.timedelta(days=i)) for i in ids], "EventId string, Timestamp timestamp_ntz"), allowMissingColumns=True)
    rows(range(40)).write.parquet(source)
    stream = spark.readStream.schema(empty.schema).parquet(source)
    jobs.append_telemetry(stream, path, str(tmp_path / "cp"), "logs", drain=True).awaitTermination()
    tables.write_telemetry(rows(range(40, 70)), path, "logs")
    tables.write_telemetry(rows(range(70, 80)), path, "logs", load="again")
    tables.write_telemetry(rows(range(70, 80)), path, "logs", load="again")
    stored = tables.read_logs(spark, path)
    assert sorted(int(r.EventId[1:]) for r in stored.collect()) == list(range(80))
    assert stored.columns == [*empty.columns, "month"]
