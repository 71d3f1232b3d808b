"""Stored tables, exports and streaming jobs over several micro-batches."""

import json

import pytest
from pyspark.sql import functions as F

from beaconry.catalog import tables as t
from beaconry.sources import otlp, tables
from beaconry.streaming import jobs

SF_DIR = "/root/testdata/sf0.001"


def test_layout_and_pruning(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs = otlp.normalize_rows(t.logs(spark, SF_DIR), "logs")
    shifted = logs.withColumn("Timestamp", F.col("Timestamp") + F.expr("INTERVAL '40' DAY"))
    tables.write_telemetry(logs.unionByName(shifted), path, "logs", partitions=4)
    back = tables.read_logs(spark, path)
    assert back.count() == 2 * logs.count()
    one = back.where(F.col("month") == "2024-01").where(F.col("TraceId") == logs.head().TraceId)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "EqualTo(TraceId" in plan
    assert one.count() == logs.where(F.col("TraceId") == logs.head().TraceId).count()


def test_exports(spark, tmp_path):
    rows = tables.export_logs(t.logs(spark, SF_DIR), cap=20)
    assert rows.count() == 21
    for fmt in ("csv", "json", "ndjson", "xml"):
        tables.write_export(rows, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).count() == 21
    stamps = sorted(r.Timestamp.isoformat(timespec="microseconds") for r in rows.collect())
    assert sorted(r.Timestamp for r in spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).collect()) == stamps
    assert sorted(json.loads(r.value)["timestamp"] for r in spark.read.text(str(tmp_path / "json")).collect()) == stamps
    first = json.loads(spark.read.text(str(tmp_path / "json")).head().value)
    assert set(first) == {"eventId", "timestamp", "severity", "severityNumber", "service", "eventName", "message", "traceId", "spanId", "logAttributes"}
    assert set(first["logAttributes"]) == {"event_type", "k", "value"}
    xml = spark.read.format("xml").option("rowTag", "Log").load(str(tmp_path / "xml"))
    assert xml.count() == 21 and "LogAttributes" in xml.columns
    with pytest.raises(ValueError):
        tables.write_export(rows, str(tmp_path / "x"), "xlsx")


def test_export_pages(spark):
    logs = t.logs(spark, SF_DIR)
    n = logs.count()
    for cap, truncated in ((20, True), (n - 1, True), (n, False), (n + 1, False)):
        rows, more = tables.export_page(logs, cap)
        assert (rows.count(), more) == (min(cap, n), truncated)
    first = tables.export_page(logs, 5)[0].collect()
    assert first == tables.export_logs(logs).limit(5).collect()


def batches(spark, tmp_path, frames):
    """One file per frame, read one file per micro-batch in name order."""
    source = tmp_path / "in"
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(str(source))
        import time
        time.sleep(1.1)  # file streams order by modification time
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def bodies(spark, texts, start):
    rows = [(start + i, f"2024-01-01 00:00:{start + i:02d}", b) for i, b in enumerate(texts)]
    return spark.createDataFrame(rows, "EventId int, Timestamp string, Body string").withColumn("Timestamp", F.col("Timestamp").cast("timestamp_ntz"))


def forget_commit(checkpoint, batch_id):
    """The batch ran, but its end was not noted: a restart repeats it."""
    for name in (f"{batch_id}", f".{batch_id}.crc"):
        (checkpoint / "commits" / name).unlink()


def test_online_templates(spark, tmp_path):
    stream = batches(spark, tmp_path, [
        bodies(spark, ["job a done ok", "other text here"], 0), bodies(spark, ["job b done ok", "job c done ok", ""], 10), bodies(spark, ["job d done ok"], 20),
    ])
    paths = [str(tmp_path / n) for n in ("clusters", "out", "checkpoint")]
    jobs.drain_stream(stream, *paths, drain=True).awaitTermination()
    got = {r.EventId: r.PatternTemplate for r in spark.read.parquet(paths[1]).collect()}
    assert got == {0: "job a done ok", 1: "other text here", 10: "job <*> done ok", 11: "job <*> done ok", 12: "", 20: "job <*> done ok"}
    last = spark.read.parquet(paths[0]).where("version = 2").collect()
    assert {(r.template, r.last_used) for r in last} == {("job <*> done ok", 2), ("other text here", 0)}


def test_alert_cooldown_over_batches(spark, tmp_path):
    stream = batches(spark, tmp_path, [bodies(spark, ["x"], i) for i in (0, 10, 40)])
    history = bodies(spark, ["x"] * 59, 0).withColumn("ServiceName", F.lit("a"))
    rules = lambda: spark.sql("""SELECT 1 AS Id, 'r' AS Name, 1L AS ThresholdCount, 'GreaterThanOrEqual' AS ThresholdComparator, 5 AS WindowSeconds,
        30 AS CooldownSeconds, named_struct('services', array('a'), 'severityNumbers', cast(null as array<int>), 'traceId', '', 'spanId', '',
        'patternId', '', 'search', '', 'attributes', cast(null as array<struct<bag:string,key:string,value:string>>)) AS Condition""")
    events = str(tmp_path / "events")
    jobs.alert_stream(stream, history, rules, events, str(tmp_path / "cp"), drain=True).awaitTermination()
    fired = [str(r.FiredAt)[17:19] for r in spark.read.parquet(events).orderBy("FiredAt").collect()]
    # 00:00 sees nothing before it; 00:10 fires; 00:40 is past the cooldown and fires again.
    assert fired == ["10", "40"]
    assert sorted(p.name for p in (tmp_path / "events" / "_last").iterdir()) == ["version=1", "version=2"]


def test_stream_dedupe_across_batches(spark, tmp_path):
    stream = batches(spark, tmp_path, [bodies(spark, ["a", "b"], 0), bodies(spark, ["c", "d"], 1)])
    out = str(tmp_path / "out")
    write = lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")
    jobs.each_batch(jobs.dedupe_events(stream), write, str(tmp_path / "cp"), drain=True).awaitTermination()
    assert sorted((r.EventId, r.Body) for r in spark.read.parquet(out).collect()) == [(0, "a"), (1, "b"), (2, "d")]


def test_unique_against_stored_rows(spark, tmp_path):
    """Repeats are found in the table, in later batches and later jobs; keyless rows stay."""
    rows = lambda *r: otlp.normalize_rows(spark.createDataFrame(list(r), "EventId string, Timestamp string, Body string").withColumn(
        "Timestamp", F.col("Timestamp").cast("timestamp_ntz")), "logs").withColumn("EventId", F.expr("nullif(EventId, 'none')"))
    first = rows(("a", "2024-01-05", "1"), ("a", "2024-01-05", "1"), ("b", "2024-02-01", "2"), ("none", "2024-01-05", "3"), ("none", "2024-01-05", "3"), ("t", None, "4"))
    later = rows(("b", "2024-02-01", "2"), ("c", "2024-02-01", "5"), ("a", "2024-01-05", "1"), ("t", None, "4"))
    table = str(tmp_path / "table")
    jobs.append_unique(batches(spark, tmp_path, [first, later]), table, str(tmp_path / "cp"), drain=True).awaitTermination()
    got = lambda: sorted((r.EventId or "", r.Body) for r in tables.read_logs(spark, table).collect())
    want = [("", "3"), ("", "3"), ("a", "1"), ("b", "2"), ("c", "5"), ("t", "4")]
    assert got() == want
    # A repeated micro-batch replaces its load: it does not take its own rows for repeats.
    forget_commit(tmp_path / "cp", 1)
    jobs.append_unique(spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), table, str(tmp_path / "cp"), drain=True).awaitTermination()
    assert got() == want


def test_versions_do_not_pile_up(spark, tmp_path):
    """After many batches two versions of templates and of last firings are left; a restart goes on from them."""
    frames = [bodies(spark, [f"job {c} done ok"], i) for i, c in enumerate("abcdef")]
    stream = batches(spark, tmp_path, frames)
    paths = [str(tmp_path / n) for n in ("clusters", "out", "checkpoint")]
    jobs.drain_stream(stream, *paths, drain=True).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "clusters").iterdir()) == ["version=4", "version=5"]
    want = {(r.EventId, r.PatternTemplate) for r in spark.read.parquet(paths[1]).collect()}
    forget_commit(tmp_path / "checkpoint", 5)
    again = spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.drain_stream(again, *paths, drain=True).awaitTermination()
    assert {(r.EventId, r.PatternTemplate) for r in spark.read.parquet(paths[1]).collect()} == want
