"""Registered streaming queries: the events arrive as a file stream and are run to the end."""

from pyspark.sql import functions as F

from beaconry.catalog import alert_queries, pattern_queries, source_queries, tables as t
from beaconry.catalog.tables import oracle
from beaconry.plans.lineage import scratch_path
from beaconry.sources import otlp, tables as stored
from beaconry.streaming import jobs

QUERIES, ORACLES = {}, {}


def register(name, build, tables=None, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = oracle(tables, sql)


def run_to_end(spark, stream, mode="append"):
    """Write a stream's batches below a scratch folder until its input is used up."""
    out = scratch_path(spark, "stream")
    write = lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{out}/rows")


def _appended(spark, d):
    """Requests as text files, decoded and appended to a stored table by the streaming job."""
    source, table, checkpoint = (scratch_path(spark, n) for n in ("requests", "logs", "checkpoint"))
    source_queries.log_requests(t.read(spark, d, "events")).write.text(source)
    good, _ = otlp.quarantine(jobs.read_requests(spark, source), "logs")
    jobs.append_telemetry(otlp.otlp_logs(good), table, checkpoint, "logs", drain=True).awaitTermination()
    return stored.read_logs(spark, table)


register(
    "s9_append_telemetry",
    lambda spark, d: _appended(spark, d).select("Timestamp", "TraceId", "SpanId", "ServiceName", "Body", "month"),
    "logs", "SELECT Timestamp, TraceId, SpanId, ServiceName, Body, strftime(Timestamp, '%Y-%m') AS month FROM logs",
)
register(
    "l1_live_tail",
    lambda spark, d: run_to_end(spark, jobs.live_tail(
        t.logs_of(t.event_stream(spark, d)), services=["svc-1", "svc-2"], severities=[5, 9, 17], search="USER 1",
        attributes=[("resource", "service.name", "svc-1"), ("event_type", "click")],
    )).select("EventId", "Timestamp", "ServiceName", "Body"),
    "logs",
    """SELECT EventId, Timestamp, ServiceName, Body FROM logs WHERE ServiceName IN ('svc-1','svc-2') AND SeverityNumber IN (5,9,17)
    AND contains(lower(Body), 'user 1') AND ResourceAttributes['service.name']='svc-1' AND LogAttributes['event_type']='click'""",
)
register(
    "l2_ingest_buckets_stream",
    lambda spark, d: run_to_end(
        spark, jobs.ingest_buckets_stream(t.ingest_requests_of(t.event_stream(spark, d))), "update"
    ).groupBy("BucketStart", "Signal", "Protocol").agg(*[
        F.max_by(c, "batch").alias(c) for c in ("Requests", "Records", "Bytes", "Rejected")
    ]),
    "ingest_requests",
    """SELECT time_bucket(INTERVAL 1 MINUTE, ReceivedAt) AS BucketStart, Signal, Protocol, count(*) FILTER (NOT Rejected) AS Requests,
    CAST(coalesce(sum(Records) FILTER (NOT Rejected),0) AS BIGINT) AS Records, CAST(coalesce(sum(Bytes) FILTER (NOT Rejected),0) AS BIGINT) AS Bytes,
    count(*) FILTER (Rejected) AS Rejected FROM ingest_requests GROUP BY 1,2,3""",
)


def _alerts(spark, d):
    events, checkpoint = scratch_path(spark, "alert-events"), scratch_path(spark, "checkpoint")
    jobs.alert_stream(
        t.logs_of(t.event_stream(spark, d)), t.logs(spark, d), lambda: alert_queries.current_rules(spark, d),
        events, checkpoint, clock=lambda batch: alert_queries.AT, drain=True,
    ).awaitTermination()
    return spark.read.parquet(events).drop("batch")


register(
    "l3_alert_stream",
    lambda spark, d: _alerts(spark, d).select("RuleId", "RuleName", "FiredAt", "ObservedCount", "ThresholdCount", "NotificationStatus"),
    "rule_versions logs",
    alert_queries.RULES + alert_queries.COUNTED + f""" SELECT Id AS RuleId, Name AS RuleName, TIMESTAMP '{alert_queries.AT}' AS FiredAt,
    ObservedCount, ThresholdCount, 'Pending' AS NotificationStatus FROM e WHERE Breached""",
)


def _twice(logs):
    return logs.select("EventId", "Timestamp", "Body").unionByName(logs.select("EventId", "Timestamp", "Body"))


register(
    "l4_dedupe_events", lambda spark, d: jobs.dedupe_events(_twice(t.logs(spark, d))),
    "logs", "SELECT DISTINCT EventId, Timestamp, Body FROM logs",
)
register(
    "l4_dedupe_events_stream",
    lambda spark, d: run_to_end(spark, jobs.dedupe_events(_twice(t.logs_of(t.event_stream(spark, d))))).drop("batch"),
    "logs", "SELECT DISTINCT EventId, Timestamp, Body FROM logs",
)


def _unique(spark, d):
    """Every event twice, and once more in a second job on the same table."""
    table = scratch_path(spark, "logs")
    for _ in range(2):
        jobs.append_unique(_whole_twice(t.logs_of(t.event_stream(spark, d))), table, scratch_path(spark, "checkpoint"), drain=True).awaitTermination()
    return stored.read_logs(spark, table)


def _whole_twice(logs):
    return otlp.normalize_rows(logs.unionByName(logs), "logs")


register(
    "l4_append_unique", lambda spark, d: _unique(spark, d).select("EventId", "Timestamp", "ServiceName", "Body"),
    "logs", "SELECT EventId, Timestamp, ServiceName, Body FROM logs",
)


def _drained(spark, d):
    clusters, out, checkpoint = (scratch_path(spark, n) for n in ("clusters", "annotated", "checkpoint"))
    jobs.drain_stream(t.logs_of(t.event_stream(spark, d)), clusters, out, checkpoint, drain=True).awaitTermination()
    return spark.read.parquet(out)


register(
    "p5_drain_stream", lambda spark, d: _drained(spark, d).select("EventId", "PatternId", "PatternTemplate"),
    "logs", pattern_queries.MINED + """ SELECT EventId, template AS PatternTemplate, substr(sha256(template),1,16) AS PatternId
    FROM m JOIN tp ON len(w)=n AND w[1]=f""",
)
