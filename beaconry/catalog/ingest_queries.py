"""Registered queries over ingest requests and flushes."""

from pyspark.sql import functions as F

from beaconry.catalog import tables as t
from beaconry.catalog.tables import oracle
from beaconry.operators import ingest as ops

QUERIES, ORACLES = {}, {}
AT = "2024-01-20 12:00:30"
CURRENT = "TIMESTAMP '2024-01-20 12:00:00'"
DAY = 1440
WINDOW = f"ReceivedAt >= {CURRENT} - INTERVAL 1439 MINUTES AND ReceivedAt < {CURRENT} + INTERVAL 1 MINUTE"
SIGNAL_LIST = "(SELECT unnest(['Logs','Traces','Metrics']) AS Signal)"
PROTOCOL_LIST = "(SELECT unnest(['Grpc','Http','Scrape']) AS Protocol)"


def register(name, build, tables=None, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = oracle(tables, sql)


def buckets_sql(minutes, current):
    return f"""+g AS (SELECT {current} - to_minutes(CAST(m AS INT)) AS BucketStart, Signal, Protocol
      FROM range(0, {minutes}) r(m), {SIGNAL_LIST} s, {PROTOCOL_LIST} p),
    n AS (SELECT time_bucket(INTERVAL 1 MINUTE, ReceivedAt) AS BucketStart, Signal, Protocol,
      count(*) FILTER (NOT Rejected) AS Requests, CAST(coalesce(sum(Records) FILTER (NOT Rejected),0) AS BIGINT) AS Records,
      CAST(coalesce(sum(Bytes) FILTER (NOT Rejected),0) AS BIGINT) AS Bytes, count(*) FILTER (Rejected) AS Rejected
      FROM ingest_requests GROUP BY 1,2,3),
    i1 AS (SELECT BucketStart, Signal, Protocol, coalesce(Requests,0) AS Requests, coalesce(Records,0) AS Records,
      coalesce(Bytes,0) AS Bytes, coalesce(Rejected,0) AS Rejected FROM g LEFT JOIN n USING (BucketStart, Signal, Protocol))"""


BUCKETS = buckets_sql(DAY, CURRENT)
register(
    "i1_ingest_buckets",
    lambda spark, d: ops.ingest_buckets(t.ingest_requests(spark, d), AT, DAY),
    "ingest_requests", BUCKETS + " SELECT * FROM i1",
)
register(
    "i2_ingest_totals",
    lambda spark, d: ops.ingest_totals(t.ingest_requests(spark, d), "2024-01-20 12:07:30", DAY),
    "ingest_requests",
    """+w AS (SELECT *, ReceivedAt >= TIMESTAMP '2024-01-20 12:07:00' AS live FROM ingest_requests WHERE
      ReceivedAt >= TIMESTAMP '2024-01-20 12:07:00' - INTERVAL 1439 MINUTES AND ReceivedAt < TIMESTAMP '2024-01-20 12:08:00')
    SELECT count(*) FILTER (live AND NOT Rejected) AS ArrivalsThisMinute,
    CAST(coalesce(sum(Records) FILTER (live AND NOT Rejected),0) AS BIGINT) AS RecordsThisMinute,
    CAST(coalesce(sum(Bytes) FILTER (live AND NOT Rejected),0) AS BIGINT) AS BytesThisMinute,
    count(*) FILTER (NOT Rejected) AS RequestsInWindow, count(*) FILTER (Rejected) AS RejectedInWindow FROM w""",
)
register(
    "i3_receiver_status",
    lambda spark, d: ops.receiver_status(t.ingest_requests(spark, d), AT, DAY),
    "ingest_requests",
    f"""+n AS (SELECT Protocol, count(*) FILTER (NOT Rejected) AS a, count(*) FILTER (Rejected) AS b FROM ingest_requests
      WHERE {WINDOW} GROUP BY 1), x AS (SELECT Protocol, coalesce(a,0) AS Requests, coalesce(b,0) AS Rejected FROM {PROTOCOL_LIST} p LEFT JOIN n USING (Protocol))
    SELECT *, CASE WHEN Requests=0 THEN 'idle' WHEN Rejected=0 THEN 'healthy' WHEN Rejected>=Requests THEN 'down' ELSE 'degraded' END AS Status FROM x""",
)
register(
    "i4_recent_rejections",
    lambda spark, d: ops.recent_rejections(t.ingest_requests(spark, d)),
    "ingest_requests",
    """SELECT RequestId, ReceivedAt, Signal, Protocol, Reason FROM ingest_requests WHERE Rejected
    ORDER BY ReceivedAt DESC, RequestId DESC LIMIT 200""",
)


def _shared_requests(spark, d):
    """Six consecutive requests as one export that carries several services."""
    parts = t.ingest_requests(spark, d).withColumn("RequestId", F.call_function("div", F.col("RequestId"), F.lit(6)))
    totals = parts.groupBy("RequestId").agg(F.sum("Bytes").alias("Bytes"))
    return parts.drop("Bytes").join(totals, "RequestId")


SHARES = """+q AS (SELECT RequestId // 6 AS RequestId, CASE WHEN ServiceName='' THEN 'unknown_service' ELSE ServiceName END AS ServiceName,
      Records, sum(Bytes) OVER (PARTITION BY RequestId // 6) AS b FROM ingest_requests),
    p AS (SELECT RequestId, ServiceName, sum(Records) AS r, max(b) AS b FROM q GROUP BY 1,2),
    shares AS (SELECT RequestId, ServiceName, CAST(r AS BIGINT) AS Records, CAST(CASE WHEN sum(r) OVER (PARTITION BY RequestId)=0 THEN 0
      ELSE (b * r) // sum(r) OVER (PARTITION BY RequestId) END AS BIGINT) AS Bytes FROM p)"""
register(
    "i5_service_share",
    lambda spark, d: ops.service_share(_shared_requests(spark, d)),
    "ingest_requests", SHARES + " SELECT * FROM shares",
)
register(
    "i6_top_services",
    lambda spark, d: ops.top_services(
        t.ingest_requests(spark, d).where(~F.col("Rejected")).select("Signal", "ServiceName", "Records", "Bytes")
    ),
    "ingest_requests",
    """+s AS (SELECT Signal, ServiceName, CAST(sum(Records) AS BIGINT) AS r, CAST(sum(Bytes) AS BIGINT) AS b FROM ingest_requests
      WHERE NOT Rejected GROUP BY 1,2),
    k AS (SELECT *, CAST(row_number() OVER (PARTITION BY Signal ORDER BY r DESC, ServiceName) AS INT) AS n FROM s)
    SELECT Signal, CASE WHEN n<=5 THEN ServiceName ELSE 'other' END AS ServiceName, CASE WHEN n<=5 THEN n END AS Rank,
    count(*) AS Services, CAST(sum(r) AS BIGINT) AS Records, CAST(sum(b) AS BIGINT) AS Bytes FROM k GROUP BY 1,2,3""",
)
HEALTH = f"""+ok AS (SELECT Signal, max(row(FlushedAt, FlushId)) AS k, arg_max(BatchSize, row(FlushedAt, FlushId)) AS size, max(FlushedAt) AS at
      FROM flush_log WHERE NOT Failed GROUP BY 1),
    er AS (SELECT f.Signal, max(f.FlushedAt) AS at, arg_max(f.Error, row(f.FlushedAt, f.FlushId)) AS e,
      count(*) FILTER (ok.k IS NULL OR row(f.FlushedAt, f.FlushId) > ok.k) AS n FROM flush_log f LEFT JOIN ok USING (Signal) WHERE Failed GROUP BY 1),
    health AS (SELECT Signal, ok.at AS LastFlushAt, ok.size AS LastBatchSize, er.at AS LastErrorAt, er.e AS LastError,
      coalesce(er.n, 0) AS ConsecutiveErrors FROM {SIGNAL_LIST} s LEFT JOIN ok USING (Signal) LEFT JOIN er USING (Signal))"""
register(
    "i7_flush_health",
    lambda spark, d: ops.flush_health(t.flush_log(spark, d)),
    "flush_log", HEALTH + " SELECT * FROM health",
)
END = "2024-01-31 00:00:00"


def _backlog_sql(now, capacity):
    return f"""+a AS (SELECT Signal, ReceivedAt, Records, sum(Records) OVER (PARTITION BY Signal ORDER BY ReceivedAt, RequestId
        ROWS UNBOUNDED PRECEDING) AS upto FROM ingest_requests WHERE NOT Rejected AND ReceivedAt < TIMESTAMP '{now}'),
    fl AS (SELECT Signal, sum(BatchSize) AS f FROM flush_log WHERE NOT Failed AND FlushedAt < TIMESTAMP '{now}' GROUP BY 1),
    pg AS (SELECT Signal, sum(Records) AS arrived, max(coalesce(f,0)) AS f, min(ReceivedAt) FILTER (upto > coalesce(f,0)) AS o
      FROM a LEFT JOIN fl USING (Signal) GROUP BY 1),
    backlog AS (SELECT Signal, arrived IS NOT NULL AS Available, CAST(coalesce(greatest(0, arrived - f),0) AS BIGINT) AS Length,
      CAST({capacity} AS BIGINT) AS Capacity, epoch_us(TIMESTAMP '{now}' - o)/1000000.0 AS OldestPendingAgeSeconds,
      CAST(coalesce(greatest(0, arrived - f),0) AS BIGINT) AS Pending,
      CAST(floor(coalesce(greatest(0, arrived - f),0)/{capacity}*100 + 0.5) AS BIGINT) AS UtilizationPercent
      FROM {SIGNAL_LIST} s LEFT JOIN pg USING (Signal))"""


CAPACITY = 12_000
register(
    "i9_stream_backlog",
    lambda spark, d: ops.stream_backlog(t.ingest_requests(spark, d), t.flush_log(spark, d), END, CAPACITY),
    "ingest_requests flush_log", _backlog_sql(END, CAPACITY) + " SELECT * FROM backlog",
)


def _state(spark, d):
    requests, flushes = t.ingest_requests(spark, d), t.flush_log(spark, d)
    health, backlog = ops.flush_health(flushes), ops.stream_backlog(requests, flushes, END, CAPACITY)
    return health, backlog, ops.ingest_buckets(requests, END, 60)


STATE = (HEALTH + ", " + _backlog_sql(END, CAPACITY)[1:] + ", " + buckets_sql(60, f"TIMESTAMP '{END}'")[1:]
         + f""", tr AS (SELECT Signal, bool_or(Records > 0 AND BucketStart >= TIMESTAMP '{END}' - INTERVAL 3 MINUTES) AS HasTraffic FROM i1 GROUP BY 1),
    st AS (SELECT *, Pending > 0 AND coalesce(OldestPendingAgeSeconds,0) >= 300 AS stuck, HasTraffic AND (LastFlushAt IS NULL
      OR epoch_us(TIMESTAMP '{END}' - LastFlushAt)/1000000.0 >= 60) AS stale FROM health JOIN backlog USING (Signal) JOIN tr USING (Signal))""")
register(
    "i8_flush_status",
    lambda spark, d: ops.flush_status(*_state(spark, d), END),
    "ingest_requests flush_log",
    STATE + """ SELECT Signal, CASE WHEN ConsecutiveErrors >= 3 THEN 'down' WHEN ConsecutiveErrors > 0 THEN 'retrying'
    WHEN stuck THEN 'stuck' WHEN stale THEN 'stale' WHEN coalesce(LastError,'')<>'' THEN 'recovered'
    WHEN LastFlushAt IS NULL THEN 'idle' ELSE 'healthy' END AS Status, ConsecutiveErrors FROM st""",
)
register(
    "i10_ingest_verdict",
    lambda spark, d: ops.ingest_verdict(
        *_state(spark, d), ops.ingest_totals(t.ingest_requests(spark, d), END, 60), END
    ),
    "ingest_requests flush_log",
    STATE + f""", o AS (SELECT *, list_position(['Logs','Traces','Metrics'], Signal) AS o FROM st),
    dn AS (SELECT 0 AS stage, o, CASE WHEN ConsecutiveErrors >= 3 THEN concat(Signal, ' exporter unavailable') END AS txt FROM o
      UNION ALL SELECT 1, o, CASE WHEN NOT Available THEN NULL WHEN ConsecutiveErrors >= 3 THEN CASE WHEN Length > 0 THEN concat(Length, ' buffered (', UtilizationPercent, '%)') END
      WHEN UtilizationPercent >= 90 THEN concat(Signal, ' buffer at ', UtilizationPercent, '% capacity, oldest entries at risk of being dropped')
      WHEN stuck THEN concat(Signal, ' pipeline backlog stuck (', Pending, ' pending)') END FROM o),
    dg AS (SELECT 0 AS stage, o, CASE WHEN ConsecutiveErrors BETWEEN 1 AND 2 THEN concat(Signal, ' flush retrying (', ConsecutiveErrors, ' errors)')
      WHEN ConsecutiveErrors = 0 AND stale THEN concat(Signal, ' flush stale (',
        CASE WHEN LastFlushAt IS NULL THEN 'Infinityh ago'
          WHEN epoch_us(TIMESTAMP '{END}' - LastFlushAt) < 3600000000 THEN concat(epoch_us(TIMESTAMP '{END}' - LastFlushAt) // 60000000, 'm ago')
          ELSE concat(epoch_us(TIMESTAMP '{END}' - LastFlushAt) // 3600000000, 'h ago') END, ' since last flush, still receiving traffic)') END AS txt FROM o
      UNION ALL SELECT 1, o, CASE WHEN NOT Available OR ConsecutiveErrors >= 3 OR UtilizationPercent >= 90 OR stuck OR (ConsecutiveErrors = 0 AND stale) THEN NULL
      WHEN UtilizationPercent >= 70 THEN concat(Signal, ' buffer at ', UtilizationPercent, '% capacity')
      WHEN Pending > 0 THEN concat(Signal, ' backlog building (', Length, ' buffered)') END FROM o),
    tt AS (SELECT sum(Requests) AS q, sum(Rejected) AS j FROM i1),
    al AS (SELECT 0 AS g, stage, o, txt FROM dn UNION ALL SELECT 1, stage, o, txt FROM dg
      UNION ALL SELECT 1, 2, 0, CASE WHEN j > 0 THEN concat(CAST(floor(coalesce(j/nullif(q,0),0)*100+0.5) AS BIGINT), '% rejected (', CAST(j AS BIGINT), ')') END FROM tt),
    rn AS (SELECT *, row_number() OVER (ORDER BY g, stage, o) AS r FROM al WHERE txt IS NOT NULL)
    SELECT CASE WHEN count(*) FILTER (g=0) > 0 THEN 'down' WHEN count(*) > 0 THEN 'degraded' ELSE 'healthy' END AS Level,
    coalesce(string_agg(txt, ' · ' ORDER BY r) FILTER (r <= 2), 'All receivers operational · 0% rejected · no pipeline backlog') AS Detail FROM rn""",
)
register(
    "j6_dense_grid",
    lambda spark, d: ops.fill_grid(
        ops.dense_grid(spark, AT, 120),
        t.ingest_requests(spark, d).groupBy(
            F.window("ReceivedAt", "60 seconds").getField("start").alias("BucketStart"), "Signal", "Protocol"
        ).agg(F.count(F.lit(1)).alias("n")),
        ["BucketStart", "Signal", "Protocol"],
    ),
    "ingest_requests",
    f"""+g AS (SELECT {CURRENT} - to_minutes(CAST(m AS INT)) AS BucketStart, Signal, Protocol
      FROM range(0, 120) r(m), {SIGNAL_LIST} s, {PROTOCOL_LIST} p)
    SELECT g.BucketStart, g.Signal, g.Protocol, count(q.RequestId) AS n FROM g LEFT JOIN ingest_requests q
    ON time_bucket(INTERVAL 1 MINUTE, q.ReceivedAt)=g.BucketStart AND q.Signal=g.Signal AND q.Protocol=g.Protocol GROUP BY 1,2,3""",
)
