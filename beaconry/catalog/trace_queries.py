"""Registered queries over traces."""

from pyspark.sql import functions as F

from beaconry.catalog import tables as t
from beaconry.catalog.tables import oracle
from beaconry.operators import traces as ops

QUERIES, ORACLES = {}, {}


def register(name, build, tables=None, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = oracle(tables, sql)


EFFECTIVE = """CASE WHEN coalesce({0}.SpanAttributes['peer.service'],'')<>'' THEN {0}.SpanAttributes['peer.service']
    WHEN coalesce({0}.ServiceName,'')<>'' THEN {0}.ServiceName ELSE 'unknown' END"""

register(
    "j3_parent_child",
    lambda spark, d: ops.parent_child(t.spans(spark, d)).select(
        "TraceId", "SpanId", "ParentSpanId", "IsRoot", "ParentService", "ParentName"
    ),
    "spans",
    """SELECT c.TraceId, c.SpanId, c.ParentSpanId, p.SpanId IS NULL AS IsRoot, p.ServiceName AS ParentService,
    p.Name AS ParentName FROM spans c LEFT JOIN spans p ON c.TraceId=p.TraceId AND c.ParentSpanId=p.SpanId""",
)
register(
    "t1_trace_summary",
    lambda spark, d: ops.trace_summary(t.spans(spark, d)),
    "spans",
    """SELECT TraceId, min(StartTime) AS StartTime, max(EndTime) AS EndTime, count(*) AS SpanCount,
    count(*) FILTER (StatusCode='STATUS_CODE_ERROR') AS ErrorCount,
    greatest(1.0, epoch_us(max(EndTime)-min(StartTime))/1000.0) AS TotalMs FROM spans GROUP BY 1""",
)
register(
    "t2_trace_waterfall",
    lambda spark, d: ops.trace_waterfall(t.spans(spark, d)),
    "spans",
    """+r AS (SELECT s.*, p.SpanId IS NULL AS root, strftime(s.StartTime, '%Y%m%d%H%M%S.%f') || s.SpanId AS step
      FROM spans s LEFT JOIN spans p ON s.TraceId=p.TraceId AND s.ParentSpanId=p.SpanId),
    w AS (WITH RECURSIVE x AS (SELECT TraceId, SpanId, ParentSpanId, 0 AS Depth, step AS path FROM r WHERE root
      UNION ALL SELECT r.TraceId, r.SpanId, r.ParentSpanId, x.Depth + 1, x.path || '/' || r.step
      FROM r JOIN x ON r.TraceId=x.TraceId AND r.ParentSpanId=x.SpanId) SELECT * FROM x)
    SELECT TraceId, SpanId, ParentSpanId, Depth, row_number() OVER (PARTITION BY TraceId ORDER BY path) - 1 AS Ordinal FROM w""",
)
# Children latest end first; the smallest start of the children before one is the cursor it meets.
register(
    "t3_critical_path",
    lambda spark, d: ops.critical_path(t.spans(spark, d)),
    "spans",
    """+b AS (SELECT TraceId, SpanId, ParentSpanId, epoch_us(StartTime) AS s, epoch_us(EndTime) AS e FROM spans),
    r AS (SELECT c.*, p.SpanId IS NULL AS root FROM b c LEFT JOIN b p ON c.TraceId=p.TraceId AND c.ParentSpanId=p.SpanId),
    top AS (SELECT *, row_number() OVER (PARTITION BY TraceId ORDER BY e DESC, s, SpanId) AS n FROM r WHERE root),
    v AS (WITH RECURSIVE x AS (
        SELECT TraceId, SpanId, '' AS Parent, s, e, e AS c, e AS until FROM top WHERE n=1
        UNION ALL SELECT * FROM (
            SELECT TraceId, SpanId, Parent, s, e, c, least(e, c) AS until FROM (
                SELECT k.TraceId, k.SpanId, x.SpanId AS Parent, k.s, k.e, least(x.until, coalesce(min(k.s) OVER (
                    PARTITION BY k.TraceId, x.SpanId ORDER BY k.e DESC, k.s, k.SpanId ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x.until)) AS c
                FROM r k JOIN x ON k.TraceId=x.TraceId AND k.ParentSpanId=x.SpanId WHERE k.e > k.s AND NOT k.root) y) z
        WHERE until > s) SELECT * FROM x),
    gaps AS (SELECT TraceId, Parent, sum(c - until) AS g, min(s) AS low FROM v WHERE Parent<>'' GROUP BY 1,2),
    share AS (SELECT v.TraceId, v.SpanId, v.s, coalesce(g, 0) + greatest(0, least(v.until, coalesce(low, v.until)) - v.s) AS us
        FROM v LEFT JOIN gaps ON gaps.TraceId=v.TraceId AND gaps.Parent=v.SpanId)
    SELECT share.TraceId, share.SpanId, top.SpanId AS RootSpanId, top.e - top.s AS RootDurationUs, CAST(us AS BIGINT) AS ContributionUs,
    row_number() OVER (PARTITION BY share.TraceId ORDER BY us DESC, share.s, share.SpanId) = 1 AS IsTop
    FROM share JOIN top ON top.TraceId=share.TraceId AND top.n=1 WHERE us > 0""",
)
# Contributions of a trace always add up to its root's duration (children start later here).
register(
    "t3_critical_path_totals",
    lambda spark, d: ops.critical_path(t.spans(spark, d)).groupBy("TraceId").agg(
        F.sum("ContributionUs").alias("TotalUs"), F.max("RootSpanId").alias("RootSpanId"),
        F.count_if("IsTop").alias("Tops"),
    ),
    "spans",
    """SELECT TraceId, max(DurationNano // 1000) AS TotalUs, max(SpanId) AS RootSpanId, CAST(1 AS BIGINT) AS Tops FROM spans
    WHERE ParentSpanId='' AND DurationNano > 0 GROUP BY 1""",
)
register(
    "t4_service_nodes",
    lambda spark, d: ops.service_nodes(t.spans(spark, d)).withColumn("Operations", F.array_join("Operations", ",")),
    "spans",
    f"""SELECT {EFFECTIVE.format('s')} AS Service, count(*) AS SpanCount,
    count(*) FILTER (StatusCode='STATUS_CODE_ERROR') AS ErrorCount, CAST(sum(DurationNano) AS BIGINT) AS TotalDurationNano,
    string_agg(DISTINCT Name, ',' ORDER BY Name) AS Operations FROM spans s GROUP BY 1""",
)
register(
    "t4_service_nodes_by_trace",
    lambda spark, d: ops.service_nodes(t.spans(spark, d), by_trace=True).withColumn("Operations", F.array_join("Operations", ",")),
    "spans",
    f"""SELECT TraceId, {EFFECTIVE.format('s')} AS Service, count(*) AS SpanCount,
    count(*) FILTER (StatusCode='STATUS_CODE_ERROR') AS ErrorCount, CAST(sum(DurationNano) AS BIGINT) AS TotalDurationNano,
    string_agg(DISTINCT Name, ',' ORDER BY Name) AS Operations FROM spans s GROUP BY 1,2""",
)
EDGES = f"""+x AS (SELECT c.TraceId, {EFFECTIVE.format('p')} AS Source, {EFFECTIVE.format('c')} AS Target, c.DurationNano
    FROM spans c JOIN spans p ON c.TraceId=p.TraceId AND c.ParentSpanId=p.SpanId)"""
register(
    "t5_service_edges",
    lambda spark, d: ops.service_edges(t.spans(spark, d)),
    "spans",
    EDGES + """ SELECT Source, Target, count(*) AS CallCount, CAST(sum(DurationNano) AS BIGINT) AS TotalDurationNano
    FROM x WHERE Source<>Target GROUP BY 1,2""",
)
register(
    "t5_service_edges_by_trace",
    lambda spark, d: ops.service_edges(t.spans(spark, d), by_trace=True),
    "spans",
    EDGES + """ SELECT TraceId, Source, Target, count(*) AS CallCount, CAST(sum(DurationNano) AS BIGINT) AS TotalDurationNano
    FROM x WHERE Source<>Target GROUP BY 1,2,3""",
)
