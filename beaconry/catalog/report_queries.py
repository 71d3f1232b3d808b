"""Registered queries over table files, growth and query latency."""

from pyspark.sql import functions as F

from beaconry.catalog import tables as t
from beaconry.catalog.tables import NOW, oracle
from beaconry.operators import reports as ops

QUERIES, ORACLES = {}, {}
STORED = {"logs": "events", "spans": "orders", "metrics_gauge": "lineitem", "metrics_sum": "customer", "metrics_histogram": "part"}


def register(name, build, tables=None, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = oracle(tables, sql)


def _files(spark, d):
    return ops.table_files(spark, {name: f"{d}/{table}.parquet" for name, table in STORED.items()})


COUNTS = " UNION ALL ".join(f"SELECT '{n}' AS TableName, count(*) AS Rows FROM {s}" for n, s in STORED.items())
register(
    "r1_table_storage",
    lambda spark, d: ops.table_storage(_files(spark, d)).select("TableName", "Rows", "Files", "Fragmented"),
    "", f"SELECT TableName, Rows, CAST(1 AS BIGINT) AS Files, false AS Fragmented FROM ({COUNTS})",
)
register("r1_table_bytes", lambda spark, d: ops.table_storage(_files(spark, d)))
def growth(spark, d):
    """Each day's events as files of the table their type stands for."""
    table = F.create_map(*map(F.lit, (
        "click", "logs", "view", "spans", "error", "metrics_gauge", "purchase", "metrics_sum", "signup", "metrics_histogram",
    )))[F.col("event_type")]
    return t.read(spark, d, "events").groupBy(F.to_date("ts").alias("Day"), table.alias("TableName")).agg(
        F.sum(F.length("props") * F.col("user_id")).alias("Bytes"), F.count(F.lit(1)).alias("Rows")
    )


def event_files(spark, d):
    """Every event as a file of the table its type stands for, written when it happened."""
    return t.read(spark, d, "events").select(
        F.col("event_type").alias("TableName"), F.col("event_id").cast("string").alias("File"),
        (F.length("props") * F.col("user_id")).cast("bigint").alias("Bytes"), F.col("ts").cast("timestamp").alias("Modified"), F.col("user_id").cast("bigint").alias("Rows"))


# The real files of the tables cannot be dated by SQL, so growth is checked on files made from events.
register(
    "r2_storage_growth",
    lambda spark, d: ops.storage_growth(event_files(spark, d), "2024-01-25 06:00:00", 10),
    "", """SELECT CAST(ts AS DATE) AS Day, event_type AS TableName, CAST(sum(length(props)*user_id) AS BIGINT) AS Bytes, CAST(sum(user_id) AS BIGINT) AS Rows
    FROM events WHERE ts >= TIMESTAMP '2024-01-25 06:00:00' - INTERVAL 10 DAY GROUP BY 1,2""",
)
register("r2_storage_growth_of_files", lambda spark, d: ops.storage_growth(_files(spark, d), days=36_500))


GROWTH = """WITH gr AS (SELECT CAST(ts AS DATE) AS Day, CASE event_type WHEN 'click' THEN 'logs' WHEN 'view' THEN 'spans'
    WHEN 'error' THEN 'metrics_gauge' WHEN 'purchase' THEN 'metrics_sum' WHEN 'signup' THEN 'metrics_histogram' END AS TableName,
    sum(length(props)*user_id) AS Bytes, count(*) AS Rows FROM events GROUP BY 1,2),
    dd AS (SELECT DISTINCT Day FROM gr ORDER BY Day DESC LIMIT 7), wd AS (SELECT * FROM gr WHERE Day IN (SELECT Day FROM dd)),
    sg AS (SELECT * FROM (VALUES ('total','%'), ('logs','logs'), ('traces','spans'), ('metrics','metrics~_%')) v(Signal, pat)),
    av AS (SELECT Signal, coalesce(sum(Bytes),0)/(SELECT count(*) FROM dd) AS BytesPerDay,
      coalesce(sum(Rows),0)/(SELECT count(*) FROM dd) AS RowsPerDay, (SELECT count(*) FROM dd) AS WindowDays
      FROM sg LEFT JOIN wd ON wd.TableName LIKE pat ESCAPE '~' GROUP BY 1)"""
register(
    "r3_avg_daily_growth",
    lambda spark, d: ops.avg_daily_growth(growth(spark, d)).select(
        "Signal", F.round("BytesPerDay", 6).alias("BytesPerDay"), F.round("RowsPerDay", 6).alias("RowsPerDay"), "WindowDays"),
    "", GROWTH + " SELECT Signal, round(BytesPerDay,6) AS BytesPerDay, round(RowsPerDay,6) AS RowsPerDay, WindowDays FROM av",
)


def _storage(spark, d):
    totals = growth(spark, d).groupBy("TableName").agg(F.sum("Rows").alias("Rows"), F.sum("Bytes").alias("Bytes"))
    return totals.withColumns({
        "Fragmented": F.col("Rows") >= F.lit(150), "UncompressedBytes": F.col("Bytes") + F.col("Rows") * 1000,
    })


register(
    "r4_storage_checks",
    lambda spark, d: ops.storage_checks(_storage(spark, d), growth(spark, d)).withColumn("Value", F.round("Value", 6)),
    "",
    GROWTH + """, st AS (SELECT TableName, CAST(sum(Rows) AS BIGINT) AS r, sum(Bytes) AS b FROM gr GROUP BY 1),
    f AS (SELECT sum(b) AS b, sum(b + r*1000) AS u, sum(r) AS r, count(*) FILTER (r >= 150) AS n,
      coalesce(string_agg(CASE WHEN r >= 150 THEN TableName END, ', ' ORDER BY TableName), '') AS names, max(r) AS m FROM st),
    k AS (SELECT TableName AS largest FROM st ORDER BY r DESC, TableName LIMIT 1),
    s3 AS (SELECT count(*) FILTER (BytesPerDay > 0) AS g, max(BytesPerDay) AS hi, min(BytesPerDay) AS lo FROM av WHERE Signal<>'total'),
    fs AS (SELECT Signal AS fastest FROM av WHERE Signal<>'total' ORDER BY BytesPerDay DESC, Signal LIMIT 1)
    SELECT 'compression' AS "Check", CASE WHEN u/b < 2 THEN 'warning' ELSE 'good' END AS Tone, round(u/b,6) AS Value, '' AS Subject FROM f
    UNION ALL SELECT 'parts', CASE WHEN n > 0 THEN 'warning' ELSE 'good' END, n::DOUBLE, names FROM f
    UNION ALL SELECT 'row-concentration', CASE WHEN m/r*100 >= 70 THEN 'warning' ELSE 'good' END, round(m/r*100,6), largest FROM f, k
    UNION ALL SELECT 'growth-skew', CASE WHEN g >= 2 AND (lo <= 0 OR hi/lo >= 3) THEN 'warning' ELSE 'good' END,
      CASE WHEN g >= 2 THEN round(hi/nullif(lo,0),6) END, fastest FROM s3, fs""",
)
LATENCY = """SELECT {0}, count(*) FILTER (DurationMs > 500) AS SlowCount, count(*) AS SampleCount FROM query_log WHERE {1}"""
QUANTILE_SQL = ", ".join(f"round(quantile_cont(DurationMs, {q}), 6) AS {n}" for n, q in ops.QUANTILES.items())
register(
    "r5_query_latency",
    lambda spark, d: ops.query_latency(t.query_log(spark, d), NOW, 31 * 1440).select(
        *[F.round(n, 6).alias(n) for n in ops.QUANTILES], "SlowCount", "SampleCount"),
    "query_log", LATENCY.format(QUANTILE_SQL, "EventTime <= TIMESTAMP '2024-01-31'"),
)
register(
    "r5_query_latency_hour",
    lambda spark, d: ops.query_latency(t.query_log(spark, d), "2024-01-20 12:00:00").select(
        *[F.round(n, 6).alias(n) for n in ops.QUANTILES], "SlowCount", "SampleCount"),
    "query_log", LATENCY.format(QUANTILE_SQL, "EventTime BETWEEN TIMESTAMP '2024-01-20 11:00:00' AND TIMESTAMP '2024-01-20 12:00:00'"),
)
