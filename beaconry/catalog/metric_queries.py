"""Registered queries over metric points."""

from pyspark.sql import functions as F

from beaconry.catalog import tables as t
from beaconry.catalog.tables import oracle
from beaconry.functions.histograms import histogram_max, histogram_mean
from beaconry.operators import filters, metrics as ops

QUERIES, ORACLES = {}, {}
WEEK = 7 * 86_400
PERIOD = dict(frm="2024-01-15", to="2024-01-22")
BEFORE = dict(frm="2024-01-08", to="2024-01-15")


def register(name, build, tables=None, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = oracle(tables, sql)


def fill(sql, **values):
    for name, value in values.items():
        sql = sql.replace(f"<{name}>", value)
    return sql


def in_range(p):
    return f"Time >= TIMESTAMP '{p['frm']}' AND Time < TIMESTAMP '{p['to']}'"


GAUGE_KEY = """concat('{"k10":"', DataPointAttributes['k10'], '","region":"', DataPointAttributes['region'], '"}')"""
TYPE_KEY = """concat('{"event_type":"', DataPointAttributes['event_type'], '"}')"""

register(
    "e9_metric_names",
    lambda spark, d: ops.metric_names(t.gauge(spark, d), t.sums(spark, d), t.histogram(spark, d)),
    "gauge sums histogram",
    " UNION ALL ".join(
        f"""SELECT MetricName, ServiceName, '{kind}' AS Type, min(Unit) AS Unit, min(Description) AS Description,
        count(DISTINCT CAST(DataPointAttributes AS VARCHAR)) AS SeriesCount FROM {table} GROUP BY 1,2"""
        for kind, table in (("gauge", "gauge"), ("sum", "sums"), ("histogram", "histogram"))
    ),
)
register(
    "e10_metric_attribute_keys",
    lambda spark, d: ops.metric_attribute_keys(t.gauge(spark, d), "app.view"),
    "gauge",
    """SELECT e.key AS Key, count(DISTINCT e.value) AS DistinctValueCount FROM
    (SELECT unnest(map_entries(DataPointAttributes)) AS e FROM gauge WHERE MetricName='app.view') GROUP BY 1""",
)
register(
    "e11_gauge_series",
    lambda spark, d: ops.gauge_series(t.gauge(spark, d), "app.click", 3600)
    .select("BucketStart", "ServiceName", "SeriesKey", F.round("Value", 6).alias("Value")),
    "gauge",
    f"""SELECT time_bucket(INTERVAL 3600 SECONDS, Time) AS BucketStart, ServiceName, {GAUGE_KEY} AS SeriesKey,
    round(avg(Value),6) AS Value FROM gauge WHERE MetricName='app.click' GROUP BY 1,2,3""",
)
register(
    "e12_sum_series",
    lambda spark, d: ops.sum_series(t.sums(spark, d), "app.total", 3600)
    .select("BucketStart", "ServiceName", "SeriesKey", "Value", "Count"),
    "sums",
    f"""SELECT time_bucket(INTERVAL 3600 SECONDS, Time) AS BucketStart, ServiceName, {TYPE_KEY} AS SeriesKey,
    max(Value)-min(Value) AS Value, count(*) AS Count FROM sums WHERE MetricName='app.total' GROUP BY 1,2,3""",
)
register(
    "e12_sum_series_reset_aware",
    lambda spark, d: ops.sum_series(t.sums(spark, d), "app.total", 86_400, reset_aware=True)
    .select("BucketStart", "ServiceName", "SeriesKey", "Value", "Count"),
    "sums",
    f"""+p AS (SELECT Time, ServiceName, {TYPE_KEY} AS SeriesKey, Value,
      lag(Value) OVER (PARTITION BY ServiceName, DataPointAttributes['event_type'] ORDER BY Time, Value) AS pv FROM sums)
    SELECT time_bucket(INTERVAL 86400 SECONDS, Time) AS BucketStart, ServiceName, SeriesKey,
    sum(CASE WHEN pv IS NULL THEN 0 WHEN Value < pv THEN Value ELSE Value - pv END) AS Value, count(*) AS Count
    FROM p GROUP BY 1,2,3""",
)
TEXT = lambda c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",")
HIST_SQL = f"""+h AS (SELECT time_bucket(INTERVAL 86400 SECONDS, Time) AS BucketStart, ServiceName, <key> AS SeriesKey,
    CAST(sum(Count) AS BIGINT) AS Count, round(sum(Sum),6) AS Sum,
    {', '.join(f'CAST(sum(BucketCounts[{i + 1}]) AS BIGINT) AS c{i}' for i in range(5))}
    FROM histogram WHERE MetricName='app.latency' <where> GROUP BY 1,2,3)"""
register(
    "e13_histogram_series",
    lambda spark, d: ops.histogram_series(t.histogram(spark, d), "app.latency", 86_400)
    .select("BucketStart", "ServiceName", "SeriesKey", "Count", F.round("Sum", 6).alias("Sum"),
            TEXT("BucketCounts").alias("BucketCounts"), TEXT("ExplicitBounds").alias("ExplicitBounds")),
    "histogram",
    fill(HIST_SQL, key=TYPE_KEY, where="") + """ SELECT BucketStart, ServiceName, SeriesKey, Count, Sum,
    concat_ws(',', c0, c1, c2, c3, c4) AS BucketCounts, '5,10,50,100' AS ExplicitBounds FROM h""",
)
register(
    "e14_series_key_grouped",
    lambda spark, d: ops.gauge_series(t.gauge(spark, d), "app.error", 21_600, "region")
    .select("BucketStart", "ServiceName", "SeriesKey", F.to_json("SeriesAttributes").alias("SeriesAttributes"),
            F.round("Value", 6).alias("Value"))
    .unionByName(
        ops.gauge_series(t.gauge(spark, d), "app.error", 21_600, "absent")
        .select("BucketStart", "ServiceName", "SeriesKey", F.to_json("SeriesAttributes").alias("SeriesAttributes"),
                F.round("Value", 6).alias("Value"))
    ),
    "gauge",
    """SELECT time_bucket(INTERVAL 21600 SECONDS, Time) AS BucketStart, ServiceName, DataPointAttributes['region'] AS SeriesKey,
    concat('{"region":"', DataPointAttributes['region'], '"}') AS SeriesAttributes, round(avg(Value),6) AS Value
    FROM gauge WHERE MetricName='app.error' GROUP BY 1,2,3,4 UNION ALL
    SELECT time_bucket(INTERVAL 21600 SECONDS, Time), ServiceName, '', '{"absent":""}', round(avg(Value),6)
    FROM gauge WHERE MetricName='app.error' GROUP BY 1,2""",
)


def _quantile_sql(q):
    """Piecewise form of the interpolation for the fixture's five buckets 5,10,50,100."""
    edges = [(5, 5), (5, 10), (10, 50), (50, 100), (100, 100)]
    total, cases, cum = "(c0+c1+c2+c3+c4)", [], "0"
    for i, (low, high) in enumerate(edges):
        after = f"({cum}+c{i})"
        cases.append(
            f"WHEN {after} >= {q}::DOUBLE*{total} THEN CASE WHEN c{i}=0 THEN {high}::DOUBLE ELSE "
            f"{low} + ({q}::DOUBLE*{total} - {cum})/c{i}*({high}-{low}) END"
        )
        cum = after
    return f"CASE WHEN {total}=0 THEN NULL {' '.join(cases)} ELSE 100 END"


register(
    "e15_histogram_quantile",
    lambda spark, d: ops.with_histogram_estimates(ops.histogram_series(t.histogram(spark, d), "app.latency", 86_400))
    .select("BucketStart", "ServiceName", "SeriesKey", *[F.round(p, 6).alias(p) for p in ops.QUANTILES]),
    "histogram",
    fill(HIST_SQL, key=TYPE_KEY, where="") + f""" SELECT BucketStart, ServiceName, SeriesKey,
    {', '.join(f'round({_quantile_sql(q)}, 6) AS {p}' for p, q in ops.QUANTILES.items())} FROM h""",
)
MAX_SQL = """CASE WHEN c4>0 THEN 100.0 WHEN c3>0 THEN 100.0 WHEN c2>0 THEN 50.0 WHEN c1>0 THEN 10.0
    WHEN c0>0 THEN 5.0 END::DOUBLE"""
register(
    "e16_histogram_max",
    lambda spark, d: ops.histogram_series(t.histogram(spark, d), "app.latency", 3600)
    .select("BucketStart", "ServiceName", "SeriesKey", histogram_max("BucketCounts", "ExplicitBounds").alias("MaxApprox")),
    "histogram",
    fill(HIST_SQL, key=TYPE_KEY, where="").replace("86400", "3600")
    + f" SELECT BucketStart, ServiceName, SeriesKey, {MAX_SQL} AS MaxApprox FROM h",
)
register(
    "e17_histogram_mean",
    lambda spark, d: ops.histogram_series(t.histogram(spark, d), "app.latency", 86_400, "event_type")
    .select("BucketStart", "ServiceName", "SeriesKey", F.round(histogram_mean("Sum", "Count"), 6).alias("Mean")),
    "histogram",
    fill(HIST_SQL, key="DataPointAttributes['event_type']", where="")
    + " SELECT BucketStart, ServiceName, SeriesKey, round(Sum/Count, 6) AS Mean FROM h WHERE Count > 0",
)
SUM_SQL = f"""+s AS (SELECT time_bucket(INTERVAL 3600 SECONDS, Time) AS BucketStart, ServiceName, {TYPE_KEY} AS SeriesKey,
    max(Value)-min(Value) AS Value FROM sums WHERE MetricName='app.total' <where> GROUP BY 1,2,3)"""
register(
    "e18_sum_rate",
    lambda spark, d: ops.sum_rate(ops.sum_series(t.sums(spark, d), "app.total", 3600), 3600)
    .select("BucketStart", "ServiceName", "SeriesKey", F.round("Rate", 6).alias("Rate")),
    "sums", fill(SUM_SQL, where="") + " SELECT BucketStart, ServiceName, SeriesKey, round(Value/3600, 6) AS Rate FROM s",
)
register(
    "e19_bucket_totals",
    lambda spark, d: ops.bucket_totals(ops.sum_series(t.sums(spark, d), "app.total", 3600)),
    "sums", fill(SUM_SQL, where="") + " SELECT BucketStart, sum(Value) AS Value FROM s GROUP BY 1",
)


def _sum_period(spark, d, period):
    return ops.sum_series(filters.metric_filter(t.sums(spark, d), **period), "app.total", 3600)


def _hist_period(spark, d, period):
    return ops.histogram_series(filters.metric_filter(t.histogram(spark, d), **period), "app.latency", 86_400)


register(
    "j5_match_previous_period",
    lambda spark, d: ops.match_previous_period(_sum_period(spark, d, PERIOD), _sum_period(spark, d, BEFORE), WEEK),
    "sums",
    fill(SUM_SQL, where=f"AND {in_range(PERIOD)}")
    + fill(SUM_SQL, where=f"AND {in_range(BEFORE)}").replace("+s AS", ", b AS")
    + """ SELECT coalesce(s.BucketStart, b.BucketStart + INTERVAL 7 DAYS) AS BucketStart,
    coalesce(s.ServiceName, b.ServiceName) AS ServiceName, coalesce(s.SeriesKey, b.SeriesKey) AS SeriesKey,
    s.Value AS Current, b.Value AS Previous FROM s FULL OUTER JOIN b ON s.ServiceName=b.ServiceName
    AND s.SeriesKey=b.SeriesKey AND s.BucketStart = b.BucketStart + INTERVAL 7 DAYS""",
)
register(
    "e20_period_change",
    lambda spark, d: ops.period_change(_sum_period(spark, d, PERIOD), _sum_period(spark, d, BEFORE))
    .withColumn("ChangePercent", F.round("ChangePercent", 6)),
    "sums",
    fill(SUM_SQL, where=f"AND {in_range(PERIOD)}")
    + fill(SUM_SQL, where=f"AND {in_range(BEFORE)}").replace("+s AS", ", b AS")
    + """, x AS (SELECT coalesce((SELECT sum(Value) FROM s),0) AS Current, coalesce((SELECT sum(Value) FROM b),0) AS Previous)
    SELECT Current, Previous, CASE WHEN Previous<>0 THEN round((Current-Previous)/Previous*100,6) END AS ChangePercent,
    Previous=0 AND Current<>0 AS IsNew FROM x""",
)
HB = (fill(HIST_SQL, key=TYPE_KEY, where=f"AND {in_range(PERIOD)}")
      + fill(HIST_SQL, key=TYPE_KEY, where=f"AND {in_range(BEFORE)}").replace("+h AS", ", g AS"))
register(
    "e20_histogram_period_change",
    lambda spark, d: ops.histogram_period_change(_hist_period(spark, d, PERIOD), _hist_period(spark, d, BEFORE))
    .select("ServiceName", "SeriesKey", *[F.round(c, 9).alias(c) for c in ("Current", "Previous", "ChangePercent")], "IsNew"),
    "histogram",
    HB + """, m AS (SELECT ServiceName, SeriesKey, sum(Sum)/sum(Count) AS c FROM h GROUP BY 1,2),
    n AS (SELECT ServiceName, SeriesKey, sum(Sum)/sum(Count) AS p FROM g GROUP BY 1,2),
    x AS (SELECT m.ServiceName, m.SeriesKey, coalesce(c,0) AS c, coalesce(p,0) AS p FROM m LEFT JOIN n USING (ServiceName, SeriesKey))
    SELECT ServiceName, SeriesKey, round(c,9) AS Current, round(p,9) AS Previous,
    CASE WHEN p<>0 THEN round((c-p)/p*100,9) END AS ChangePercent, p=0 AND c<>0 AS IsNew FROM x""",
)
register(
    "e20_histogram_max_change",
    lambda spark, d: ops.histogram_period_change(_hist_period(spark, d, PERIOD), _hist_period(spark, d, BEFORE), "max"),
    "histogram",
    HB + f""", m AS (SELECT ServiceName, SeriesKey, max({MAX_SQL}) AS c FROM h GROUP BY 1,2),
    n AS (SELECT ServiceName, SeriesKey, max({MAX_SQL}) AS p FROM g GROUP BY 1,2),
    x AS (SELECT m.ServiceName, m.SeriesKey, coalesce(c,0) AS c, coalesce(p,0) AS p FROM m LEFT JOIN n USING (ServiceName, SeriesKey))
    SELECT ServiceName, SeriesKey, c AS Current, p AS Previous, CASE WHEN p<>0 THEN (c-p)/p*100 END AS ChangePercent,
    p=0 AND c<>0 AS IsNew FROM x""",
)
