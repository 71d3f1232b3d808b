import datetime as dt

import pytest
from pyspark.sql import functions as F

from beaconry.catalog import tables as t
from beaconry.operators import filters, logs as ops, search
from beaconry.plans.ordered import position_in_group, previous_row, running_total
from beaconry.plans.quantiles import exact_quantiles
from beaconry.plans.sizing import is_small
from beaconry.plans.skew import join_unique
from beaconry.streaming.jobs import live_tail

SF_DIR = "/root/testdata/sf0.001"
MONTH = dict(frm="2024-01-01", to="2024-02-01")


@pytest.fixture(scope="module")
def logs(spark):
    return t.pattern_logs(spark, SF_DIR).cache()


def test_pages_concatenate_to_the_whole_order(logs):
    cursor, seen, pages = None, [], 0
    while True:
        rows = search.log_search(logs, cursor, 170, **MONTH).select("Timestamp", "EventId").collect()
        page = rows[:170]
        seen += [(r.Timestamp, r.EventId) for r in page]
        pages += 1
        if len(rows) <= 170:
            break
        cursor = (page[-1].Timestamp, page[-1].EventId)
    assert seen == sorted(((r.Timestamp, r.EventId) for r in logs.select("Timestamp", "EventId").collect()), reverse=True)
    assert pages > 3


def test_page_size_is_honoured():
    assert [search.page_limit(n) for n in (None, 0, 50, 5000)] == [200, 200, 50, 5000]
    with pytest.raises(ValueError):
        search.page_limit(-3)


def test_absent_predicates_do_not_filter(logs):
    assert filters.log_filter(logs, **MONTH, services=[], trace_id="", search=None, attributes=[]).count() == logs.count()
    with pytest.raises(ValueError):
        filters.log_filter(logs)


def test_default_range_is_the_last_hour():
    now = dt.datetime(2024, 1, 2, 3, tzinfo=dt.timezone(dt.timedelta(hours=2)))
    assert filters.resolve_range(now=now) == (dt.datetime(2024, 1, 2, 0), dt.datetime(2024, 1, 2, 1))


def test_month_partitions_are_pruned(spark):
    df = spark.range(1).select(F.lit("2024-01-15").cast("timestamp_ntz").alias("Timestamp"), F.lit("2024-01").alias("month"))
    plan = filters.time_bound(df, "Timestamp", **MONTH)._jdf.queryExecution().analyzed().toString()
    assert "month" in plan.split("Filter")[-1]


@pytest.mark.parametrize("where, same", [
    ("service = 'svc-1'", "ServiceName = 'svc-1'"), ("level <> 'Error' and severitynumber >= '9'", "SeverityText <> 'Error' AND SeverityNumber >= 9"),
    ("not (body like '%CLICK%' or level = 'Debug')", "NOT (lower(Body) LIKE '%click%' OR SeverityText = 'Debug')"),
    ("body not like '%like%'", "lower(Body) NOT LIKE '%like%'"), ("body = 'x LIKE y'", "Body = 'x LIKE y'"),
    ("traceid != '' and spanid < '8'", "TraceId <> '' AND SpanId < '8'"),
])
def test_query_language(logs, where, same):
    got = ops.log_query(logs, "count", where, **MONTH).head().Value
    assert got == logs.where(same).count()


def test_query_shapes(logs):
    assert ops.log_query(logs, "*", **MONTH).columns == logs.columns
    assert ops.log_query(logs, ["service", "body"], **MONTH).count() == 101
    assert ops.log_query(logs, ("avg", "severitynumber"), "service = 'x'", **MONTH).head().Value == 0.0
    series = ops.log_query(logs, ("sum", "severitynumber"), None, 86_400, "level", **MONTH)
    assert series.agg(F.sum("Value")).head()[0] == logs.agg(F.sum("SeverityNumber")).head()[0]
    for wrong in (lambda: ops.log_query(logs, ["password"], **MONTH), lambda: ops.log_query(logs, "*", None, 60, **MONTH),
                  lambda: ops.log_volume(logs, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_heatmap_counts_every_point_once(spark, logs):
    points = ops.numeric_values(logs, "value")
    assert ops.value_heatmap(points, "2024-01-01", "2024-01-31", 3600).agg(F.sum("Count")).head()[0] == points.count()
    same = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01' AS Timestamp, 5.0D AS Value")
    assert ops.value_heatmap(same, "2024-01-01", "2024-01-02", 3600).head().ValueIndex == 12


def test_numeric_guard(spark):
    from beaconry.functions.attributes import numeric_or_null

    cases = {"1": 1.0, "-1.5e3": -1500.0, ".5": 0.5, "5.": 5.0, "12d": None, " 1": None, "1_0": None, "nan": None, "inf": None, "": None}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.v for r in df.select("s", numeric_or_null("s").alias("v")).collect()} == cases


def test_live_tail_differs_from_history(logs):
    assert live_tail(logs, search="user 1%").count() == 0 < logs.where(filters.body_matches("user 1%")).count()
    assert live_tail(logs, attributes=[("absent", "")]).count() == 0
    assert filters.log_filter(logs, **MONTH, attributes=[("absent", "")]).count() == logs.count()


def test_spans_without_ids_never_match(spark):
    logs = spark.sql("SELECT 1 AS EventId, '' AS TraceId, '' AS SpanId UNION ALL SELECT 2, 't', 's' UNION ALL SELECT 3, 't', ''")
    spans = spark.sql("SELECT '' AS TraceId, '' AS SpanId, 9L AS DurationNano UNION ALL SELECT 't', 's', 5L UNION ALL SELECT 't', 's', 7L")
    for hot_rows in (10, 0):
        got = {r.EventId: r.SpanDurationNano for r in search.with_span_duration(logs, spans, hot_rows).collect()}
        assert got == {1: None, 2: 7, 3: None}


def samples(spark):
    return spark.range(500).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.lit("hot")).alias("k"), F.col("id"),
        F.timestamp_add("SECOND", (F.col("id") * 7919) % 100_000, F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
        (F.col("id") * 31 % 17).alias("v"),
    )


def test_sliced_windows_equal_plain_windows(spark):
    from pyspark.sql import Window

    df = samples(spark)
    w = Window.partitionBy("k").orderBy("ts", "id")
    expected = {r.id: (r.run, r.prev) for r in df.select(
        "id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.lag("v").over(w).alias("prev")).collect()}
    run = {r.id: r.run for r in running_total(df, ["k"], ["ts", "id"], "v", "run").collect()}
    prev = {r.id: r.prev_v for r in previous_row(df, ["k"], ["ts", "id"], ["v"]).collect()}
    assert {i: (run[i], prev[i]) for i in run} == expected


def test_positions_in_one_large_group(spark):
    df = samples(spark).withColumn("k", F.lit("one"))
    rows = position_in_group(df, ["k"], ["ts", "id"], "pos").orderBy("ts", "id").collect()
    assert [r.pos for r in rows] == list(range(500))


def test_exact_quantiles(spark):
    import numpy as np

    values = [((i * 7919) % 1009) / 7 - 20 for i in range(777)] + [3.0] * 400
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0, "e": 0.123}
    got = {r.Name: r.Value for r in exact_quantiles(df, "v", wanted).collect()}
    assert got == {n: pytest.approx(float(np.quantile(values, q))) for n, q in wanted.items()}


def test_broadcast_check(spark):
    assert is_small(spark.range(10), max_rows=10)
    assert not is_small(spark.range(11), max_rows=10)
    assert not is_small(spark.range(10), max_bytes=20)


def test_hot_keys_take_the_same_rows(spark):
    left = samples(spark).withColumn("key", F.col("id") % 7)
    right = spark.range(5).select(F.col("id").alias("key"), (F.col("id") * 10).alias("w"))
    for how in ("left", "inner", "left_semi"):
        plain = sorted(map(str, left.join(right, ["key"], how).collect()))
        for hot_rows in (0, 71, 10_000):
            assert sorted(map(str, join_unique(left, right, ["key"], how, hot_rows).collect())) == plain


def test_crowded_bins_are_split(spark):
    """A third of all rows within a billionth; ranks among equal values, near zero and at huge values."""
    import numpy as np

    rng = np.random.default_rng(6)
    values = [*(5 + rng.random(2000) * 1e-9).tolist(), *[7.25] * 900, *(rng.random(1500) * 1e-6 - 5e-7).tolist(), *(rng.random(300) * 1.7e308).tolist(), -1.6e308]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    wanted = {f"q{i}": i / 20 for i in range(21)}
    for small_bin in (100_000, 50, 1):
        got = {r.Name: r.Value for r in exact_quantiles(df, "v", wanted, small_bin).collect()}
        assert got == {n: pytest.approx(float(np.quantile(values, q)), rel=1e-12) for n, q in wanted.items()}
    assert exact_quantiles(df.limit(0), "v", wanted).collect() == []


def test_rows_of_one_second_spread_over_tasks(spark):
    """All rows of one key within one second: several parts hold them, and totals stay exact."""
    from beaconry.plans import ordered

    df = spark.range(4000).select(F.lit("hot").alias("k"), "id", F.timestamp_add("MICROSECOND", F.col("id"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("ts"),
                                  (F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [r.n for r in ordered._parted(df, ["k"], ["ts", "id"]).groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()]
        got = {r.id: r.run for r in running_total(df, ["k"], ["ts", "id"], "v", "run").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 4 and max(parts) < 1000
    total = 0
    for i in range(4000):
        total += i % 7
        assert got[i] == total


def test_query_columns_only(spark):
    df = spark.sql("SELECT 'a' AS ServiceName, 'Error' AS SeverityText, 'x select y' AS Body, '' AS TraceId, '' AS SpanId, 17 AS SeverityNumber, map('k', 'v') AS LogAttributes")
    assert ops.query_where(df, "service = 'a' and body like '%SELECT%' and severitynumber > 9").count() == 1
    for bad in ("LogAttributes['k'] = 'v'", "ServiceName = 'a'", "service in (select 'a')", "service = = 'a'", "body"):
        with pytest.raises(ValueError):
            ops.query_where(df, bad).count()
