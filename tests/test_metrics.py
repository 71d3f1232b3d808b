import pytest
from pyspark.sql import functions as F

from beaconry.functions.histograms import histogram_max, histogram_quantile
from beaconry.operators import metrics

QUANTILES = [
    ([0, 10, 0], [10, 50], 0.5, 30), ([10, 0, 0], [10, 50], 0.5, 10), ([0, 0, 10], [10, 50], 0.5, 50),
    ([90, 5, 5], [10, 50], 0.99, 50), ([0, 5, 5], [10, 50], 0.0, 10), ([7], [25], 0.5, 25), ([1, 1, 100], [10], 0.99, None),
    ([], [10], 0.5, None), ([1, 2], [], 0.5, None), ([0, 0, 0], [10, 50], 0.5, None), ([1, 1], [10], -0.1, None),
    ([1, 1], [10], 1.1, None), (None, [10], 0.5, None), ([1, 1], None, 0.5, None), ([5, 5, 0], [10, 50], 1.0, 50),
]
MAXIMA = [
    ([5, 0, 0], [10, 50], 10), ([10, 5, 0], [10, 50], 50), ([0, 0, 10], [10, 50], 50), ([7], [25], 25), ([0, 5, 0, 0], [10], None),
    ([0, 0, 0], [10, 50], None), ([], [], None), ([1], [], None), (None, [1], None),
]


def test_quantiles(spark):
    rows = [(i, c, [float(b) for b in bs] if bs is not None else None, q) for i, (c, bs, q, _) in enumerate(QUANTILES)]
    df = spark.createDataFrame(rows, "i int, c array<bigint>, b array<double>, q double")
    got = {r.i: r.v for r in df.select("i", histogram_quantile("c", "b", "q").alias("v")).collect()}
    assert got == {i: (None if e is None else pytest.approx(e)) for i, (_, _, _, e) in enumerate(QUANTILES)}


def test_maxima(spark):
    rows = [(i, c, [float(b) for b in bs]) for i, (c, bs, _) in enumerate(MAXIMA)]
    df = spark.createDataFrame(rows, "i int, c array<bigint>, b array<double>")
    got = {r.i: r.v for r in df.select("i", histogram_max("c", "b").alias("v")).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(MAXIMA)}


def points(spark, rows):
    df = spark.createDataFrame(rows, "t string, s string, a map<string,string>, n bigint, v double, c array<bigint>, b array<double>")
    return df.select(
        F.lit("m").alias("MetricName"), F.col("t").cast("timestamp_ntz").alias("Time"), F.col("s").alias("ServiceName"),
        F.col("a").alias("DataPointAttributes"), F.col("n").alias("Count"), F.col("v").alias("Sum"), F.col("v").alias("Value"),
        F.col("c").alias("BucketCounts"), F.col("b").alias("ExplicitBounds"),
    )


def test_histogram_layouts_are_padded(spark):
    df = points(spark, [
        ("2024-01-01 00:00:01", "a", {"x": "1", "y": "2"}, 3, 5.0, [1, 2], [10.0]),
        ("2024-01-01 00:00:02", "a", {"y": "2", "x": "1"}, 4, 1.0, [1, 1, 2], [10.0, 50.0]),
        ("2024-01-01 00:00:03", "a", {}, 0, None, None, None),
    ])
    rows = {r.SeriesKey: r for r in metrics.histogram_series(df, "m", 60).collect()}
    both = rows['{"x":"1","y":"2"}']
    assert (both.Count, both.Sum, both.BucketCounts, both.ExplicitBounds) == (7, 6.0, [2, 3, 2], [10.0, 50.0])
    assert rows["{}"].BucketCounts == [] and rows["{}"].Count == 0
    estimated = metrics.with_histogram_estimates(metrics.histogram_series(df, "m", 60)).where("SeriesKey = '{}'").head()
    assert estimated.p50 is None and estimated.Mean is None and estimated.MaxApprox is None


def test_reset_aware_sum_counts_restarts(spark):
    df = points(spark, [(f"2024-01-0{d} 00:00:0{s}", "a", {}, 0, v, [], []) for d, s, v in (
        (1, 0, 5.0), (1, 1, 9.0), (1, 2, 2.0), (2, 0, 6.0))])
    by_day = {str(r.BucketStart)[:10]: r.Value for r in metrics.sum_series(df, "m", 86_400, reset_aware=True).collect()}
    assert by_day == {"2024-01-01": 6.0, "2024-01-02": 4.0}
    plain = {str(r.BucketStart)[:10]: r.Value for r in metrics.sum_series(df, "m", 86_400).collect()}
    assert plain == {"2024-01-01": 7.0, "2024-01-02": 0.0}


def test_period_change_edges(spark):
    some, none = (points(spark, [("2024-01-01", "a", {}, 0, v, [], [])]) for v in (3.0, 0.0))
    row = metrics.period_change(some, none).head()
    assert row.ChangePercent is None and row.IsNew
    row = metrics.period_change(none, none).head()
    assert row.ChangePercent is None and not row.IsNew
    assert metrics.period_change(some, some).head().ChangePercent == 0.0
