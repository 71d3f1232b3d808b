"""Metric discovery, bucketed series, histogram estimates and period comparison.

A series is (ServiceName, DataPointAttributes), or (ServiceName, one attribute's value)
when grouped by a key. ``SeriesKey`` is order-insensitive in the attribute map.
"""

from pyspark.sql import DataFrame, functions as F

from beaconry.functions.attributes import attribute, sorted_map
from beaconry.functions.histograms import histogram_max, histogram_mean, histogram_quantile
from beaconry.functions.times import add_seconds, bucket_start
from beaconry.plans.ordered import previous_row

QUANTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
SERIES = ["BucketStart", "ServiceName", "SeriesKey"]


def metric_names(gauge: DataFrame, sums: DataFrame, histogram: DataFrame) -> DataFrame:
    """(MetricName, ServiceName, Type) with unit, description and number of series.

    Points are first reduced to distinct series, so the counting works on series.
    """
    points = [
        df.select(
            "MetricName", "ServiceName", F.lit(kind).alias("Type"), "Unit", "Description",
            F.sort_array(F.map_entries("DataPointAttributes")).alias("a"),
        )
        for kind, df in (("gauge", gauge), ("sum", sums), ("histogram", histogram))
    ]
    metric, texts = ["MetricName", "ServiceName", "Type"], [F.min(c).alias(c) for c in ("Unit", "Description")]
    # All kinds go through the same exchanges.
    series = points[0].unionByName(points[1]).unionByName(points[2]).distinct()
    per_series = series.groupBy(*metric, "a").agg(*texts)
    return per_series.groupBy(*metric).agg(*texts, F.count(F.lit(1)).alias("SeriesCount")).orderBy(*metric)


def metric_attribute_keys(df: DataFrame, metric: str, approximate: bool = False) -> DataFrame:
    """Attribute keys of a metric with the number of distinct values."""
    entries = df.where(F.col("MetricName") == metric).select(F.explode("DataPointAttributes").alias("Key", "Value"))
    count = F.approx_count_distinct("Value") if approximate else F.count_distinct("Value")
    return entries.groupBy("Key").agg(count.alias("DistinctValueCount")).orderBy("Key")


def _points(df: DataFrame, metric: str, width_s: int, group_key: str | None, *measures: str) -> DataFrame:
    """Rows of one metric with bucket, service and series identity ``_series``.

    Grouping happens on the sorted attribute entries (or the one value); map and key text
    are only built for the aggregated rows.
    """
    series = attribute("DataPointAttributes", group_key) if group_key else F.sort_array(F.map_entries("DataPointAttributes"))
    return (
        df.where(F.col("MetricName") == metric)
        .select("Time", "ServiceName", series.alias("_series"), *measures)
        .withColumn("BucketStart", bucket_start(F.col("Time"), width_s))
    )


_KEYS = ["BucketStart", "ServiceName", "_series"]


def _named(df: DataFrame, group_key: str | None, *measures: str) -> DataFrame:
    if group_key:
        attributes, key = F.create_map(F.lit(group_key), F.col("_series")), F.col("_series")
    else:
        attributes = F.map_from_entries("_series")
        key = F.to_json(attributes)
    return df.select(
        "BucketStart", "ServiceName", key.alias("SeriesKey"), attributes.alias("SeriesAttributes"), *measures
    )


def gauge_series(df: DataFrame, metric: str, width_s: int, group_key: str | None = None) -> DataFrame:
    """Mean value per (bucket, service, series)."""
    points = _points(df, metric, width_s, group_key, "Value")
    return _named(points.groupBy(*_KEYS).agg(F.avg("Value").alias("Value")), group_key, "Value")


def sum_series(df: DataFrame, metric: str, width_s: int, group_key: str | None = None,
               reset_aware: bool = False) -> DataFrame:
    """Counter growth (max - min) and points per (bucket, service, series).

    ``reset_aware`` adds up the increases between consecutive points of the same series
    instead, counting a drop as a restart from zero.
    """
    if not reset_aware:
        points = _points(df, metric, width_s, group_key, "Value")
        grown = points.groupBy(*_KEYS).agg(
            (F.max("Value") - F.min("Value")).alias("Value"), F.count(F.lit(1)).alias("Count")
        )
        return _named(grown, group_key, "Value", "Count")
    identity = F.to_json(sorted_map("DataPointAttributes"))
    points = df.where(F.col("MetricName") == metric).withColumn("_identity", identity)
    stepped = previous_row(points, ["ServiceName", "_identity"], ["Time", "Value"], ["Value"])
    delta = F.col("Value") - F.col("prev_Value")
    step = F.when(delta.isNull(), 0.0).when(delta < 0, F.col("Value")).otherwise(delta)
    points = _points(stepped.withColumn("Value", step), metric, width_s, group_key, "Value")
    grown = points.groupBy(*_KEYS).agg(F.sum("Value").alias("Value"), F.count(F.lit(1)).alias("Count"))
    return _named(grown, group_key, "Value", "Count")


def histogram_series(df: DataFrame, metric: str, width_s: int, group_key: str | None = None) -> DataFrame:
    """Σcount, Σsum and element-wise Σ of the bucket counts per (bucket, service, series).

    One scan: each point becomes one row per bucket plus a row at position -1 carrying its
    count and sum, so all of it is summed map-side in one hash aggregation. Points whose
    bounds differ are folded afterwards, on the aggregated rows, padded to the longest.
    """
    points = _points(df, metric, width_s, group_key, "Count", "Sum", "BucketCounts", "ExplicitBounds")
    # The bounds travel as text: an array of doubles would be normalized for every exploded row.
    points = points.withColumn("_layout", F.array_join(F.col("ExplicitBounds").cast("array<string>"), ","))
    zero = F.lit(0.0)
    head = F.array(F.struct(F.lit(-1).alias("p"), F.col("Count").alias("n"), F.coalesce("Sum", zero).alias("s")))
    cells = F.transform(
        F.coalesce("BucketCounts", F.array().cast("array<bigint>")),
        lambda n, i: F.struct(i.alias("p"), n.alias("n"), zero.alias("s")),
    )
    exploded = points.select(*_KEYS, "_layout", F.inline(F.concat(head, cells)))
    summed = exploded.groupBy(*_KEYS, "_layout", "p").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    folded = summed.groupBy(*_KEYS).agg(
        F.max(F.struct(F.length(F.translate("_layout", "0123456789.E-", "")), F.col("_layout").alias("b")))["b"].alias("_layout"),
        F.sum(F.when(F.col("p") == -1, F.col("n"))).alias("Count"),
        F.sum("s").alias("Sum"),
        F.sort_array(F.collect_list(F.when(F.col("p") >= 0, F.struct("p", "n")))).alias("_cells"),
    )
    longest = F.element_at("_cells", -1)["p"]
    one_layout = F.transform("_cells", lambda c: c["n"])
    many_layouts = F.transform(
        F.sequence(F.lit(0), longest),
        lambda i: F.aggregate(
            F.filter("_cells", lambda c: c["p"] == i), F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"]
        ),
    )
    counts = (
        F.when(F.size("_cells") == 0, F.array().cast("array<bigint>"))
        .when(F.size("_cells") == longest + 1, one_layout)
        .otherwise(many_layouts)
    )
    bounds = F.when(F.coalesce("_layout", F.lit("")) == "", F.array().cast("array<double>")).otherwise(
        F.split("_layout", ",").cast("array<double>"))
    folded = folded.withColumns({"BucketCounts": counts, "ExplicitBounds": bounds})
    return _named(folded, group_key, "Count", "Sum", "BucketCounts", "ExplicitBounds")


def with_histogram_estimates(series: DataFrame) -> DataFrame:
    """Quantiles, approximate maximum and mean of every row of ``histogram_series``."""
    estimates = {name: histogram_quantile("BucketCounts", "ExplicitBounds", q) for name, q in QUANTILES.items()}
    estimates["MaxApprox"] = histogram_max("BucketCounts", "ExplicitBounds")
    estimates["Mean"] = histogram_mean("Sum", "Count")
    return series.withColumns(estimates)


def sum_rate(series: DataFrame, width_s: int) -> DataFrame:
    """Growth per second of every bucket of ``sum_series``."""
    return series.withColumn("Rate", F.col("Value") / F.lit(width_s))


def bucket_totals(series: DataFrame) -> DataFrame:
    """All series of a bucket added up."""
    return series.groupBy("BucketStart").agg(F.sum("Value").alias("Value")).orderBy("BucketStart")


def match_previous_period(current: DataFrame, previous: DataFrame, shift_s: int, measure: str = "Value") -> DataFrame:
    """Both periods side by side: previous buckets are moved forward by the period."""
    now = current.select(*SERIES, F.col(measure).alias("Current"))
    before = previous.select(
        add_seconds(F.col("BucketStart"), F.lit(shift_s)).alias("BucketStart"),
        "ServiceName", "SeriesKey", F.col(measure).alias("Previous"),
    )
    return now.join(before, SERIES, "full_outer")


def change_percent(current, previous):
    """((cur - prev) / prev)·100 as text-free double; NULL without a baseline."""
    return F.when(previous != 0, (current - previous) / previous * 100)


def _labelled_change(df: DataFrame) -> DataFrame:
    current, previous = F.coalesce("Current", F.lit(0.0)), F.coalesce("Previous", F.lit(0.0))
    is_new = (previous == 0) & (current != 0)
    return df.withColumns({
        "Current": current, "Previous": previous,
        "ChangePercent": change_percent(current, previous), "IsNew": is_new,
    })


def period_change(current: DataFrame, previous: DataFrame, measure: str = "Value") -> DataFrame:
    """One row: the totals of both periods and the change between them.

    ``IsNew`` marks something where there was nothing; without any data the change is NULL.
    """
    both = current.select(F.lit(True).alias("now"), F.col(measure).alias("v")).unionByName(
        previous.select(F.lit(False).alias("now"), F.col(measure).alias("v"))
    )
    totals = both.agg(
        F.sum(F.when(F.col("now"), F.col("v"))).alias("Current"),
        F.sum(F.when(~F.col("now"), F.col("v"))).alias("Previous"),
    )
    return _labelled_change(totals)


def histogram_period_change(current: DataFrame, previous: DataFrame, mode: str = "mean") -> DataFrame:
    """Per series: change of the count-weighted mean, or of the largest bucket maximum."""
    if mode not in ("mean", "max"):
        raise ValueError("mode is 'mean' or 'max'")

    def measured(df, out):
        if mode == "mean":
            value = histogram_mean(F.sum("Sum"), F.sum("Count"))
        else:
            df = df.withColumn("_max", histogram_max("BucketCounts", "ExplicitBounds"))
            value = F.max("_max")
        return df.groupBy("ServiceName", "SeriesKey").agg(value.alias(out))

    joined = measured(current, "Current").join(measured(previous, "Previous"), ["ServiceName", "SeriesKey"], "left")
    return _labelled_change(joined)
