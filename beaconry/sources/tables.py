"""Stored telemetry tables: layout, reading, writing and export.

A table has a folder per month and, in it, one per load (a batch write or a micro-batch), so
streams and batches add to the same table and a repeated micro-batch replaces itself.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from beaconry import schemas
from beaconry.operators.filters import MONTH
from beaconry.plans.lineage import path_exists, stored

# Time column, sort key and bloom-filtered columns of every stored table.
LAYOUT = {
    "logs": ("Timestamp", ["ServiceName", "SeverityNumber", "Timestamp", "TraceId"], ["TraceId", "EventId"]),
    "spans": ("StartTime", ["TraceId", "StartTime", "SpanId"], ["TraceId", "SpanId"]),
    "metrics_gauge": ("Time", ["MetricName", "ServiceName", "Time"], []),
    "metrics_sum": ("Time", ["MetricName", "ServiceName", "Time"], []),
    "metrics_histogram": ("Time", ["MetricName", "ServiceName", "Time"], []),
}


LOAD = "load"
# Rows that a writing task sorts, about.
ROWS_PER_TASK = 250_000


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return read_telemetry(spark, path, "logs")


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return read_telemetry(spark, path, "spans")


def read_gauges(spark: SparkSession, path: str) -> DataFrame:
    return read_telemetry(spark, path, "metrics_gauge")


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    return read_telemetry(spark, path, "metrics_sum")


def read_histograms(spark: SparkSession, path: str) -> DataFrame:
    return read_telemetry(spark, path, "metrics_histogram")


def read_telemetry(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A stored table with its fixed schema; ``month`` prunes partitions."""
    schema = _with_month(kind)
    return spark.read.schema(schema.add(LOAD, T.StringType())).parquet(path).drop(LOAD)


def read_months(spark: SparkSession, path: str, kind: str, months: list[str | None]) -> DataFrame | None:
    """The rows of some months, with their load; other months are not even listed. None where there are none."""
    folders = [f"{path}/{MONTH}={'__HIVE_DEFAULT_PARTITION__' if m is None else m}" for m in months]
    folders = [f for f in folders if path_exists(spark, f)]
    schema = _with_month(kind).add(LOAD, T.StringType())
    return spark.read.schema(schema).option("basePath", path).parquet(*folders) if folders else None


def _with_month(kind: str) -> T.StructType:
    return T.StructType([*schemas.TABLES[kind].fields, T.StructField(MONTH, T.StringType())])


def with_month(df: DataFrame, time_column: str) -> DataFrame:
    return df.withColumn(MONTH, F.date_format(time_column, "yyyy-MM"))


def write_telemetry(df: DataFrame, path: str, kind: str, mode: str = "append", partitions: int | None = None,
                    max_records_per_file: int = 5_000_000, load: str | None = None, rows_per_task: int = ROWS_PER_TASK) -> None:
    """Add to one table: a folder per month and load, files sorted by the table's key.

    ``mode`` append adds a load, named ``load`` or a new name; a load of that name is replaced in
    the months that it has rows of. ``mode`` overwrite replaces the table.

    Rows are range-partitioned by (month, key), so a busy month is spread over many tasks
    and files, each covering a narrow key range that row-group statistics can skip. There are
    ``partitions`` tasks, or as many as the counted rows need at ``rows_per_task``: one file a month
    for a small micro-batch, and tasks that do not grow with the table. A task
    starts a new file after ``max_records_per_file`` rows, so files do not grow with the table.
    """
    time_column, key, bloom = LAYOUT[kind]
    order = [MONTH, *[k for k in key if k in df.columns]]
    dated = with_month(df, time_column)
    partitions = partitions or max(1, -(-df.count() // rows_per_task))
    ranged = dated.repartitionByRange(partitions, *order)
    loaded = ranged.sortWithinPartitions(*order).withColumn(LOAD, F.lit(load or uuid.uuid4().hex))
    writer = loaded.write.mode("overwrite").option("partitionOverwriteMode", "static" if mode == "overwrite" else "dynamic")
    writer = writer.option("maxRecordsPerFile", max_records_per_file).partitionBy(MONTH, LOAD)
    for column in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def export_logs(df: DataFrame, cap: int | None = None) -> DataFrame:
    """The export columns in search order: all rows, or one row more than ``cap`` (was it truncated?)."""
    ordered = df.orderBy(F.desc("Timestamp"), F.desc("EventId"))
    if cap is not None:
        ordered = ordered.limit(cap + 1)
    event_name = F.col("EventName") if "EventName" in df.columns else F.lit("")
    return ordered.select(
        "EventId", "Timestamp", F.col("SeverityText").alias("Severity"), "SeverityNumber",
        F.col("ServiceName").alias("Service"), event_name.alias("EventName"), F.col("Body").alias("Message"),
        "TraceId", "SpanId", F.to_json("LogAttributes").alias("LogAttributesJson"),
    )


def export_page(df: DataFrame, cap: int) -> tuple[DataFrame, bool]:
    """The first ``cap`` export rows, written once, and whether there are more."""
    rows = stored(export_logs(df, cap), "export")
    return rows.orderBy(F.desc("Timestamp"), F.desc("EventId")).limit(cap), rows.count() > cap


def write_export(rows: DataFrame, path: str, fmt: str) -> None:
    """Write ``export_logs`` rows as csv, json / ndjson (one object per line, names in lower camel case) or xml."""
    # The writers' own format ends at milliseconds.
    times = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    if fmt == "csv":
        rows.write.options(**times).option("header", "true").option("quote", '"').option("escape", '"').csv(path)
        return
    nested = rows.withColumn("LogAttributes", F.from_json("LogAttributesJson", "map<string,string>")).drop("LogAttributesJson")
    if fmt in ("json", "ndjson"):
        nested.toDF(*[c[0].lower() + c[1:] for c in nested.columns]).write.options(**times).json(path)
    elif fmt == "xml":
        attributes = F.transform(F.map_entries("LogAttributes"), lambda e: F.struct(e["key"].alias("_key"), e["value"].alias("_VALUE")))
        tagged = nested.withColumn("LogAttributes", F.struct(attributes.alias("Attribute")))
        tagged.write.format("xml").options(**times).option("rootTag", "Logs").option("rowTag", "Log").save(path)
    else:
        raise ValueError(f"unknown export format {fmt!r}")
