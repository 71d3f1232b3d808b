"""Structured Streaming jobs: loading, watching and counting telemetry.

Sources and sinks are ordinary streaming DataFrames and folders on shared storage, so a
job restarted on other executors goes on from its checkpoint. ``foreachBatch`` writers
write to a folder per batch id in overwrite mode: a repeated batch replaces itself.
"""

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter

from beaconry.functions.times import EPOCH, add_us, epoch_us, ntz
from beaconry.operators.alerts import evaluate_alerts
from beaconry.operators.filters import (
    LOG_BAGS, attribute_present_and_equals, body_contains, equals, one_of,
)
from beaconry.operators.ingest import minute_counters
from beaconry.operators.patterns import BUCKET, CLUSTERS, annotate_patterns, distinct_texts, drain_templates
from beaconry.plans.lineage import path_exists, remove_path, scratch_path
from beaconry.sources.tables import LAYOUT, LOAD, MONTH, read_months, write_telemetry
from beaconry.schemas import ALERT_EVENTS

FLUSH_INTERVAL = "2 seconds"


def read_requests(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Export requests arriving as text files, one JSON document per line."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def _triggered(writer: DataStreamWriter, drain: bool, every: str = FLUSH_INTERVAL) -> DataStreamWriter:
    """Run until the available input is used up, or keep flushing every interval."""
    return writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, drain: bool = False):
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return _triggered(writer, drain).start()


def append_telemetry(stream: DataFrame, path: str, checkpoint: str, kind: str, drain: bool = False):
    """Append flat rows to a stored table, in its layout; a repeated micro-batch replaces its load.

    The writer counts, samples and sorts a batch, so its rows are decoded once, into the shared folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decoded = scratch_path(batch.sparkSession, "decoded")
        try:
            batch.write.parquet(decoded)
            rows = batch.sparkSession.read.schema(batch.schema).parquet(decoded)
            write_telemetry(rows, path, kind, load=_load(checkpoint, batch_id))
        finally:
            remove_path(batch.sparkSession, decoded)

    return each_batch(stream, write, checkpoint, drain)


def _load(checkpoint: str, batch_id: int) -> str:
    return f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{batch_id}"


def append_unique(stream: DataFrame, path: str, checkpoint: str, kind: str = "logs", key: str = "EventId", drain: bool = False):
    """Append rows whose ``key`` the stored table does not hold yet, however late a repeat arrives.

    The table itself is the memory, so the stream keeps no state. A repeat carries the time of
    its event: each micro-batch meets only the months it has rows of, and of those the rows
    within its span of time, by key and time. Rows without a time meet each other. Within a batch one row of
    a key and time is kept; rows without a key are all kept. A repeated micro-batch does not meet the load it wrote itself.
    """
    time = LAYOUT[kind][0]

    def write(batch: DataFrame, batch_id: int) -> None:
        load = _load(checkpoint, batch_id)
        span = batch.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(F.min(time).alias("first"), F.max(time).alias("last")).collect()
        fresh = batch.where(F.col(key).isNotNull()).dropDuplicates([key, time])
        seen = read_months(batch.sparkSession, path, kind, [r.month for r in span])
        if seen is not None:
            within = F.col(time).isNull()
            for month in (m for m in span if m.month is not None):
                within |= (F.col(MONTH) == month.month) & F.col(time).between(ntz(month["first"]), ntz(month["last"]))
            seen = seen.where((F.col(LOAD) != load) & within).select(F.col(key).alias("_key"), F.col(time).alias("_time"))
            fresh = fresh.join(seen, (F.col(key) == F.col("_key")) & F.col(time).eqNullSafe(F.col("_time")), "left_anti")
        write_telemetry(fresh.unionByName(batch.where(F.col(key).isNull())), path, kind, load=load)

    return each_batch(stream, write, checkpoint, drain)


def live_tail(stream: DataFrame, services=None, severities=None, trace_id=None, search=None, attributes=None) -> DataFrame:
    """New events that match: literal case-insensitive text, present attributes only.

    Time, span and pattern ids do not filter a live view.
    """
    stream = equals(one_of(one_of(stream, "ServiceName", services), "SeverityNumber", severities), "TraceId", trace_id)
    if search:
        stream = stream.where(body_contains(search))
    for item in attributes or ():
        bag, key, value = item if len(item) == 3 else ("log", *item)
        stream = stream.where(attribute_present_and_equals(LOG_BAGS[bag], key, value))
    return stream


def ingest_buckets_stream(requests: DataFrame, late: str | None = None) -> DataFrame:
    """Per-minute counters for each signal and protocol, updated as requests arrive.

    Late requests always count. The state is a few counters a minute; with ``late`` given,
    minutes that the watermark has passed by that much are forgotten and their late rows dropped.
    """
    timed = requests.withColumn("_at", _instant("ReceivedAt"))
    timed = timed if late is None else timed.withWatermark("_at", late)
    counted = timed.groupBy(F.window("_at", "60 seconds").alias("w"), "Signal", "Protocol").agg(*minute_counters())
    start = add_us(ntz(EPOCH), F.unix_micros("w.start")).alias("BucketStart")
    return counted.select(start, "Signal", "Protocol", "Requests", "Records", "Bytes", "Rejected")


def _instant(column: str):
    """A watermark needs an instant: the UTC wall-clock time as TIMESTAMP, in any session zone."""
    return F.timestamp_micros(epoch_us(F.col(column)))


def dedupe_events(df: DataFrame, key: str = "EventId", time: str = "Timestamp", late: str | None = None) -> DataFrame:
    """First occurrence of every event id.

    A stream remembers all ids (use a state store on disk, or ``append_unique``, which looks them
    up in the stored table), so nothing is lost however late;
    with ``late`` given it forgets ids, and drops rows, that the watermark has passed by that
    much. In batch the earliest row wins, by a partial top-1 per id.
    """
    if df.isStreaming and late is None:
        return df.dropDuplicates([key])
    if df.isStreaming:
        timed = df.withColumn("_at", _instant(time)).withWatermark("_at", late)
        return timed.dropDuplicatesWithinWatermark([key]).drop("_at")
    first = F.row_number().over(Window.partitionBy(key).orderBy(time))
    return df.withColumn("_rank", first).where(F.col("_rank") == 1).drop("_rank")


def _read_batches(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows of the per-batch folders below ``path`` (those before a batch id)."""
    try:
        df = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    except Exception as error:  # nothing has been written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
    if before is not None:
        df = df.where(F.col("batch") < before)
    return df.drop("batch")


def _version(path: str, batch_id: int) -> str:
    return f"{path}/version={batch_id}"


def _keep_version(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the version of a batch. A repeated batch needs the one before it, so earlier ones go."""
    rows.write.mode("overwrite").parquet(_version(path, batch_id))
    remove_path(rows.sparkSession, _version(path, batch_id - 2))


def _version_before(spark: SparkSession, path: str, batch_id: int, schema: T.StructType) -> DataFrame | None:
    """The version of the batch before, read by its own path: the table's folder is not listed."""
    before = _version(path, batch_id - 1)
    return spark.read.schema(schema).parquet(before) if path_exists(spark, before) else None


def alert_stream(logs: DataFrame, history: DataFrame, rules: Callable[[], DataFrame], events_path: str, checkpoint: str,
                 clock: Callable[[DataFrame], object] | None = None, drain: bool = False):
    """Evaluate all rules after every micro-batch over the stored logs.

    ``history`` is the table the logs are appended to, ``rules`` gives the current rules,
    ``clock`` the evaluation time of a batch (default: the latest timestamp of the batch).
    New events go to ``events_path``. The last firing of every rule, which cooldowns need, is a
    small table of its own in ``_last`` below it; where that is missing, the events are read once.
    """
    fields = T.StructType([f for f in ALERT_EVENTS.fields if f.name in ("RuleId", "FiredAt")])
    last_path = f"{events_path}/_last"

    def tick(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = rules()
        seen = T.StructType([T.StructField("RuleId", current.schema["Id"].dataType), fields["FiredAt"]])
        last = _version_before(spark, last_path, batch_id, seen)
        if last is None:
            last = _read_batches(spark, events_path, seen, batch_id)
        now = clock(batch) if clock else batch.agg(F.max("Timestamp")).head()[0]
        if now is not None:
            folder = f"{events_path}/batch={batch_id}"
            evaluate_alerts(current, history, last, now).write.mode("overwrite").parquet(folder)
            last = last.unionByName(spark.read.schema(seen).parquet(folder))
        _keep_version(last.groupBy("RuleId").agg(F.max("FiredAt").alias("FiredAt")), last_path, batch_id)

    return each_batch(logs, tick, checkpoint, drain)


STORED_CLUSTERS = T.StructType([*CLUSTERS.fields, T.StructField("last_used", T.LongType())])


def drain_stream(logs: DataFrame, clusters_path: str, out_path: str, checkpoint: str, body: str = "Body",
                 time: str = "Timestamp", max_templates: int | None = None, drain: bool = False):
    """Annotate arriving logs with the template known at their micro-batch.

    Templates live in a small table of which the versions of the last two batches are kept. A batch
    first matches its distinct texts against it; only texts of unknown shape reach the sequential
    step. A bucket keeps all its templates, or its ``max_templates`` most recently used ones.
    """
    def annotate(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _version_before(spark, clusters_path, batch_id, STORED_CLUSTERS)
        texts = distinct_texts(batch, body, time)
        mined = drain_templates(texts, None if known is None else known.select(*CLUSTERS.names))
        annotated = annotate_patterns(batch, body, time, clusters=mined)
        annotated.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        used = spark.read.parquet(f"{out_path}/batch={batch_id}").select(F.col("PatternTemplate").alias("template")).distinct()
        stamped = mined.join(used.withColumn("now", F.lit(batch_id).cast("bigint")), "template", "left")
        if known is not None:
            stamped = stamped.join(known.select(*BUCKET, "ordinal", "last_used"), [*BUCKET, "ordinal"], "left")
        else:
            stamped = stamped.withColumn("last_used", F.lit(None).cast("bigint"))
        stamped = stamped.withColumn("last_used", F.coalesce("now", "last_used", F.lit(batch_id).cast("bigint")))
        recent = F.row_number().over(Window.partitionBy(*BUCKET).orderBy(F.desc("last_used"), F.desc("ordinal")))
        order = F.row_number().over(Window.partitionBy(*BUCKET).orderBy("ordinal"))
        kept = stamped if max_templates is None else stamped.withColumn("r", recent).where(F.col("r") <= max_templates)
        kept = kept.withColumn("ordinal", order - 1).select(*STORED_CLUSTERS.names)
        _keep_version(kept, clusters_path, batch_id)

    return each_batch(logs, annotate, checkpoint, drain)
