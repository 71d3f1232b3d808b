"""Ingest health over the ``ingest_requests`` and ``flush_log`` tables."""

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from beaconry.functions.times import add_seconds, bucket_start, ntz, seconds_between
from beaconry.operators.filters import as_datetime
from beaconry.plans.ordered import running_total

# The closed sets of signals and receiver protocols.
SIGNALS = ("Logs", "Traces", "Metrics")
PROTOCOLS = ("Grpc", "Http", "Scrape")
UNKNOWN_SERVICE = "unknown_service"

# Thresholds of the health verdicts.
DOWN_ERRORS = 3
STUCK_SECONDS = 300
WARN_PERCENT = 70
DOWN_PERCENT = 90
STALE_SECONDS = 60
TRAFFIC_MINUTES = 3
REJECTIONS_SHOWN = 200
TOP_SERVICES = 5
DEFAULT_CAPACITY = 1_000_000


def window_minutes(minutes: int | None) -> int:
    """The asked number of minutes; an hour where none, or none above 0, is given."""
    return minutes if minutes and minutes > 0 else 60


def minute_window(now, minutes):
    """First and last minute of the window that ends with the current minute."""
    current = as_datetime(now).replace(second=0, microsecond=0)
    return current - dt.timedelta(minutes=window_minutes(minutes) - 1), current


def in_window(requests: DataFrame, now, minutes) -> DataFrame:
    first, current = minute_window(now, minutes)
    ts = F.col("ReceivedAt")
    return requests.where((ts >= ntz(first)) & (ts < ntz(current + dt.timedelta(minutes=1))))


def minute_counters() -> list[Column]:
    accepted = ~F.col("Rejected")
    return [
        F.count_if(accepted).alias("Requests"),
        F.coalesce(F.sum(F.when(accepted, F.col("Records"))), F.lit(0)).alias("Records"),
        F.coalesce(F.sum(F.when(accepted, F.col("Bytes"))), F.lit(0)).alias("Bytes"),
        F.count_if(F.col("Rejected")).alias("Rejected"),
    ]


def dense_grid(spark: SparkSession, now, minutes) -> DataFrame:
    """Every (minute, signal, protocol) of the window."""
    first, _ = minute_window(now, minutes)
    offsets = F.explode(F.sequence(F.lit(0), F.lit(window_minutes(minutes) - 1)))
    return (
        spark.range(1).select(offsets.alias("m"))
        .select(add_seconds(ntz(first), F.col("m") * 60).alias("BucketStart"),
                F.explode(F.array(*map(F.lit, SIGNALS))).alias("Signal"))
        .select("*", F.explode(F.array(*map(F.lit, PROTOCOLS))).alias("Protocol"))
    )


def fill_grid(grid: DataFrame, counted: DataFrame, keys: list[str]) -> DataFrame:
    """Grid rows with the counted values, zero where nothing was counted."""
    measures = [c for c in counted.columns if c not in keys]
    joined = grid.join(counted, keys, "left")
    return joined.select(*keys, *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in measures])


def ingest_buckets(requests: DataFrame, now, minutes: int | None = 60) -> DataFrame:
    """Dense per-minute counters for every signal and protocol of the window."""
    keys = ["BucketStart", "Signal", "Protocol"]
    counted = (
        in_window(requests, now, minutes)
        .groupBy(bucket_start(F.col("ReceivedAt"), 60).alias("BucketStart"), "Signal", "Protocol")
        .agg(*minute_counters())
    )
    return fill_grid(dense_grid(requests.sparkSession, now, minutes), counted, keys)


def ingest_totals(requests: DataFrame, now, minutes: int | None = 60) -> DataFrame:
    """One row: arrivals, records, bytes of the current minute; requests, rejections of the window."""
    _, current = minute_window(now, minutes)
    accepted = ~F.col("Rejected")
    live = accepted & (F.col("ReceivedAt") >= ntz(current))
    total = lambda condition, column: F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0).cast("bigint"))
    return in_window(requests, now, minutes).agg(
        F.count_if(live).alias("ArrivalsThisMinute"), total(live, "Records").alias("RecordsThisMinute"),
        total(live, "Bytes").alias("BytesThisMinute"), F.count_if(accepted).alias("RequestsInWindow"),
        F.count_if(~accepted).alias("RejectedInWindow"),
    )


def receiver_status(requests: DataFrame, now, minutes: int | None = 60) -> DataFrame:
    """idle / healthy / down / degraded per protocol."""
    counted = in_window(requests, now, minutes).groupBy("Protocol").agg(
        F.count_if(~F.col("Rejected")).alias("Requests"), F.count_if("Rejected").alias("Rejected")
    )
    protocols = requests.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, PROTOCOLS))).alias("Protocol"))
    status = (
        F.when(F.col("Requests") == 0, "idle").when(F.col("Rejected") == 0, "healthy")
        .when(F.col("Rejected") >= F.col("Requests"), "down").otherwise("degraded")
    )
    return fill_grid(protocols, counted, ["Protocol"]).withColumn("Status", status)


def recent_rejections(requests: DataFrame, n: int = REJECTIONS_SHOWN) -> DataFrame:
    """Newest rejected requests; entries without time, signal or protocol are skipped."""
    complete = F.col("ReceivedAt").isNotNull() & F.col("Signal").isin(*SIGNALS) & F.col("Protocol").isin(*PROTOCOLS)
    return (
        requests.where(F.col("Rejected") & complete).select("RequestId", "ReceivedAt", "Signal", "Protocol", "Reason")
        .orderBy(F.desc("ReceivedAt"), F.desc("RequestId")).limit(n)
    )


def service_share(parts: DataFrame) -> DataFrame:
    """Records and byte share of each service of a request.

    ``parts`` holds (RequestId, ServiceName, Records, Bytes) with the request's total bytes
    on every row; bytes are split by records, rounded down.
    """
    service = F.when(F.coalesce("ServiceName", F.lit("")) == "", UNKNOWN_SERVICE).otherwise(F.col("ServiceName"))
    per_service = parts.groupBy("RequestId", service.alias("ServiceName")).agg(
        F.sum("Records").alias("Records"), F.max("Bytes").alias("b")
    )
    total = F.sum("Records").over(Window.partitionBy("RequestId"))
    share = F.when(total == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("div", F.col("b") * F.col("Records"), F.nullif(total, F.lit(0))))
    return per_service.select("RequestId", "ServiceName", "Records", share.alias("Bytes"))


def top_services(shares: DataFrame, n: int = TOP_SERVICES) -> DataFrame:
    """Per signal the ``n`` services with most records; the rest in one ``other`` row.

    ``shares`` holds (Signal, ServiceName, Records, Bytes). ``Services`` is the number of
    services a row stands for, ``Rank`` is NULL on the ``other`` row.
    """
    totals = shares.groupBy("Signal", "ServiceName").agg(F.sum("Records").alias("Records"), F.sum("Bytes").alias("Bytes"))
    order = Window.partitionBy("Signal").orderBy(F.desc("Records"), "ServiceName")
    ranked = totals.withColumn("Rank", F.row_number().over(order))
    kept = F.col("Rank") <= n
    return ranked.groupBy(
        "Signal", F.when(kept, F.col("ServiceName")).otherwise(F.lit("other")).alias("ServiceName"),
        F.when(kept, F.col("Rank")).alias("Rank"),
    ).agg(F.count(F.lit(1)).alias("Services"), F.sum("Records").alias("Records"), F.sum("Bytes").alias("Bytes"))


def flush_health(flushes: DataFrame) -> DataFrame:
    """Per signal: last success and its size, last error, errors since the last success.

    The last success per signal (at most one row for each of the fixed signals) is found
    first, then failures are compared with it, so no signal's history is sorted in one task.
    """
    flushes = flushes.where(F.col("Signal").isin(*SIGNALS))
    at = F.struct("FlushedAt", "FlushId")
    last_success = flushes.where(~F.col("Failed")).groupBy("Signal").agg(
        F.max(F.struct("FlushedAt", "FlushId", "BatchSize")).alias("ok")
    )
    compared = flushes.where(F.col("Failed")).join(F.broadcast(last_success), "Signal", "left")
    since = F.col("ok").isNull() | (at > F.struct(F.col("ok.FlushedAt").alias("FlushedAt"), F.col("ok.FlushId").alias("FlushId")))
    failures = compared.groupBy("Signal").agg(
        F.max(F.struct("FlushedAt", "FlushId", "Error")).alias("err"), F.count_if(since).alias("ConsecutiveErrors")
    )
    signals = flushes.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SIGNALS))).alias("Signal"))
    return signals.join(last_success, "Signal", "left").join(failures, "Signal", "left").select(
        "Signal", F.col("ok.FlushedAt").alias("LastFlushAt"), F.col("ok.BatchSize").alias("LastBatchSize"),
        F.col("err.FlushedAt").alias("LastErrorAt"), F.col("err.Error").alias("LastError"),
        F.coalesce("ConsecutiveErrors", F.lit(0).cast("bigint")).alias("ConsecutiveErrors"),
    )


def utilization_percent(length: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, F.floor(length / capacity * 100 + F.lit(0.5)).cast("bigint"))


def stream_backlog(requests: DataFrame, flushes: DataFrame, now, capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """Per signal: records accepted but not flushed, age of the oldest of them, utilization.

    Flushing is first in, first out: the oldest pending request is the first one whose
    running record total exceeds everything flushed so far.
    """
    now = as_datetime(now)
    arrived = requests.where(~F.col("Rejected") & (F.col("ReceivedAt") < ntz(now)) & F.col("Signal").isin(*SIGNALS))
    flushed = (
        flushes.where(~F.col("Failed") & (F.col("FlushedAt") < ntz(now)) & F.col("Signal").isin(*SIGNALS))
        .groupBy("Signal").agg(F.sum("BatchSize").alias("f"))
    )
    totals = running_total(arrived, ["Signal"], ["ReceivedAt", "RequestId"], "Records", "_upto")
    # One row per fixed signal on the broadcast side.
    compared = totals.join(F.broadcast(flushed), "Signal", "left")
    done = F.coalesce("f", F.lit(0).cast("bigint"))
    per_signal = compared.groupBy("Signal").agg(
        F.sum("Records").alias("Arrived"), F.max(done).alias("Flushed"),
        F.min(F.when(F.col("_upto") > done, F.col("ReceivedAt"))).alias("_oldest"),
    )
    signals = requests.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, SIGNALS))).alias("Signal"))
    pending = F.greatest(F.lit(0).cast("bigint"), F.col("Arrived") - F.col("Flushed"))
    return (
        signals.join(per_signal, "Signal", "left")
        .select("Signal", F.col("Arrived").isNotNull().alias("Available"),
                F.coalesce(pending, F.lit(0).cast("bigint")).alias("Length"), F.lit(capacity).cast("bigint").alias("Capacity"),
                seconds_between(F.col("_oldest"), ntz(now)).cast("double").alias("OldestPendingAgeSeconds"))
        .withColumn("Pending", F.col("Length"))
        .withColumn("UtilizationPercent", utilization_percent(F.col("Length"), F.col("Capacity")))
    )


def recent_traffic(buckets: DataFrame, now) -> DataFrame:
    """Signals that received records in the last minutes of ``ingest_buckets``."""
    since = ntz(as_datetime(now) - dt.timedelta(minutes=TRAFFIC_MINUTES))
    return buckets.groupBy("Signal").agg(
        F.coalesce(F.bool_or((F.col("Records") > 0) & (F.col("BucketStart") >= since)), F.lit(False)).alias("HasTraffic")
    )


def _stuck() -> Column:
    return (F.col("Pending") > 0) & (F.coalesce("OldestPendingAgeSeconds", F.lit(0.0)) >= STUCK_SECONDS)


def _stale(now) -> Column:
    age = seconds_between(F.col("LastFlushAt"), ntz(as_datetime(now))).cast("double")
    return F.coalesce("HasTraffic", F.lit(False)) & (age.isNull() | (age >= STALE_SECONDS))


def _age(now) -> Column:
    """Time since the last flush in whole minutes, from an hour on in hours; a writer without one is infinitely late."""
    age = seconds_between(F.col("LastFlushAt"), ntz(as_datetime(now))).cast("double")
    whole = lambda unit: F.floor(age / unit).cast("string")
    return F.when(age.isNull(), "Infinityh ago").when(age < 3600, F.concat(whole(60), F.lit("m ago"))).otherwise(F.concat(whole(3600), F.lit("h ago")))


def signal_state(health: DataFrame, backlog: DataFrame, buckets: DataFrame, now) -> DataFrame:
    """Flush health, backlog and traffic of each signal in one row (three small tables)."""
    return health.join(backlog, "Signal", "left").join(recent_traffic(buckets, now), "Signal", "left")


def flush_status(health: DataFrame, backlog: DataFrame, buckets: DataFrame, now) -> DataFrame:
    """Current state of each signal's writer; the first condition that holds decides."""
    status = (
        F.when(F.col("ConsecutiveErrors") >= DOWN_ERRORS, "down")
        .when(F.col("ConsecutiveErrors") > 0, "retrying")
        .when(F.coalesce(_stuck(), F.lit(False)), "stuck")
        .when(_stale(now), "stale")
        .when(F.coalesce("LastError", F.lit("")) != "", "recovered")
        .when(F.col("LastFlushAt").isNull(), "idle")
        .otherwise("healthy")
    )
    return signal_state(health, backlog, buckets, now).select("Signal", status.alias("Status"), "ConsecutiveErrors")


def ingest_verdict(health: DataFrame, backlog: DataFrame, buckets: DataFrame, totals: DataFrame, now) -> DataFrame:
    """One row: down / degraded / healthy and its first two reasons.

    Writers come first, then buffers, then rejections, each in signal order.
    """
    state = signal_state(health, backlog, buckets, now)
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = lambda c: F.col(c).cast("string")
    errors, percent = F.col("ConsecutiveErrors"), F.col("UtilizationPercent")
    is_down, retrying = errors >= DOWN_ERRORS, (errors > 0) & (errors < DOWN_ERRORS)
    stale = (errors == 0) & _stale(now)
    available, stuck = F.coalesce("Available", F.lit(False)), F.coalesce(_stuck(), F.lit(False))
    order = F.array_position(F.array(*map(F.lit, SIGNALS)), F.col("Signal"))
    full = F.coalesce(percent >= DOWN_PERCENT, F.lit(False))
    # The wording of the reasons, here and in the two texts below.
    writer_down = F.when(is_down, text(F.col("Signal"), " exporter unavailable"))
    writer_degraded = F.when(retrying, text(F.col("Signal"), " flush retrying (", number("ConsecutiveErrors"), " errors)")).when(
        stale, text(F.col("Signal"), " flush stale (", _age(now), " since last flush, still receiving traffic)")
    )
    buffer_down = (
        F.when(is_down, F.when(F.col("Length") > 0, F.coalesce(
            text(number("Length"), " buffered (", number("UtilizationPercent"), "%)"), text(number("Length"), " buffered"))))
        .when(full, text(F.col("Signal"), " buffer at ", number("UtilizationPercent"), "% capacity, oldest entries at risk of being dropped"))
        .when(stuck, text(F.col("Signal"), " pipeline backlog stuck (", number("Pending"), " pending)"))
    )
    buffer_degraded = F.when(is_down | full | stuck | stale, F.lit(None)).when(
        percent >= WARN_PERCENT, text(F.col("Signal"), " buffer at ", number("UtilizationPercent"), "% capacity")
    ).when(F.col("Pending") > 0, text(F.col("Signal"), " backlog building (", number("Length"), " buffered)"))
    reason = lambda stage, column: F.struct(F.lit(stage).alias("stage"), order.alias("o"), column.alias("text"))
    worded = state.select(
        F.array(reason(0, writer_down), reason(1, F.when(available, buffer_down))).alias("down"),
        F.array(reason(0, writer_degraded), reason(1, F.when(available, buffer_degraded))).alias("degraded"),
    )
    gathered = worded.agg(
        *[F.sort_array(F.flatten(F.collect_list(kind))).alias(kind) for kind in ("down", "degraded")]
    )
    texts = lambda kind: F.transform(F.filter(kind, lambda r: r["text"].isNotNull()), lambda r: r["text"])
    rate = F.col("RejectedInWindow") / F.nullif(F.col("RequestsInWindow"), F.lit(0))
    rejected = F.when(
        F.col("RejectedInWindow") > 0,
        F.array(text(F.floor(F.coalesce(rate, F.lit(0.0)) * 100 + 0.5).cast("string"), "% rejected (", number("RejectedInWindow"), ")")),
    ).otherwise(F.array().cast("array<string>"))
    # Two one-row frames side by side, paired on a constant key.
    both = gathered.withColumn("_k", F.lit(1)).join(totals.withColumn("_k", F.lit(1)), "_k").select(
        texts("down").alias("down"), F.concat(texts("degraded"), rejected).alias("degraded")
    )
    level = F.when(F.size("down") > 0, "down").when(F.size("degraded") > 0, "degraded").otherwise("healthy")
    detail = F.when(F.size("down") + F.size("degraded") > 0, F.array_join(F.slice(F.concat("down", "degraded"), 1, 2), " · ")).otherwise(
        F.lit("All receivers operational · 0% rejected · no pipeline backlog")
    )
    return both.select(level.alias("Level"), detail.alias("Detail"))
