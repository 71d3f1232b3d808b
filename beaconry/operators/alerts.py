"""Versioned rule tables and threshold alerts over logs.

A rule needs Id, Name, ThresholdCount, ThresholdComparator, WindowSeconds, CooldownSeconds
and a ``Condition`` struct (see ``schemas.LOG_FILTER``; ``with_condition`` decodes it from
JSON text). Rules are a small control table; logs are scanned once for all of them.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from beaconry.functions.times import add_seconds, ntz, seconds_between
from beaconry.operators.filters import LOG_BAGS, as_datetime, time_bound
from beaconry.plans.grouped import map_groups
from beaconry.plans.lineage import cut
from beaconry.plans.sizing import broadcast_if_small, is_small
from beaconry.schemas import LOG_FILTER

HISTORY_LIMIT = 50
# Parts that the logs of a service are cut into where the rules are too many to broadcast.
SCOPE_SALTS = 64
ANY_SERVICE = "\u0000any"
_CORRUPT = "_corrupt"


def latest_versions(df: DataFrame, key: str = "Id", version: str = "UpdatedAt", tiebreak: str | None = None,
                    enabled_only: bool = False, page_type: str | None = None) -> DataFrame:
    """Newest version per key without tombstones, optionally only enabled / one page type."""
    order = [F.desc(version), *([F.desc(tiebreak)] if tiebreak else [])]
    newest = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    df = df.withColumn("_rank", newest).where((F.col("_rank") == 1) & ~F.col("IsDeleted").cast("boolean")).drop("_rank")
    if enabled_only:
        df = df.where(F.col("Enabled").cast("boolean"))
    if page_type:
        df = df.where(F.col("PageType") == page_type)
    return df


def with_condition(rules: DataFrame, column: str = "ConditionJson") -> DataFrame:
    """Decode ``Condition``; a rule whose condition is not valid JSON gets NULL."""
    schema = T.StructType([*LOG_FILTER.fields, T.StructField(_CORRUPT, T.StringType())])
    decoded = F.from_json(column, schema, {"columnNameOfCorruptRecord": _CORRUPT})
    rules = rules.withColumn("_c", decoded)
    fields = F.struct(*[F.col(f"_c.{f.name}").alias(f.name) for f in LOG_FILTER.fields])
    usable = F.col("_c").isNotNull() & F.col(f"_c.{_CORRUPT}").isNull()
    return rules.withColumn("Condition", F.when(usable, fields)).drop("_c")


def undecodable_conditions(rules: DataFrame, column: str = "ConditionJson") -> DataFrame:
    """The rules that ``with_condition`` cannot decode and evaluation leaves out, as they came."""
    return with_condition(rules, column).where(F.col("Condition").isNull() & F.col(column).isNotNull()).drop("Condition")


def condition(services=None, **predicates) -> Column:
    """A ``Condition`` column from column expressions or literals for its fields."""
    given = {"services": services, **predicates}
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[value(given.get(f.name)).cast(f.dataType).alias(f.name) for f in LOG_FILTER.fields])


def _usable(rules: DataFrame) -> DataFrame:
    """Rules with a decodable condition, materialized once: several small jobs read them."""
    return cut(rules.where(F.col("Condition").isNotNull()).withColumns({
        "_condition": F.md5(F.to_json("Condition").cast("binary")), "_w": F.col("WindowSeconds").cast("bigint")
    }))


def _matching(logs: DataFrame, rules: DataFrame, start, to) -> DataFrame:
    """(``_condition``, Timestamp) for every log and distinct condition it satisfies.

    Reads the logs from the longest window before ``start`` up to ``to``.

    Conditions are joined to the logs on the service name, so that with the measured
    broadcast below the logs are neither shuffled nor multiplied by unrelated rules.
    Predicates that no rule uses are left out, and with them the columns they would read.
    """
    c = F.col("Condition")
    text = lambda f: F.coalesce(c[f], F.lit("")) != ""
    listed = lambda f: F.coalesce(F.size(c[f]), F.lit(0)) > 0
    used = rules.agg(
        F.coalesce(F.max("_w"), F.lit(0)).alias("longest"),
        F.coalesce(F.bool_or(~listed("services")), F.lit(False)).alias("any_service"),
        *[F.coalesce(F.bool_or(text(f)), F.lit(False)).alias(f) for f in ("traceId", "spanId", "patternId", "search")],
        *[F.coalesce(F.bool_or(listed(f)), F.lit(False)).alias(f) for f in ("severityNumbers", "attributes")],
    ).head()
    conditions = (
        rules.select("_condition", "Condition").dropDuplicates(["_condition"])
        .withColumn("_scope", F.explode(F.when(listed("services"), F.array_distinct(c["services"])).otherwise(F.array(F.lit(ANY_SERVICE)))))
    )
    scope = F.explode(F.array("ServiceName", F.lit(ANY_SERVICE))) if used["any_service"] else F.col("ServiceName")
    frm = start - dt.timedelta(seconds=used["longest"])
    bounded = time_bound(logs, "Timestamp", frm, to).withColumn("_scope", scope)
    if is_small(conditions):
        joined = bounded.join(F.broadcast(conditions), "_scope")
    else:
        # A service may hold a third of all logs, and rules for any service meet every log.
        salts = F.sequence(F.lit(0), F.lit(SCOPE_SALTS - 1))
        spread = bounded.withColumn("_salt", F.pmod(F.hash("EventId"), F.lit(SCOPE_SALTS)))
        joined = spread.join(conditions.withColumn("_salt", F.explode(salts)), ["_scope", "_salt"])
    for field, column in (("traceId", "TraceId"), ("spanId", "SpanId"), ("patternId", "PatternId")):
        if used[field]:
            joined = joined.where(~text(field) | (F.col(column) == c[field]))
    if used["severityNumbers"]:
        joined = joined.where(~listed("severityNumbers") | F.array_contains(c["severityNumbers"], F.col("SeverityNumber")))
    if used["search"]:
        pattern = F.concat(F.lit("%"), c["search"], F.lit("%"))
        joined = joined.where(~text("search") | F.call_function("ilike", F.col("Body"), pattern))
    if used["attributes"]:
        def holds(a):
            bag = F.coalesce(F.lower(a["bag"]), F.lit("log"))
            value = None
            for name, column in LOG_BAGS.items():
                if column in logs.columns:
                    branch = bag == name
                    value = F.when(branch, F.col(column)[a["key"]]) if value is None else value.when(branch, F.col(column)[a["key"]])
            return F.coalesce(value, F.lit("")) == F.coalesce(a["value"], F.lit(""))

        joined = joined.where(~listed("attributes") | F.forall(c["attributes"], holds))
    return joined.select("_condition", "Timestamp")


def count_matching(rules: DataFrame, logs: DataFrame, now) -> DataFrame:
    """Rules with ``ObservedCount``: matching logs in ``[now - WindowSeconds, now)``.

    Logs are counted per (condition, whole seconds before now); every rule then reads the
    running total at its own window. Rules with an undecodable condition are left out.
    """
    keyed, now = _usable(rules), as_datetime(now)
    matched = _matching(logs, keyed, now, now)
    # ts >= now - w  <=>  ceil(now - ts) <= w, for whole-second windows.
    age = F.ceil(seconds_between(F.col("Timestamp"), ntz(now))).cast("bigint")
    ages = matched.groupBy("_condition", age.alias("_age")).agg(F.count(F.lit(1)).alias("_n"))
    points = keyed.select("_condition", F.col("_w").alias("_age")).distinct()
    both = ages.withColumn("_ask", F.lit(False)).unionByName(
        points.withColumns({"_n": F.lit(0).cast("bigint"), "_ask": F.lit(True)})
    )
    # At most one row per second of the longest window and condition, whatever the log volume.
    until = Window.partitionBy("_condition").orderBy("_age").rangeBetween(Window.unboundedPreceding, 0)
    totals = (
        both.withColumn("ObservedCount", F.sum("_n").over(until)).where("_ask")
        .select("_condition", F.col("_age").alias("_w"), "ObservedCount")
    )
    return keyed.join(totals, ["_condition", "_w"], "left").drop("_condition", "_w").withColumn(
        "ObservedCount", F.coalesce("ObservedCount", F.lit(0).cast("bigint"))
    )


def is_breached(count="ObservedCount", threshold="ThresholdCount", comparator="ThresholdComparator") -> Column:
    """``<`` for LessThan, ``>=`` for anything else."""
    below = F.col(count) < F.col(threshold)
    return F.when(F.col(comparator) == "LessThan", below).otherwise(~below)


def with_cooldown(rules: DataFrame, events: DataFrame, now) -> DataFrame:
    """Adds ``LastFired`` and ``InCooldown`` (fired less than CooldownSeconds before now)."""
    last = events.groupBy(F.col("RuleId").alias("Id")).agg(F.max("FiredAt").alias("LastFired"))
    since = seconds_between(F.col("LastFired"), ntz(as_datetime(now)))
    return rules.join(last, "Id", "left").withColumn(
        "InCooldown", F.coalesce(since < F.col("CooldownSeconds"), F.lit(False))
    )


def message() -> Column:
    # The wording of a fired alert.
    symbol = F.when(F.col("ThresholdComparator") == "LessThan", "<").otherwise(">=")
    return F.concat(
        F.lit(':rotating_light: Alert "'), F.col("Name"), F.lit('" fired: '), F.col("ObservedCount").cast("string"),
        F.lit(" events ("), symbol, F.lit(" "), F.col("ThresholdCount").cast("string"), F.lit(") in the last "),
        F.col("WindowSeconds").cast("string"), F.lit("s"),
    )


def _firing(fired_at: Column) -> list[Column]:
    stamp = F.date_format(fired_at, "yyyy-MM-dd HH:mm:ss.SSS")
    return [
        # Derived from rule and time, so re-running a tick cannot add a second event.
        F.md5(F.concat_ws("|", F.col("Id").cast("string"), stamp).cast("binary")).alias("EventId"),
        F.col("Id").alias("RuleId"), F.col("Name").alias("RuleName"), fired_at.alias("FiredAt"),
        "ObservedCount", "ThresholdCount", "WindowSeconds",
        F.lit("Pending").alias("NotificationStatus"), F.lit(0).alias("NotificationStatusCode"),
        F.lit("").alias("NotificationError"), message().alias("Message"),
    ]


def evaluate_alerts(rules: DataFrame, logs: DataFrame, events: DataFrame, now, max_rules: int | None = None) -> DataFrame:
    """New alert events of one tick for current, enabled rules.

    ``max_rules`` bounds the rules of a tick (by name); by default all are evaluated.
    """
    if max_rules is not None:
        rules = rules.orderBy("Name", "Id").limit(max_rules)
    counted = count_matching(rules, logs, now).where(is_breached())
    fired = with_cooldown(counted, events, now).where(~F.col("InCooldown"))
    return fired.select(*_firing(ntz(as_datetime(now))))


def test_alert(rules: DataFrame, logs: DataFrame, now) -> DataFrame:
    """Dry run: observed count and whether each rule would fire, ignoring cooldown."""
    return count_matching(rules, logs, now).select(
        "Id", "ObservedCount", is_breached().alias("WouldFire"),
        ntz(as_datetime(now)).alias("EvaluatedAt"), "WindowSeconds",
    )


def alert_history(events: DataFrame, rule, limit: int = HISTORY_LIMIT) -> DataFrame:
    """Newest firings of one rule."""
    limit = limit if limit and limit > 0 else HISTORY_LIMIT
    return events.where(F.col("RuleId") == rule).orderBy(F.desc("FiredAt"), F.desc("EventId")).limit(limit)


def _tick_counts(rules: DataFrame, logs: DataFrame, start, end, poll_s: int, ticks: int) -> DataFrame:
    """Constant stretches of the matching count: (_condition, _w, k, k_end, ObservedCount).

    A log in second s (from start) enters the count at the first tick after s and leaves it
    once the window no longer reaches back to s. Both edges are aggregated per tick before
    they meet the rules' windows, so the size depends on ticks and rules, not on logs.
    """
    matched = _matching(logs, rules, start, end)
    second = F.floor(seconds_between(ntz(start), F.col("Timestamp"))).cast("bigint")
    poll = F.lit(poll_s).cast("bigint")
    floor_div = lambda c: F.floor(c / poll).cast("bigint")
    per_second = matched.groupBy("_condition", second.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    pairs = rules.select("_condition", "_w").distinct()
    # Joining ticks to windows multiplies rows, so the windows are spread over all tasks first.
    width = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.withColumn("_r", F.col("_w") % poll).repartition(width, "_condition", "_w")
    entering = per_second.groupBy("_condition", (floor_div(F.col("s")) + 1).alias("k")).agg(F.sum("n").alias("n"))
    leaving = (
        per_second.join(pairs.select("_condition", "_r").distinct(), "_condition")
        .groupBy("_condition", "_r", (floor_div(F.col("s") + F.col("_r")) + 1).alias("k")).agg(F.sum("n").alias("n"))
    )
    edges = (
        pairs.join(broadcast_if_small(cut(entering)), "_condition").select("_condition", "_w", "k", "n")
        .unionByName(pairs.join(broadcast_if_small(cut(leaving)), ["_condition", "_r"]).select(
            "_condition", "_w", (F.col("k") + floor_div(F.col("_w") - F.col("_r"))).alias("k"), (-F.col("n")).alias("n")
        ))
        .unionByName(pairs.select("_condition", "_w", F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("n")))
    )
    steps = (
        edges.withColumn("k", F.greatest("k", F.lit(0).cast("bigint"))).where(F.col("k") < ticks)
        .groupBy("_condition", "_w", "k").agg(F.sum("n").alias("n"))
    )
    along = Window.partitionBy("_condition", "_w").orderBy("k")
    return steps.select(
        "_condition", "_w", "k", F.coalesce(F.lead("k").over(along), F.lit(ticks).cast("bigint")).alias("k_end"),
        F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("ObservedCount"),
    )


def backtest_alerts(rules: DataFrame, logs: DataFrame, start, end, poll_s: int = 30) -> DataFrame:
    """Alert events that polling every ``poll_s`` seconds from start to end would have fired.

    Ticks are ``start, start + poll, ...`` before ``end``; each sees ``[tick - window, tick)``.
    """
    start, end = as_datetime(start), as_datetime(end)
    ticks = max(0, -(-int((end - start).total_seconds()) // poll_s))
    keyed = _usable(rules)
    stretches = _tick_counts(keyed, logs, start, end, poll_s, ticks)
    at = add_seconds(ntz(start), F.col("_k") * F.lit(poll_s))
    breached = lambda rules: rules.join(stretches, ["_condition", "_w"]).where(is_breached())
    # A rule whose cooldown is over by the next tick fires at every breached one; ticks of others are walked in turn.
    waits = F.coalesce(F.max("CooldownSeconds") > poll_s, F.lit(True)) | (F.count(F.lit(1)) > 1)
    named = keyed.where(F.col("Id").isNotNull())
    paced = cut(named.groupBy("Id").agg(waits.alias("_waits")).where("_waits").select("Id"))
    every = lambda rules: breached(rules).withColumn("_k", F.explode(F.sequence("k", F.col("k_end") - 1))).select(*_firing(at))
    if paced.isEmpty():
        return every(named)
    keyed = named.join(paced, "Id", "left_semi")
    schema = T.StructType([rules.schema["Id"], T.StructField("_k", T.LongType()), T.StructField("ObservedCount", T.LongType())])

    def fire(columns, first, last, out):
        ready = 0
        for i in range(first, last):
            wait = max(1, -(-columns["CooldownSeconds"][i] // poll_s))
            tick = max(columns["k"][i], ready)
            while tick < columns["k_end"][i]:
                out["Id"].append(columns["Id"][i])
                out["_k"].append(tick)
                out["ObservedCount"].append(columns["ObservedCount"][i])
                tick = ready = tick + wait

    slim = breached(keyed).select("Id", "CooldownSeconds", "k", "k_end", "ObservedCount")
    fired = map_groups(slim, ["Id"], ["k"], fire, schema).join(
        broadcast_if_small(keyed.select("Id", "Name", "ThresholdComparator", "ThresholdCount", "WindowSeconds")), "Id"
    )
    return every(named.join(paced, "Id", "left_anti")).unionByName(fired.select(*_firing(at)))
