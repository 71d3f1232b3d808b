"""Registered queries over alert rules, alert events and counters."""

from pyspark.sql import Window, functions as F

from beaconry.catalog import tables as t
from beaconry.catalog.tables import oracle
from beaconry.operators import alerts as ops, counters

QUERIES, ORACLES = {}, {}
AT = "2024-01-20 12:00:00"


def register(name, build, tables=None, sql=None):
    QUERIES[name] = build
    if sql:
        ORACLES[name] = oracle(tables, sql)


def current_rules(spark, d):
    """Latest enabled rules; the cooldown varies per rule so that some are cooling down."""
    rules = ops.latest_versions(t.rule_versions(spark, d), tiebreak="InsertOrdinal", enabled_only=True)
    return (
        rules.withColumn("CooldownSeconds", F.lit(3600) * (F.col("Id") % 96))
        .withColumn("Condition", ops.condition(F.array("ConditionService")))
    )


def _with_version(events, versions):
    """Firings with the version of their rule that was current then."""
    version = F.struct("ThresholdCount", "ThresholdComparator")
    changes = versions.select(F.col("Id").alias("RuleId"), F.col("UpdatedAt").cast("timestamp_ntz").alias("at"), F.col("InsertOrdinal").alias("o"), version.alias("v"))
    firings = events.select("RuleId", F.col("FiredAt").alias("at"), F.lit((1 << 63) - 1).alias("o"), "EventId", "ObservedCount")
    along = Window.partitionBy("RuleId").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    both = changes.unionByName(firings, allowMissingColumns=True).withColumn("v", F.last("v", ignorenulls=True).over(along))
    return both.where(F.col("EventId").isNotNull() & F.col("v").isNotNull()).select("EventId", "RuleId", "ObservedCount", "v.*")


RULES = """+r0 AS (SELECT *, row_number() OVER (PARTITION BY Id ORDER BY UpdatedAt DESC, InsertOrdinal DESC) AS rn FROM rule_versions),
    r AS (SELECT * REPLACE (CAST(3600*(Id % 96) AS INT) AS CooldownSeconds) FROM r0 WHERE rn=1 AND NOT IsDeleted AND Enabled)"""
COUNTED = f""", c AS (SELECT r.Id, count(l.EventId) AS n FROM r LEFT JOIN logs l ON l.ServiceName=r.ConditionService
    AND l.Timestamp >= TIMESTAMP '{AT}' - to_seconds(r.WindowSeconds) AND l.Timestamp < TIMESTAMP '{AT}' GROUP BY 1),
    e AS (SELECT r.*, c.n AS ObservedCount, CASE WHEN r.ThresholdComparator='LessThan' THEN c.n < r.ThresholdCount
    ELSE c.n >= r.ThresholdCount END AS Breached FROM r JOIN c USING (Id))"""

register(
    "h1_latest_versions",
    lambda spark, d: ops.latest_versions(t.rule_versions(spark, d), tiebreak="InsertOrdinal").orderBy("Name", "Id"),
    "rule_versions",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY Id ORDER BY UpdatedAt DESC, InsertOrdinal DESC) AS rn
    FROM rule_versions) WHERE rn=1 AND NOT IsDeleted""",
)
register(
    "h1_saved_views",
    lambda spark, d: ops.latest_versions(
        t.rule_versions(spark, d).withColumn("PageType", F.when(F.col("InsertOrdinal") % 3 == 0, "Logs").otherwise("Traces")),
        tiebreak="InsertOrdinal", page_type="Logs").select("Id", "Name", "PageType", "UpdatedAt").orderBy("Name"),
    "rule_versions",
    """SELECT Id, Name, PageType, UpdatedAt FROM (SELECT *, CASE WHEN InsertOrdinal % 3 = 0 THEN 'Logs' ELSE 'Traces' END AS PageType,
    row_number() OVER (PARTITION BY Id ORDER BY UpdatedAt DESC, InsertOrdinal DESC) AS rn FROM rule_versions)
    WHERE rn=1 AND NOT IsDeleted AND PageType='Logs'""",
)
register(
    "h2_count_matching",
    lambda spark, d: ops.count_matching(current_rules(spark, d), t.logs(spark, d), AT).select("Id", "WindowSeconds", "ObservedCount"),
    "rule_versions logs", RULES + COUNTED + " SELECT Id, WindowSeconds, ObservedCount FROM e",
)
register(
    "h3_is_breached",
    lambda spark, d: _with_version(t.alert_events(spark, d), t.rule_versions(spark, d)).select(
        "EventId", "RuleId", "ThresholdCount", "ThresholdComparator", ops.is_breached().alias("Breached")),
    "alert_events rule_versions",
    """SELECT EventId, RuleId, ThresholdCount, ThresholdComparator, CASE WHEN ThresholdComparator='LessThan' THEN ObservedCount < ThresholdCount
    ELSE ObservedCount >= ThresholdCount END AS Breached FROM (
      SELECT e.*, v.ThresholdCount, v.ThresholdComparator, row_number() OVER (PARTITION BY e.EventId ORDER BY v.UpdatedAt DESC, v.InsertOrdinal DESC) AS n
      FROM alert_events e JOIN rule_versions v ON e.RuleId=v.Id AND v.UpdatedAt <= e.FiredAt) WHERE n=1""",
)
LAST = """, f AS (SELECT RuleId, max(FiredAt) AS LastFired FROM alert_events GROUP BY 1)"""
COOLING = f"coalesce(TIMESTAMP '{AT}' - f.LastFired < to_seconds(CooldownSeconds), false)"
register(
    "h4_cooldown",
    lambda spark, d: ops.with_cooldown(current_rules(spark, d), t.alert_events(spark, d).where(F.col("FiredAt") < AT), AT)
    .select("Id", "LastFired", "InCooldown"),
    "rule_versions alert_events",
    RULES + LAST.replace("FROM alert_events", f"FROM alert_events WHERE FiredAt < TIMESTAMP '{AT}'")
    + f" SELECT Id, LastFired, {COOLING} AS InCooldown FROM r LEFT JOIN f ON RuleId=Id",
)
register(
    "h5_evaluate_alerts",
    lambda spark, d: ops.evaluate_alerts(
        current_rules(spark, d), t.logs(spark, d), t.alert_events(spark, d).where(F.col("FiredAt") < AT), AT
    ),
    "rule_versions logs alert_events",
    RULES + COUNTED + LAST.replace("FROM alert_events", f"FROM alert_events WHERE FiredAt < TIMESTAMP '{AT}'")
    + f""" SELECT md5(concat(Id, '|{AT}.000')) AS EventId, Id AS RuleId, Name AS RuleName, TIMESTAMP '{AT}' AS FiredAt,
    ObservedCount, ThresholdCount, WindowSeconds, 'Pending' AS NotificationStatus, 0 AS NotificationStatusCode,
    '' AS NotificationError, concat(':rotating_light: Alert "', Name, '" fired: ', ObservedCount, ' events (',
    CASE WHEN ThresholdComparator='LessThan' THEN '<' ELSE '>=' END, ' ', ThresholdCount, ') in the last ', WindowSeconds, 's') AS Message
    FROM e LEFT JOIN f ON RuleId=Id WHERE Breached AND NOT {COOLING}""",
)
register(
    "h6_test_alert",
    lambda spark, d: ops.test_alert(current_rules(spark, d), t.logs(spark, d), AT),
    "rule_versions logs",
    RULES + COUNTED + f""" SELECT Id, ObservedCount, Breached AS WouldFire, TIMESTAMP '{AT}' AS EvaluatedAt, WindowSeconds FROM e""",
)
register(
    "h7_alert_history",
    lambda spark, d: ops.alert_history(t.alert_events(spark, d), 7),
    "alert_events", "SELECT * FROM alert_events WHERE RuleId=7 ORDER BY FiredAt DESC, EventId DESC LIMIT 50",
)
# The count of every rule at every hourly tick, by two as-of lookups.
TICKS = RULES + """, n0 AS (SELECT ServiceName, Timestamp, count(*) AS n FROM logs GROUP BY 1,2),
    n AS (SELECT ServiceName, Timestamp, sum(n) OVER (PARTITION BY ServiceName ORDER BY Timestamp) AS n FROM n0),
    k AS (SELECT r.*, h, TIMESTAMP '2024-01-01' + to_hours(CAST(h AS INT)) AS at_, TIMESTAMP '2024-01-01' + to_hours(CAST(h AS INT)) - to_seconds(WindowSeconds) AS from_
      FROM r, range(0, 720) x(h)),
    a AS (SELECT k.*, coalesce(n.n, 0) AS upto FROM k ASOF LEFT JOIN n ON k.ConditionService=n.ServiceName AND k.at_ > n.Timestamp),
    b AS (SELECT a.*, CAST(upto - coalesce(n.n, 0) AS BIGINT) AS c FROM a ASOF LEFT JOIN n ON a.ConditionService=n.ServiceName AND a.from_ > n.Timestamp),
    hit AS (SELECT * FROM b WHERE CASE WHEN ThresholdComparator='LessThan' THEN c < ThresholdCount ELSE c >= ThresholdCount END)"""
# The next firing is the first breached tick after the cooldown.
register(
    "h8_backtest_alerts",
    lambda spark, d: ops.backtest_alerts(
        current_rules(spark, d), t.logs(spark, d), "2024-01-01", "2024-01-31", 3600
    ),
    "rule_versions logs",
    TICKS + """, fired AS (WITH RECURSIVE f AS (
        SELECT Id, min(h) AS h, any_value(CooldownSeconds) AS wait FROM hit GROUP BY 1
        UNION ALL SELECT f.Id, min(hit.h), any_value(f.wait) FROM f JOIN hit ON hit.Id=f.Id
          AND hit.h >= f.h + greatest(1, CAST(ceil(f.wait / 3600.0) AS BIGINT)) GROUP BY 1) SELECT Id, h FROM f)
    SELECT md5(concat(Id, '|', strftime(at_, '%Y-%m-%d %H:%M:%S'), '.000')) AS EventId, Id AS RuleId, Name AS RuleName, at_ AS FiredAt,
    c AS ObservedCount, ThresholdCount, WindowSeconds, 'Pending' AS NotificationStatus, 0 AS NotificationStatusCode,
    '' AS NotificationError, concat(':rotating_light: Alert "', Name, '" fired: ', c, ' events (',
    CASE WHEN ThresholdComparator='LessThan' THEN '<' ELSE '>=' END, ' ', ThresholdCount, ') in the last ', WindowSeconds, 's') AS Message
    FROM hit JOIN fired USING (Id, h)""",
)


# With no cooldown every breached tick fires.
register(
    "h8_backtest_every_tick",
    lambda spark, d: ops.backtest_alerts(
        current_rules(spark, d).withColumn("CooldownSeconds", F.lit(0)), t.logs(spark, d), "2024-01-01", "2024-01-31", 3600
    ).groupBy("RuleId").agg(
        F.count(F.lit(1)).alias("Fired"), F.sum("ObservedCount").alias("Observed"),
        F.min("FiredAt").alias("FirstFired"), F.max("FiredAt").alias("LastFired"),
    ),
    "rule_versions logs",
    TICKS + """ SELECT Id AS RuleId, count(*) AS Fired, CAST(sum(c) AS BIGINT) AS Observed, min(at_) AS FirstFired, max(at_) AS LastFired
    FROM hit GROUP BY 1""",
)


def _counters(spark, d):
    """Bytes seen so far per service: a growing counter sampled at every event."""
    return t.sums(spark, d).select("ServiceName", F.col("DataPointAttributes")["event_type"].alias("EventType"), "Time", "Value")


register(
    "n1_counter_rate",
    lambda spark, d: counters.counter_rate(_counters(spark, d), ["ServiceName", "EventType"], "Time", "Value", ["Value"])
    .select("ServiceName", "EventType", "Time", "Value", F.round("Rate", 6).alias("Rate")),
    "sums",
    """+p AS (SELECT ServiceName, DataPointAttributes['event_type'] AS EventType, Time, Value,
      lag(Value) OVER w AS pv, lag(Time) OVER w AS pt FROM sums
      WINDOW w AS (PARTITION BY ServiceName, DataPointAttributes['event_type'] ORDER BY Time, Value))
    SELECT ServiceName, EventType, Time, Value, CASE WHEN pt IS NULL OR Time <= pt THEN 0.0
    ELSE round(greatest(0, (Value-pv)/(epoch_us(Time-pt)/1000000.0)), 6) END AS Rate FROM p""",
)
register(
    "n1_busy_percent",
    lambda spark, d: counters.busy_percent(
        t.read(spark, d, "events").selectExpr(
            "user_id % 20 AS host", "ts", "event_id",
            "event_id * 100 AS total", "event_id * 40 + CAST(value AS BIGINT) AS idle",
        ), ["host"], "ts", "idle", "total", ["event_id"],
    ).select("host", "event_id", F.round("BusyPercent", 6).alias("BusyPercent")),
    "",
    """SELECT host, event_id, round(CASE WHEN pt IS NULL OR total <= pt THEN 0.0
      ELSE least(100.0, greatest(0.0, 100.0*((total-pt)-(idle-pi))/(total-pt))) END, 6) AS BusyPercent FROM (
      SELECT host, event_id, total, idle, lag(total) OVER w AS pt, lag(idle) OVER w AS pi FROM (
        SELECT user_id % 20 AS host, ts, event_id, event_id*100 AS total, event_id*40 + CAST(trunc(value) AS BIGINT) AS idle FROM events)
      WINDOW w AS (PARTITION BY host ORDER BY ts, event_id))""",
)
register(
    "n2_growth_per_day",
    lambda spark, d: counters.growth_per_day(_counters(spark, d), ["ServiceName", "EventType"], "Time", "Value", 29.9 * 86_400)
    .select("ServiceName", "EventType", F.round("PerDay", 6).alias("PerDay"), F.round("SpanHours", 6).alias("SpanHours")),
    "sums",
    """SELECT ServiceName, EventType, CASE WHEN s >= 29.9*86400 AND s > 0 THEN round((b-a)/(s/86400.0),6) END AS PerDay,
    round(s/3600.0,6) AS SpanHours FROM (SELECT ServiceName, DataPointAttributes['event_type'] AS EventType,
    epoch_us(max(Time)-min(Time))/1000000.0 AS s, min_by(Value, Time) AS a, max_by(Value, Time) AS b FROM sums GROUP BY 1,2)""",
)
