import datetime as dt
import json
import random

from pyspark.sql import functions as F

from beaconry.operators import alerts

NOW = dt.datetime(2024, 1, 1, 12)


def make_logs(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(
        i, NOW - dt.timedelta(microseconds=rng.randrange(0, 4 * 3600 * 10**6)), rng.choice(["a", "b", ""]), rng.choice([5, 9, 17]),
        rng.choice(["t1", "t2", ""]), "s", rng.choice(["p1", ""]), rng.choice(["Boom now", "all fine", "x_y%z"]),
        {"k": rng.choice(["1", "2"])} if rng.random() < 0.7 else {}, {"host": rng.choice(["h1", "h2"])},
    ) for i in range(n)]
    df = spark.createDataFrame(
        [(r[0], r[1].isoformat(sep=" "), *r[2:]) for r in rows],
        "EventId int, Timestamp string, ServiceName string, SeverityNumber int, TraceId string, SpanId string, PatternId string, "
        "Body string, LogAttributes map<string,string>, ResourceAttributes map<string,string>")
    return df.withColumn("Timestamp", F.col("Timestamp").cast("timestamp_ntz")), rows


CONDITIONS = [
    {}, {"services": ["a"]}, {"services": ["a", "b", "a"]}, {"severityNumbers": [17, 9]}, {"search": "boom"}, {"search": "X_Y%"},
    {"traceId": "t1", "services": ["b"]}, {"patternId": "p1"}, {"attributes": [{"bag": "log", "key": "k", "value": "1"}]},
    {"attributes": [{"bag": "resource", "key": "host", "value": "h1"}, {"key": "k", "value": ""}]}, {"services": ["nobody"]}, {"spanId": "s", "severityNumbers": []},
]


def make_rules(spark, windows=(60, 600, 7200)):
    rows, i = [], 0
    for c in CONDITIONS:
        for w in windows:
            rows.append((i, f"r{i}", json.dumps(c), 5 + i % 20, "LessThan" if i % 3 == 0 else "GreaterThanOrEqual", w, 300 * (i % 4)))
            i += 1
    rows.append((i, "broken", "{not json", 0, "GreaterThanOrEqual", 600, 0))
    df = spark.createDataFrame(rows, "Id int, Name string, ConditionJson string, ThresholdCount bigint, ThresholdComparator string, WindowSeconds int, CooldownSeconds int")
    return alerts.with_condition(df), rows


def like(term, body):
    import re
    pattern = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in f"%{term}%")
    return re.fullmatch(pattern, body, re.I | re.S) is not None


def matches(c, r):
    _, _, service, severity, trace, span, pattern, body, log, resource = r
    if c.get("services") and service not in c["services"]:
        return False
    if c.get("severityNumbers") and severity not in c["severityNumbers"]:
        return False
    if c.get("traceId") and trace != c["traceId"] or c.get("spanId") and span != c["spanId"] or c.get("patternId") and pattern != c["patternId"]:
        return False
    if c.get("search") and not like(c["search"], body):
        return False
    bags = {"log": log, "resource": resource}
    return all(bags[a.get("bag", "log")].get(a["key"], "") == a["value"] for a in c.get("attributes", []))


def brute_count(rule, rows, now):
    c, window = json.loads(rule[2]), dt.timedelta(seconds=rule[5])
    return sum(now - window <= r[1] < now and matches(c, r) for r in rows)


def breached(rule, n):
    return n < rule[3] if rule[4] == "LessThan" else n >= rule[3]


def test_counts_equal_brute_force(spark):
    logs, rows = make_logs(spark)
    rules, raw = make_rules(spark)
    got = {r.Id: r.ObservedCount for r in alerts.count_matching(rules, logs, NOW).collect()}
    assert got == {r[0]: brute_count(r, rows, NOW) for r in raw if r[1] != "broken"}


def test_window_edges(spark):
    stamps = ["2024-01-01 11:59:00", "2024-01-01 11:58:59.999999", "2024-01-01 12:00:00", "2024-01-01 11:59:59.999999"]
    logs = spark.createDataFrame([(i, s, "a") for i, s in enumerate(stamps)], "EventId int, Timestamp string, ServiceName string").withColumn(
        "Timestamp", F.col("Timestamp").cast("timestamp_ntz"))
    rules, _ = make_rules(spark, windows=(60,))
    rules = rules.where("Id = 1")
    assert alerts.count_matching(rules, logs, NOW).head().ObservedCount == 2


def test_backtest_equals_polling(spark):
    logs, rows = make_logs(spark, 300, 2)
    rules, raw = make_rules(spark, windows=(95, 3600))
    start, poll = NOW - dt.timedelta(hours=3), 300
    ticks = 36
    got = {(r.RuleId, r.FiredAt, r.ObservedCount) for r in alerts.backtest_alerts(rules, logs, start, NOW, poll).collect()}
    expected = set()
    for rule in raw:
        if rule[1] == "broken":
            continue
        last = None
        for k in range(ticks):
            tick = start + dt.timedelta(seconds=k * poll)
            n = brute_count(rule, rows, tick)
            if breached(rule, n) and (last is None or (tick - last).total_seconds() >= rule[6]):
                expected.add((rule[0], tick, n))
                last = tick
    assert got == expected and expected


def test_evaluate_respects_cooldown_and_is_repeatable(spark):
    logs, rows = make_logs(spark)
    rules, raw = make_rules(spark)
    events = spark.createDataFrame([(1, "2024-01-01 11:58:00"), (2, "2024-01-01 01:00:00"), (2, "2024-01-01 11:59:59")], "RuleId int, FiredAt string").withColumn(
        "FiredAt", F.col("FiredAt").cast("timestamp_ntz"))
    last = {1: dt.datetime(2024, 1, 1, 11, 58), 2: dt.datetime(2024, 1, 1, 11, 59, 59)}
    expected = {r[0] for r in raw if r[1] != "broken" and breached(r, brute_count(r, rows, NOW))
                and not (r[0] in last and (NOW - last[r[0]]).total_seconds() < r[6])}
    once, twice = ([tuple(r) for r in alerts.evaluate_alerts(rules, logs, events, NOW).collect()] for _ in range(2))
    assert {r[1] for r in once} == expected and sorted(once) == sorted(twice)


def test_thresholds(spark):
    df = spark.createDataFrame([(n, 5, c) for n in (4, 5, 6) for c in ("GreaterThanOrEqual", "LessThan")], "ObservedCount int, ThresholdCount int, ThresholdComparator string")
    got = [(r.ObservedCount, r.ThresholdComparator, r.b) for r in df.withColumn("b", alerts.is_breached()).collect()]
    assert got == [(n, c, n < 5 if c == "LessThan" else n >= 5) for n in (4, 5, 6) for c in ("GreaterThanOrEqual", "LessThan")]
