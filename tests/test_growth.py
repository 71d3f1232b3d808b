"""Work that grew faster than it had to: once a row, once a batch, and in Arrow."""

import datetime as dt
import tracemalloc

from pyspark.sql import functions as F

from beaconry.operators import alerts, patterns
from beaconry.sources import otlp, prometheus
from beaconry.streaming import jobs
from tests.test_alerts import NOW, breached, brute_count, make_logs, make_rules


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def scrapes(spark, body):
    return spark.createDataFrame(
        [(1, "shop", "http://h:1/m", {}, dt.datetime(2024, 1, 1), body)],
        "ScrapeId long, Job string, Url string, TargetLabels map<string,string>, ScrapeTime timestamp_ntz, Body string")


def test_lines_and_labels_are_read_once(spark):
    body = '# TYPE g gauge\ng{ a = "x\\"=\\\\" ,b="1",a="\\n"} 5\nbad{ 1\ng{c="",b="z"} 6 7\nh{} 1'
    frames = prometheus.prometheus_points(scrapes(spark, body))
    # Keys and values, and the parts of a line: one pass each, none again in a filter.
    plan = optimized(frames.gauge)
    assert plan.count("regexp_extract_all(") == 2 and plan.count(prometheus.SAMPLE_LINE) == 1
    assert optimized(frames.histogram).count("regexp_extract_all(") == 2
    rows = sorted((r.MetricName, r.Value, r.DataPointAttributes) for r in frames.gauge.collect())
    assert rows == [("g", 5.0, {"a": "\n", "b": "1"}), ("g", 6.0, {"b": "z", "c": ""}), ("h", 1.0, {})]


def test_rules_without_a_wait_need_no_walk(spark):
    logs, rows = make_logs(spark, 300, 2)
    rules, raw = make_rules(spark, windows=(95, 3600))
    start, poll = NOW - dt.timedelta(hours=3), 300

    def got(cooldown):
        return alerts.backtest_alerts(rules.withColumn("CooldownSeconds", cooldown), logs, start, NOW, poll)

    def expected(cooldown):
        out = set()
        for rule in (r for r in raw if r[1] != "broken"):
            last = None
            for tick in (start + dt.timedelta(seconds=k * poll) for k in range(36)):
                n = brute_count(rule, rows, tick)
                if breached(rule, n) and (last is None or (tick - last).total_seconds() >= cooldown(rule[0])):
                    out.add((rule[0], tick, n))
                    last = tick
        return out

    every = got(F.lit(poll))
    assert "MapInArrow" not in optimized(every)
    fired = lambda df: sorted((r.RuleId, r.FiredAt, r.ObservedCount) for r in df.collect())
    assert fired(every) == sorted(expected(lambda _: poll)) != []
    mixed = got(F.when(F.col("Id") % 2 == 0, 0).otherwise(poll + 1))
    assert fired(mixed) == sorted(expected(lambda i: 0 if i % 2 == 0 else poll + 1))


def test_a_batch_is_decoded_once(spark, tmp_path, monkeypatch):
    requests = ['{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"timeUnixNano":"1704067200000000000","body":{"stringValue":"x"}}]}]}]}', "broken"]
    spark.createDataFrame([(r,) for r in requests], "value string").write.text(str(tmp_path / "in"))
    good, bad = otlp.quarantine(spark.read.text(str(tmp_path / "in")), "logs")
    assert (good.count(), bad.count()) == (1, 1)
    assert optimized(good).count("from_json(") == 1
    plans, write = [], jobs.write_telemetry
    monkeypatch.setattr(jobs, "write_telemetry", lambda rows, *a, **b: (plans.append(optimized(rows)), write(rows, *a, **b)))
    streamed, _ = otlp.quarantine(jobs.read_requests(spark, str(tmp_path / "in")), "logs")
    jobs.append_telemetry(otlp.otlp_logs(streamed), str(tmp_path / "t"), str(tmp_path / "c"), "logs", drain=True).awaitTermination()
    assert len(plans) == 1 and "from_json" not in plans[0]
    assert [r.Body for r in spark.read.parquet(str(tmp_path / "t")).collect()] == ["x"]


def test_tokens_of_a_block_stay_in_arrow():
    texts = [" ".join(f"word{(i * 7 + k) % 5000:05d}" for k in range(499)) + " <*>" for i in range(400)]
    tracemalloc.start()
    codes, words = patterns._coded(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * codes.size
    assert codes.shape == (400, 500) and (codes[:, -1] == 0).all()
    assert [" ".join(words[c].as_py() for c in row) for row in codes[:3]] == texts[:3]
