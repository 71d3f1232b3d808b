"""Prometheus text exposition to samples and metric points.

A scrape is one row: (ScrapeId, Job, Url, TargetLabels, ScrapeTime, Body). TYPE and HELP
lines are looked up inside the scrape's own row before its lines are exploded, so reading
and typing samples needs no shuffle; only folding histograms groups rows.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from beaconry.functions.attributes import NUMBER_PATTERN, sorted_map
from beaconry.functions.columns import as_column, let, once
from beaconry.functions.times import from_unix_milli

# Possessive groups: a line either fits from left to right or is malformed.
_QUOTED = r'"((?>\\["\\n]|[^"])*+)"'
_KEY = r"([^=\s,}][^=\s]*+)"
_PAIR = rf"{_KEY}\s*+=\s*+{_QUOTED}"
_UNGROUPED_PAIR = _PAIR.replace("((?>", "(?:(?>").replace("([^=", "(?:[^=")
_LABELS = rf"\{{[\s,]*+(?:{_UNGROUPED_PAIR}[\s,]*+)*+\}}"
SAMPLE_LINE = rf"^([^{{\s]++)({_LABELS})?\s*+(\S++)(?:\s++([+-]?[0-9]++))?\s*+$"
SUFFIX = r"_(bucket|sum|count)$"
# The characters of \s in these patterns.
_BLANKS = " \t\n\x0b\f\r"
DIRECTIVE_LINE = r"^#\s*(TYPE|HELP) \s*([^ ]+) (.*)$"
# Declared metric types; anything else reads as untyped.
METRIC_TYPES = ("counter", "gauge", "histogram", "summary", "untyped")
CUMULATIVE = "AGGREGATION_TEMPORALITY_CUMULATIVE"
_CUT = "\ufffe"
_PARTS = _CUT.join(("$1", "$2", "$3", "$4"))
_PARKED = "￿"


def sample_value(token: Column) -> Column:
    """The number of a sample token (infinities and NaN included); NULL when it is none."""
    return (
        F.when(token.isin("+Inf", "Inf"), F.lit(float("inf")))
        .when(token == "-Inf", F.lit(float("-inf")))
        .when(token == "NaN", F.lit(float("nan")))
        .when(token.rlike(NUMBER_PATTERN), token.try_cast("double"))
    )


def _unescape(text: Column, quotes: bool) -> Column:
    text = F.replace(text, F.lit("\\\\"), F.lit(_PARKED))
    text = F.replace(text, F.lit("\\n"), F.lit("\n"))
    if quotes:
        text = F.replace(text, F.lit('\\"'), F.lit('"'))
    return F.replace(text, F.lit(_PARKED), F.lit("\\"))


def _last_wins(entries: Column) -> Column:
    """Key-value entries to a map; of repeated keys the last one stays. Sorted, so that an entry is only held against the next."""
    numbered = F.sort_array(F.transform(entries, lambda e, i: F.named_struct(F.lit("key"), e["key"], F.lit("i"), i, F.lit("value"), e["value"])))

    def keep(es):
        last = F.filter(es, lambda e, i: F.coalesce(F.get(es, i + 1)["key"] != e["key"], F.lit(True)))
        return F.map_from_entries(F.transform(last, lambda e: F.named_struct(F.lit("key"), e["key"], F.lit("value"), e["value"])))

    return let(numbered, keep)


def label_lists(block: Column) -> dict[str, Column]:
    """The keys and the escaped values of ``{a="x",b="y"}``, in order; none where there is no block."""
    inner = F.substr(F.coalesce(block, F.lit("")), F.lit(2), F.greatest(F.length(block) - 2, F.lit(0)))
    return {"_keys": F.regexp_extract_all(inner, F.lit(_PAIR), F.lit(1)), "_values": F.regexp_extract_all(inner, F.lit(_PAIR), F.lit(2))}


def label_map(block: Column, keys: Column, values: Column) -> Column:
    """The lists of a block as map. Values are unescaped only where there is a backslash; the last of equal keys is looked for only where keys repeat."""
    plain = F.transform(values, lambda v: F.when(v.contains("\\"), _unescape(v, True)).otherwise(v))
    zipped = lambda vs: F.arrays_zip(keys.alias("key"), vs.alias("value"))
    named = lambda vs: F.transform(zipped(vs), lambda e: F.named_struct(F.lit("key"), e["key"], F.lit("value"), e["value"]))
    return (
        F.when(F.size(F.array_distinct(keys)) < F.size(keys), _last_wins(named(plain)))
        .when(F.coalesce(block, F.lit("")).contains("\\"), F.map_from_entries(F.sort_array(zipped(plain))))
        .otherwise(F.map_from_entries(F.sort_array(zipped(values))))
    )


def _with_directives(scrapes: DataFrame) -> DataFrame:
    lines = F.transform(F.split("Body", "\n"), lambda line: F.trim(line, F.lit(_BLANKS)))
    scrapes = scrapes.withColumn("_lines", lines)
    scrapes = scrapes.withColumn("_comments", F.filter("_lines", lambda l: l.startswith("#") & l.rlike(DIRECTIVE_LINE)))
    kind = lambda v: F.when(F.trim(v).isin(*METRIC_TYPES), F.trim(v)).otherwise("untyped")

    def declared(keyword, value):
        rows = F.filter("_comments", lambda l: F.regexp_extract(l, DIRECTIVE_LINE, 1) == keyword)
        return _last_wins(F.transform(rows, lambda l: F.named_struct(
            F.lit("key"), F.regexp_extract(l, DIRECTIVE_LINE, 2), F.lit("value"), value(F.regexp_extract(l, DIRECTIVE_LINE, 3)))))

    return scrapes.withColumns({
        "_types": declared("TYPE", kind), "_help": declared("HELP", lambda v: _unescape(v, False)),
    }).drop("_comments")


def prometheus_samples(scrapes: DataFrame) -> DataFrame:
    """One row per sample line with its labels, value, time, declared type and help text.

    Blank, comment and malformed lines are skipped. ``Family`` is the name without a
    ``_bucket`` / ``_sum`` / ``_count`` suffix, ``FamilyType`` the type declared for it.
    """
    scrapes = _with_directives(scrapes)
    samples = F.filter("_lines", lambda l: (l != "") & ~l.startswith("#"))

    kept = [c for c in scrapes.columns if c not in ("Body", "_lines", "_types", "_help")]
    rows = scrapes.select(*kept, "_types", "_help", F.posexplode(samples).alias("LineNumber", "_line"))
    # One pass of the line pattern cuts out all parts; a malformed line stays in one piece. Each step is
    # computed once a line, and filters on names and types come before the labels are read.
    parts = F.split(F.regexp_replace("_line", SAMPLE_LINE, _PARTS), _CUT)
    rows = once(rows, _parts=parts).drop("_line")
    part = lambda n: F.get("_parts", n)
    rows = once(rows.where(F.size("_parts") == 4), Name=part(0), Family=F.regexp_replace(part(0), SUFFIX, ""), _block=part(1), Value=sample_value(part(2)), _time=part(3)).drop("_parts")
    stamp = F.when(F.col("_time") != "", F.col("_time").try_cast("bigint"))
    usable = F.col("Value").isNotNull() & ((F.col("_time") == "") | stamp.isNotNull())
    typed = rows.where(usable).select(
        *kept, "LineNumber", "Name", "_block", "Value", stamp.alias("TimestampMs"),
        F.coalesce(F.col("_types")[F.col("Name")], F.lit("untyped")).alias("Type"), F.col("_help")[F.col("Name")].alias("Help"),
        "Family", F.col("_types")[F.col("Family")].alias("FamilyType"), F.col("_help")[F.col("Family")].alias("FamilyHelp"),
    )
    listed = once(typed, **label_lists(F.col("_block")))
    return once(listed, Labels=label_map(F.col("_block"), F.col("_keys"), F.col("_values"))).select(
        *kept, "LineNumber", "Name", "Labels", "Value", "TimestampMs", "Type", "Help", "Family", "FamilyType", "FamilyHelp",
    )


def resource_attributes(job="Job", url="Url", labels="TargetLabels") -> Column:
    """service.name from the job, service.instance.id from the URL, target labels on top."""
    job, url, labels = as_column(job), as_column(url), as_column(labels)
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)
    port = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/:?#]+:([0-9]+)", 1)
    default_port = F.when(url.startswith("https:"), "443").otherwise("80")
    instance = F.concat(host, F.lit(":"), F.when(port != "", port).otherwise(default_port))
    own = F.filter(F.array(
        F.struct(F.lit("service.name").alias("key"), job.alias("value")),
        F.struct(F.lit("service.instance.id").alias("key"), F.when(host != "", instance).alias("value")),
    ), lambda e: e["value"].isNotNull())
    labels = F.coalesce(labels, F.create_map().cast("map<string,string>"))
    free = F.filter(own, lambda e: ~F.map_contains_key(labels, e["key"]))
    return F.map_from_entries(F.concat(free, F.map_entries(labels)))


def _common(name: Column, description: Column, labels: Column, time: Column) -> list[Column]:
    empty, none = F.lit(""), F.create_map().cast("map<string,string>")
    return [
        name.alias("MetricName"), F.coalesce(description, empty).alias("Description"), empty.alias("Unit"),
        F.coalesce(F.col("ResourceAttributes")["service.name"], empty).alias("ServiceName"), empty.alias("ResourceSchemaUrl"),
        "ResourceAttributes", empty.alias("ScopeSchemaUrl"), empty.alias("ScopeName"), empty.alias("ScopeVersion"),
        none.alias("ScopeAttributes"), labels.alias("DataPointAttributes"), time.alias("StartTime"), time.alias("Time"),
    ]


def _is_bucket() -> Column:
    return F.col("Name").endswith("_bucket") & sample_value(F.col("Labels")["le"]).isNotNull()


def _in_histogram() -> Column:
    part = _is_bucket() | F.col("Name").endswith("_sum") | F.col("Name").endswith("_count")
    return (F.coalesce("FamilyType", F.lit("")) == "histogram") & part & (F.col("Name") != F.col("Family"))


def _in_summary() -> Column:
    total = (F.coalesce("FamilyType", F.lit("")) == "summary") & (F.col("Name").endswith("_sum") | F.col("Name").endswith("_count"))
    return (F.col("Type") == "summary") | total


class PrometheusFrames(NamedTuple):
    gauge: DataFrame
    sum: DataFrame
    histogram: DataFrame
    unsupported: DataFrame


def _count(value: Column) -> Column:
    """A count from a double: 0 for NaN and negative values, infinity as the largest bigint a double can be."""
    capped = F.least(F.rint(value), F.lit(float((1 << 63) - 1024)))
    return F.when(F.isnan(value) | (value < 0), F.lit(0).cast("bigint")).otherwise(capped.cast("bigint"))


def prometheus_histograms(samples: DataFrame) -> DataFrame:
    """Bucket, sum and count lines folded per (scrape, family, labels without ``le``).

    Cumulative buckets become counts per bucket (a decrease counts as 0), finite ``le``
    values become the bounds, a missing count falls back to the last cumulative value.
    """
    labels = sorted_map(F.map_filter("Labels", lambda k, v: k != "le"))
    rows = samples.where(_in_histogram()).withColumns({
        "_labels": F.when(_is_bucket(), labels).otherwise(sorted_map("Labels")),
        "_role": F.substring_index("Name", "_", -1),
        "_target": F.struct("Job", "Url", F.sort_array(F.map_entries("TargetLabels")).alias("TargetLabels")),
    })
    when = lambda role, value: F.when(F.col("_role") == role, value)
    last = lambda role: F.max(when(role, F.struct("LineNumber", "Value")))["Value"]
    timed = F.when(F.col("TimestampMs").isNotNull(), F.struct("LineNumber", "TimestampMs"))
    # A group is one histogram of one scrape, so its lists are as short as its bucket list.
    folded = rows.groupBy("ScrapeId", "Family", "_labels").agg(
        F.sort_array(F.collect_list(when("bucket", F.struct(
            sample_value(F.col("Labels")["le"]).alias("le"), F.col("LineNumber"), F.col("Value").alias("v")
        )))).alias("b"),
        last("sum").alias("_sum"), last("count").alias("_count"), F.min(timed)["TimestampMs"].alias("_ms"),
        F.collect_set("_target").alias("_targets"), F.min("FamilyHelp").alias("_help"), F.min("ScrapeTime").alias("ScrapeTime"),
    )
    # One target, unless scrapes share their id.
    resources = F.transform("_targets", lambda x: F.to_json(sorted_map(resource_attributes(x["Job"], x["Url"], F.map_from_entries(x["TargetLabels"])))))
    folded = once(folded, ResourceAttributes=F.from_json(F.array_min(resources), "map<string,string>"))
    delta = lambda x, i: x["v"] - F.when(i == 0, 0.0).otherwise(F.get("b", i - 1)["v"])
    counts = F.transform("b", lambda x, i: _count(delta(x, i)))
    bounds = F.filter(F.transform("b", lambda x: x["le"]), lambda le: le != float("inf"))
    count = F.coalesce("_count", F.get("b", F.size("b") - 1)["v"], F.lit(0.0))
    time = F.coalesce(from_unix_milli(F.col("_ms")), F.col("ScrapeTime"))
    return folded.select(
        *_common(F.col("Family"), F.col("_help"), F.col("_labels"), time), F.lit(CUMULATIVE).alias("AggregationTemporality"),
        _count(count).alias("Count"),
        F.coalesce("_sum", F.lit(0.0)).alias("Sum"), counts.alias("BucketCounts"), bounds.alias("ExplicitBounds"),
    )


def prometheus_points(scrapes: DataFrame) -> PrometheusFrames:
    """Scrapes to gauge, sum and histogram points, and the names of unsupported families.

    Counters become cumulative monotonic sums, gauges and untyped samples gauges; summary
    families are dropped and named.
    """
    samples = prometheus_samples(scrapes)
    # The resource is computed once a scrape, and carried along by its samples.
    resourced = prometheus_samples(once(scrapes, ResourceAttributes=resource_attributes()))
    single = resourced.where(~_in_histogram() & ~_in_summary())
    time = F.coalesce(from_unix_milli(F.col("TimestampMs")), F.col("ScrapeTime"))
    common = _common(F.col("Name"), F.col("Help"), F.col("Labels"), time)
    # Declared summaries, and samples that carry a histogram's own name.
    declared = _with_directives(scrapes).select(F.explode("_types").alias("MetricName", "t")).where(F.col("t") == "summary")
    bare = samples.where(~_in_histogram() & ~_in_summary() & (F.col("Type") == "histogram"))
    unsupported = declared.select("MetricName").unionByName(bare.select(F.col("Name").alias("MetricName")))
    return PrometheusFrames(
        single.where(F.col("Type").isin("gauge", "untyped")).select(*common, "Value"),
        single.where(F.col("Type") == "counter").select(
            *common, "Value", F.lit(CUMULATIVE).alias("AggregationTemporality"), F.lit(True).alias("IsMonotonic")
        ),
        prometheus_histograms(samples),
        unsupported.distinct(),
    )
