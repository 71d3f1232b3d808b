"""Trace structure and service dependencies, for all traces of a table at once.

Walks over a trace run next to each other in Python tasks as long as the trace has at
most ``MAX_SPANS_PER_TASK`` spans. In larger traces (found by a count per trace) values are
composed along the paths from the root instead (``plans.trees``), in about log2(depth) joins
and with the same result. Both ways see one row of a repeated span id, the first by
(StartTime, ParentSpanId, EndTime).
"""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from beaconry.functions.attributes import attribute
from beaconry.functions.times import epoch_us, us_between
from beaconry.plans.grouped import map_groups
from beaconry.plans.lineage import cut
from beaconry.plans.ordered import preceding_min, running_total
from beaconry.plans.sizing import broadcast_if_small
from beaconry.plans.skew import HOT_ROWS, join_unique
from beaconry.plans.trees import along_paths, tree_sizes

MAX_SPANS_PER_TASK = 20_000
ERROR_STATUS = "STATUS_CODE_ERROR"


def effective_service(prefix: str = "") -> Column:
    """``peer.service`` when set, else the span's service, else ``unknown``."""
    peer = attribute(f"{prefix}SpanAttributes", "peer.service")
    own = F.col(f"{prefix}ServiceName")
    return F.when(peer != "", peer).when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.lit("unknown"))


def unique_spans(spans: DataFrame, **columns: Column) -> DataFrame:
    """(TraceId, SpanId, columns) of the first row of every span id, by (StartTime, ParentSpanId, EndTime)."""
    order = ["StartTime", F.coalesce("ParentSpanId", F.lit("")).alias("parent"), "EndTime"]
    first = F.min(F.struct(*order, *[c.alias(name) for name, c in columns.items()])).alias("_first")
    return spans.where(F.col("SpanId") != "").groupBy("TraceId", "SpanId").agg(first).select(
        "TraceId", "SpanId", *[F.col(f"_first.{name}") for name in columns]
    )


def parent_child(spans: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every span with its resolved parent; ``IsRoot`` when no such parent exists."""
    parents = unique_spans(spans, p=F.struct("ServiceName", "Name")).withColumnRenamed("SpanId", "ParentSpanId")
    # Root spans name no parent: they need no partner and no shuffle.
    named = F.coalesce("ParentSpanId", F.lit("")) != ""
    roots = spans.where(~named).withColumn("p", F.lit(None).cast(parents.schema["p"].dataType))
    children = join_unique(spans.where(named), parents, ["TraceId", "ParentSpanId"], hot_rows=hot_rows)
    return roots.unionByName(children).select(
        *[F.col(c) for c in spans.columns],
        F.col("p").isNull().alias("IsRoot"),
        F.col("p")["ServiceName"].alias("ParentService"), F.col("p")["Name"].alias("ParentName"),
    )


def trace_summary(spans: DataFrame) -> DataFrame:
    """Start, end, total (at least 1 ms), span and error count per trace."""
    summary = spans.groupBy("TraceId").agg(
        F.min("StartTime").alias("StartTime"), F.max("EndTime").alias("EndTime"),
        F.count(F.lit(1)).alias("SpanCount"), F.count_if(F.col("StatusCode") == ERROR_STATUS).alias("ErrorCount"),
    )
    total = us_between("StartTime", "EndTime") / F.lit(1000.0)
    return summary.withColumn("TotalMs", F.greatest(F.lit(1.0), total))


def service_nodes(spans: DataFrame, by_trace: bool = False) -> DataFrame:
    """Spans, errors, summed duration and operation names per effective service.

    Operations are reduced to distinct names before they are listed.
    """
    keys = ["TraceId", "Service"] if by_trace else ["Service"]
    named = spans.withColumn("Service", effective_service())
    per_name = named.groupBy(*keys, "Name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("StatusCode") == ERROR_STATUS).alias("e"),
        F.sum("DurationNano").alias("d"),
    )
    return per_name.groupBy(*keys).agg(
        F.sum("n").alias("SpanCount"), F.sum("e").alias("ErrorCount"), F.sum("d").alias("TotalDurationNano"),
        F.array_sort(F.collect_list(F.when(F.col("Name") != "", F.col("Name")))).alias("Operations"),
    )


def service_edges(spans: DataFrame, by_trace: bool = False) -> DataFrame:
    """Calls and summed child duration between different effective services."""
    slim = spans.select("TraceId", "ParentSpanId", "DurationNano", effective_service().alias("Target"))
    # Children are counted per parent and service first, so a parent with very many of them
    # reaches the join as a few rows.
    children = slim.where(F.col("ParentSpanId") != "").groupBy("TraceId", "ParentSpanId", "Target").agg(
        F.count(F.lit(1)).alias("n"), F.sum("DurationNano").alias("d")
    )
    # One parent per id: a repeated id must not multiply its children.
    parents = unique_spans(spans, Source=effective_service()).withColumnRenamed("SpanId", "ParentSpanId")
    crossing = children.join(parents, ["TraceId", "ParentSpanId"]).where(F.col("Source") != F.col("Target"))
    keys = ["TraceId", "Source", "Target"] if by_trace else ["Source", "Target"]
    return crossing.groupBy(*keys).agg(F.sum("n").alias("CallCount"), F.sum("d").alias("TotalDurationNano"))


def _split_oversized(spans: DataFrame, limit: int):
    """(traces walked in tasks, traces walked with joins or None)."""
    oversized = spans.groupBy("TraceId").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("TraceId")
    oversized = cut(oversized)
    if oversized.isEmpty():
        return spans, None
    hint = broadcast_if_small(oversized)
    return spans.join(hint, "TraceId", "left_anti"), spans.join(hint, "TraceId", "left_semi")


def _slim(spans: DataFrame) -> DataFrame:
    return spans.select(
        "TraceId", "SpanId", F.coalesce("ParentSpanId", F.lit("")).alias("ParentSpanId"),
        epoch_us(F.col("StartTime")).alias("s"), epoch_us(F.col("EndTime")).alias("e"),
    )


# The first row of an id in this order is the one _one_per_id keeps.
_WALK_ORDER = ["s", "SpanId", "ParentSpanId", "e"]


def _tree(ids, parents, first, last):
    """Row numbers of the roots, and of the children of every span id, in row order; one row per id."""
    known = set(ids[first:last])
    roots, children, seen = [], {}, set()
    for i in range(first, last):
        if ids[i] in seen:
            continue
        seen.add(ids[i])
        parent = parents[i]
        if parent and parent in known:
            children.setdefault(parent, []).append(i)
        else:
            roots.append(i)
    return roots, children


WATERFALL = T.StructType([
    T.StructField("TraceId", T.StringType()), T.StructField("SpanId", T.StringType()),
    T.StructField("ParentSpanId", T.StringType()), T.StructField("Depth", T.IntegerType()),
    T.StructField("Ordinal", T.LongType()),
])


def _waterfall_of_trace(columns, first, last, out):
    ids, parents = columns["SpanId"], columns["ParentSpanId"]
    roots, children = _tree(ids, parents, first, last)
    pending = [(i, 0) for i in reversed(roots)]
    seen = set()
    while pending:
        i, depth = pending.pop()
        if ids[i] in seen:
            continue
        out["TraceId"].append(columns["TraceId"][i])
        out["SpanId"].append(ids[i])
        out["ParentSpanId"].append(parents[i])
        out["Depth"].append(depth)
        out["Ordinal"].append(len(seen))
        seen.add(ids[i])
        pending.extend((child, depth + 1) for child in reversed(children.get(ids[i], ())))


def _one_per_id(slim: DataFrame) -> DataFrame:
    """The earliest row of every span id (walks visit an id once)."""
    first = F.min(F.struct("s", "ParentSpanId", "e")).alias("r")
    return slim.groupBy("TraceId", "SpanId").agg(first).select("TraceId", "SpanId", "r.*")


def _rooted(slim: DataFrame) -> DataFrame:
    ids = slim.select("TraceId", F.col("SpanId").alias("ParentSpanId"), F.lit(True).alias("_found"))
    return slim.join(ids.where(F.col("ParentSpanId") != ""), ["TraceId", "ParentSpanId"], "left").withColumn(
        "_root", F.col("_found").isNull()
    ).drop("_found")


def _forest(slim: DataFrame) -> DataFrame:
    """One row per span id, with the parent's id as ``up``, null for roots."""
    rooted = _rooted(_one_per_id(slim))
    return cut(rooted.withColumn("up", F.when(~F.col("_root"), F.col("ParentSpanId"))).drop("_root"))


def _waterfall_by_doubling(slim: DataFrame) -> DataFrame:
    """A span comes behind its parent and the subtrees of its earlier siblings: sizes first, then sums along paths."""
    spans = _forest(slim)
    sized = spans.join(tree_sizes(spans, ["TraceId"], "SpanId", "up"), ["TraceId", "SpanId"])
    # Roots of a trace are siblings of each other.
    ordered = running_total(sized, ["TraceId", "up"], ["s", "SpanId"], "Size", "_upto")
    step = F.col("_upto") - F.col("Size") + F.when(F.col("up").isNull(), 0).otherwise(1)
    steps = ordered.select("TraceId", "SpanId", "up", "ParentSpanId", F.col("Depth").cast("int").alias("Depth"), step.cast("bigint").alias("Ordinal"))
    placed = along_paths(steps, ["TraceId"], "SpanId", "up", lambda above, own: {"Ordinal": above("Ordinal") + own("Ordinal")})
    return placed.select(*[f.name for f in WATERFALL])


def trace_waterfall(spans: DataFrame, max_spans: int = MAX_SPANS_PER_TASK) -> DataFrame:
    """Parent-before-child order with depth; siblings by start; unknown parents are roots.

    Spans that no root reaches (a parent cycle) have no place in the tree and are left out.
    """
    usual, oversized = _split_oversized(_slim(spans), max_spans)
    rows = map_groups(usual, ["TraceId"], _WALK_ORDER, _waterfall_of_trace, WATERFALL)
    return rows if oversized is None else rows.unionByName(_waterfall_by_doubling(oversized))


CRITICAL = T.StructType([
    T.StructField("TraceId", T.StringType()), T.StructField("SpanId", T.StringType()),
    T.StructField("RootSpanId", T.StringType()), T.StructField("RootDurationUs", T.LongType()),
    T.StructField("ContributionUs", T.LongType()), T.StructField("IsTop", T.BooleanType()),
])


def _critical_path_of_trace(columns, first, last, out):
    ids, starts, ends = columns["SpanId"], columns["s"], columns["e"]
    roots, children = _tree(ids, columns["ParentSpanId"], first, last)
    if not roots:
        return
    root = max(roots, key=lambda i: (ends[i], -i))
    share: dict[str, int] = {}

    def claim(i, low, high):
        if high > low:
            share[ids[i]] = share.get(ids[i], 0) + high - low

    def frame(i, cursor):
        latest_first = sorted(children.get(ids[i], ()), key=lambda c: -ends[c])
        return [i, iter(latest_first), cursor]

    seen, open_frames = {ids[root]}, [frame(root, ends[root])]
    while open_frames:
        top = open_frames[-1]
        i, kids, cursor = top
        for child in kids:
            until = min(ends[child], cursor)
            if until <= starts[child] or ids[child] in seen:
                continue
            claim(i, until, cursor)
            top[2] = min(cursor, starts[child])
            seen.add(ids[child])
            open_frames.append(frame(child, until))
            break
        else:
            claim(i, starts[i], cursor)
            open_frames.pop()

    best = max(share.values(), default=0)
    top_id = next((ids[i] for i in range(first, last) if share.get(ids[i]) == best), None)
    for span_id, us in share.items():
        out["TraceId"].append(columns["TraceId"][root])
        out["SpanId"].append(span_id)
        out["RootSpanId"].append(ids[root])
        out["RootDurationUs"].append(ends[root] - starts[root])
        out["ContributionUs"].append(us)
        out["IsTop"].append(span_id == top_id)


def _critical_path_by_doubling(slim: DataFrame) -> DataFrame:
    """Where the cursor enters every span, from conditions along its path; then what each span keeps for itself.

    Children are visited latest end first, and those before a child can only move the cursor to
    their smallest start, whether they are visited or not. So the cursor enters a span at the
    least of the ends, and of these starts, on its path; and a span is visited if, for it and all
    above it, the cursor enters after its start. Both compose along paths.
    """
    spans = _forest(slim)
    latest = F.min_by(F.struct("SpanId", "s", "e"), F.struct((-F.col("e")).alias("o"), "s", "SpanId")).alias("r")
    roots = cut(spans.where(F.col("up").isNull()).groupBy("TraceId").agg(latest).select("TraceId", "r.*"))
    kids = preceding_min(
        spans.where(F.col("up").isNotNull() & (F.col("e") > F.col("s"))), ["TraceId", "up"], [F.desc("e"), "s", "SpanId"], "s", "m")
    enters = F.least("e", "m")
    nodes = kids.select(
        "TraceId", "SpanId", "up", F.col("up").alias("parent"), "s", "m", enters.alias("c"), F.col("s").alias("need"), (enters > F.col("s")).alias("ok")
    ).unionByName(roots.select(
        "TraceId", "SpanId", F.lit(None).cast("string").alias("up"), F.lit(None).cast("string").alias("parent"), "s",
        F.lit(None).cast("bigint").alias("m"), F.col("e").alias("c"), F.lit(-(1 << 63)).cast("bigint").alias("need"), F.lit(True).alias("ok")))
    visited = cut(along_paths(nodes, ["TraceId"], "SpanId", "up", lambda above, own: {
        "c": F.least(above("c"), own("c")), "need": F.greatest(above("need"), own("need")),
        "ok": above("ok") & own("ok") & (above("c") > own("need")),
    }).where("ok"))
    children = visited.where(F.col("parent").isNotNull()).join(
        visited.select("TraceId", F.col("SpanId").alias("parent"), F.col("c").alias("c0")), ["TraceId", "parent"])
    gaps = children.groupBy("TraceId", F.col("parent").alias("SpanId")).agg(
        F.sum(F.least("c0", "m") - F.col("c")).alias("g"), F.min("s").alias("low"))
    tail = F.greatest(F.lit(0), F.least("c", "low") - F.col("s"))
    share = visited.join(gaps, ["TraceId", "SpanId"], "left").select(
        "TraceId", "SpanId", "s", (F.coalesce("g", F.lit(0)) + tail).alias("us")).where(F.col("us") > 0)
    # The top contributor is the first span, in span order, with the largest share.
    top = share.groupBy("TraceId").agg(
        F.min_by("SpanId", F.struct((-F.col("us")).alias("a"), F.col("s"), F.col("SpanId"))).alias("t")
    )
    names = roots.select(
        "TraceId", F.col("SpanId").alias("RootSpanId"), (F.col("e") - F.col("s")).alias("RootDurationUs")
    )
    return share.join(names, "TraceId").join(top, "TraceId").select(
        "TraceId", "SpanId", "RootSpanId", "RootDurationUs", F.col("us").alias("ContributionUs"),
        (F.col("SpanId") == F.col("t")).alias("IsTop"),
    )


def critical_path(spans: DataFrame, max_spans: int = MAX_SPANS_PER_TASK) -> DataFrame:
    """Which spans, and how much of each, determined when their trace finished.

    Starting at the latest-ending root, children are visited latest end first. A gap before
    a child's end is the parent's own time; a child counts only up to the cursor.
    """
    usual, oversized = _split_oversized(_slim(spans), max_spans)
    rows = map_groups(usual, ["TraceId"], _WALK_ORDER, _critical_path_of_trace, CRITICAL)
    return rows if oversized is None else rows.unionByName(_critical_path_by_doubling(oversized))
