"""Exact quantiles without sorting a whole column, or a crowded range of it, in one task."""

import math

from pyspark.sql import DataFrame, Window, functions as F

# Relative width of a value bin: one 256th of a factor e. Crowded bins are split into so many.
_BINS_PER_E, _SPLIT = 256, 4096
# Rows of a bin whose values are counted one by one.
SMALL_BIN = 100_000


def _located(counted: list, ranks: set[int]) -> dict[int, object]:
    """The bin of each rank; ``counted`` is in order, with the rows ``before`` each bin."""
    return {rank: next(b for b in counted if b.before <= rank < b.before + b.n) for rank in ranks}


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], small_bin: int = SMALL_BIN) -> DataFrame:
    """One row per name: (Name, Value), linear interpolation between neighbouring ranks.

    Values are counted per logarithmic bin first. A bin that holds a wanted rank and more than
    ``small_bin`` rows is split between its smallest and largest value, again and again, until
    the rank lies in a small bin or among equal values. Every pass is a count with map-side
    combine; only the bins of wanted ranks, two a quantile at most, come to the driver.
    """
    v = F.col(value).cast("double")
    values = df.where(F.col(value).isNotNull()).select(v.alias("v"))
    spark = df.sparkSession
    counts = [F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]
    log_bin = F.floor(F.signum("v") * F.log1p(F.abs("v")) * _BINS_PER_E).cast("bigint")
    bins = values.groupBy(log_bin.alias("b")).agg(*counts)
    # One task over the bins, whose number is bounded by the double format, not by the rows.
    ordered = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bins.withColumns({"total": F.sum("n").over(Window.partitionBy()), "before": F.sum("n").over(ordered) - F.col("n")})
    position = lambda q: F.lit(q) * (F.col("total") - 1)
    holds = F.lit(False)
    for q in quantiles.values():
        for rank in (F.floor(position(q)), F.ceil(position(q))):
            holds = holds | ((rank >= F.col("before")) & (rank < F.col("before") + F.col("n")))
    found = ranked.where(holds).collect()
    schema = "Name string, Value double"
    if not found:
        return spark.createDataFrame([], schema)
    total = found[0].total
    wanted = {name: (math.floor(q * (total - 1)), math.ceil(q * (total - 1)), q * (total - 1) % 1) for name, q in quantiles.items()}
    open_ = {}  # bin (before, n, low, high) -> ranks in it
    for rank, b in _located(found, {r for lo, hi, _ in wanted.values() for r in (lo, hi)}).items():
        open_.setdefault((b.before, b.n, b.low, b.high), set()).add(rank)
    at: dict[int, float] = {}
    while open_:
        crowded, few = {}, {}
        for place, ranks in open_.items():
            before, n, low, high = place
            if low == high or math.isnan(low):
                at |= dict.fromkeys(ranks, high)
            else:
                (crowded if n > small_bin else few)[place] = ranks
        open_ = {}
        # Which bin a value lies in, and where in it; bins are at most two a quantile and do not overlap.
        owner, part = F.lit(None).cast("int"), F.lit(None).cast("double")
        places = [*crowded, *few]
        for i, (_, _, low, high) in enumerate(places):
            inside = (F.col("v") >= low) & (F.col("v") <= high)
            # Halves, so that the width of the widest bin does not overflow.
            share = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * (_SPLIT - 1)
            owner = F.when(inside, i).otherwise(owner)
            part = F.when(inside, F.floor(share).cast("double") if i < len(crowded) else F.col("v")).otherwise(part)
        if not places:
            break
        inner = values.select("v", owner.alias("o"), part.alias("p")).where(F.col("o").isNotNull()).groupBy("o", "p").agg(*counts)
        # Rows here are parts of crowded bins and values of small ones: bounded by the splits and ``small_bin``.
        upto = Window.partitionBy("o").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
        inner = inner.withColumn("upto", F.sum("n").over(upto))
        hit = F.lit(False)
        for i, place in enumerate(places):
            for rank in sorted((crowded | few)[place]):
                local = rank - place[0]
                hit = hit | ((F.col("o") == i) & (F.col("upto") > local) & (F.col("upto") - F.col("n") <= local))
        for row in inner.where(hit).collect():
            place = places[row.o]
            start = place[0] + row.upto - row.n
            ranks = {r for r in (crowded | few)[place] if start <= r < start + row.n}
            if row.o < len(crowded):
                open_.setdefault((start, row.n, row.low, row.high), set()).update(ranks)
            else:
                at |= dict.fromkeys(ranks, row.high)
    rows = [(name, at[lo] * (1 - share) + at[hi] * share if share else at[lo]) for name, (lo, hi, share) in wanted.items()]
    return spark.createDataFrame(rows, schema)
