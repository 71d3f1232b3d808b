"""Estimates from bucketed histograms, as expressions over array columns."""

from pyspark.sql import Column, functions as F

from beaconry.functions.columns import as_column


def _usable(counts: str, bounds: str) -> str:
    return f"coalesce(size({counts}), 0) > 0 AND coalesce(size({bounds}), 0) > 0"


def histogram_quantile(counts: str, bounds: str, q: float | str) -> Column:
    """Linear interpolation inside the first bucket whose cumulative count reaches q·total.

    The open first and last buckets collapse to their one finite bound, an empty bucket
    gives its upper bound. NULL for no data, no bounds, q outside [0, 1], or a bucket
    without any bound (lengths that do not fit together). Arguments are SQL names.
    """
    total = f"aggregate({counts}, 0L, (t, n) -> t + n)"
    # One pass over the buckets remembers the bucket hit, and what was counted before it.
    start = "named_struct('i', 0, 'cum', 0D, 'hit', -1, 'before', 0D, 'n', 0L)"
    reached = "a.hit < 0 AND a.cum + n >= target"
    step = (
        f"named_struct('i', a.i + 1, 'cum', a.cum + n, 'hit', IF({reached}, a.i, a.hit), "
        f"'before', IF({reached}, a.cum, a.before), 'n', IF({reached}, n, a.n))"
    )
    lower = f"get({bounds}, greatest(a.hit - 1, 0))"
    upper = f"coalesce(get({bounds}, a.hit), {lower})"
    finish = (
        f"CASE WHEN a.hit < 0 THEN element_at({bounds}, -1) WHEN a.hit > 0 AND a.hit - 1 >= size({bounds}) THEN NULL "
        f"WHEN a.n = 0 THEN {upper} ELSE {lower} + (target - a.before) / a.n * ({upper} - {lower}) END"
    )
    walk = f"aggregate({counts}, {start}, (a, n) -> {step}, a -> {finish})"
    q = f"CAST({q} AS DOUBLE)"
    return F.expr(
        f"CASE WHEN {q} BETWEEN 0 AND 1 AND {_usable(counts, bounds)} THEN get(transform(array({total}), "
        f"total -> IF(total > 0, get(transform(array({q} * total), target -> {walk}), 0), NULL)), 0) END"
    )


def histogram_max(counts: str, bounds: str) -> Column:
    """Upper bound of the highest non-empty bucket; the last bucket gives the last bound.

    NULL without data or bounds, or when that bucket has no bound. Arguments are SQL names.
    """
    # Buckets empty from the end; the highest non-empty one is the last of the rest.
    from_end = f"array_position(reverse(transform({counts}, n -> n > 0)), true)"
    last = f"CAST(size({counts}) - e AS INT)"
    return F.expr(
        f"CASE WHEN {_usable(counts, bounds)} THEN get(transform(array({from_end}), e -> CASE WHEN e = 0 THEN NULL "
        f"WHEN {last} < size({bounds}) THEN get({bounds}, {last}) WHEN e = 1 THEN element_at({bounds}, -1) END), 0) END"
    )


def histogram_mean(total_sum, total_count) -> Column:
    """Σsum / Σcount, NULL where nothing was counted."""
    total_sum, total_count = as_column(total_sum), as_column(total_count)
    return F.when(total_count > 0, total_sum / total_count)
