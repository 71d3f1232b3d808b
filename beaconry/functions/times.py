"""Time arithmetic on TIMESTAMP_NTZ columns, independent of the session zone.

``date_trunc`` and ``timestampdiff`` go through the session zone; a window start and an
interval cast do not.
"""

import datetime as dt

from pyspark.sql import Column, functions as F

from beaconry.functions.columns import as_column

EPOCH = dt.datetime(1970, 1, 1)


def ntz(value) -> Column:
    """A TIMESTAMP_NTZ column from a datetime, an ISO string or a column."""
    if isinstance(value, dt.datetime):
        if value.tzinfo is not None:
            value = value.astimezone(dt.timezone.utc).replace(tzinfo=None)
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(value, str):
        return F.lit(value).cast("timestamp_ntz")
    return value


def bucket_start(ts, width_s: int) -> Column:
    """Start of the epoch-aligned bucket of ``width_s`` seconds that holds ``ts``."""
    if width_s <= 0:
        raise ValueError(f"bucket width must be positive, got {width_s}")
    return F.window(ts, f"{int(width_s)} seconds").getField("start")


def seconds_between(start, end) -> Column:
    """``end - start`` in seconds, exact to the microsecond (decimal)."""
    return (as_column(end) - as_column(start)).cast("interval second").cast("decimal(20,6)")


def us_between(start, end) -> Column:
    """``end - start`` in whole microseconds."""
    return (seconds_between(start, end) * F.lit(1_000_000)).cast("bigint")


def epoch_us(ts) -> Column:
    return us_between(ntz(EPOCH), ts)


def add_us(ts, us) -> Column:
    return F.timestamp_add("MICROSECOND", as_column(us), as_column(ts))


def add_seconds(ts, seconds) -> Column:
    return F.timestamp_add("SECOND", as_column(seconds), as_column(ts))


def from_unix_nano(nano) -> Column:
    """Unix nanoseconds (a bigint column) to a timestamp at microsecond resolution."""
    return add_us(ntz(EPOCH), F.call_function("div", nano, F.lit(1000)))


def from_unix_milli(milli) -> Column:
    return add_us(ntz(EPOCH), milli * F.lit(1000))
