"""Severity and span-kind vocabulary."""

from pyspark.sql import Column, functions as F

from beaconry.functions.columns import as_column

# Severity bucket names and the first of their four numbers.
SEVERITY_FLOORS = {"TRACE": 1, "DEBUG": 5, "INFO": 9, "WARN": 13, "ERROR": 17, "FATAL": 21}
ERROR_FLOOR = SEVERITY_FLOORS["ERROR"]

# Span kind labels by number.
SPAN_KINDS = ("unspecified", "internal", "server", "client", "producer", "consumer")


def severity_numbers(bucket: str) -> list[int]:
    """The severity numbers of a bucket name (case-insensitive)."""
    try:
        floor = SEVERITY_FLOORS[bucket.strip().upper()]
    except KeyError:
        raise ValueError(f"unknown severity bucket {bucket!r}") from None
    return list(range(floor, floor + 4))


def in_severity_buckets(number, buckets: list[str]) -> Column:
    return as_column(number).isin([n for b in buckets for n in severity_numbers(b)])


def severity_bucket(number) -> Column:
    """The bucket name of a severity number, ``UNSPECIFIED`` outside 1..24."""
    number = as_column(number)
    names = F.array(*[F.lit(name) for name in SEVERITY_FLOORS])
    index = F.floor((number - 1) / F.lit(4)).cast("int")
    return F.when(number.between(1, 24), F.get(names, index)).otherwise(F.lit("UNSPECIFIED"))


def span_kind_name(kind) -> Column:
    names = F.array(*[F.lit(name) for name in SPAN_KINDS])
    kind = as_column(kind)
    return F.when(kind.between(0, len(SPAN_KINDS) - 1), F.get(names, kind)).otherwise(F.lit(SPAN_KINDS[0]))
