from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def as_column(value) -> Column:
    """A column name or a column, as a column."""
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once a row, however many later filters and columns use it.

    The optimizer repeats the expression of a plain column in every filter that it moves below it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
