"""Attribute maps: lookups, canonical keys and guarded numeric reads."""

from pyspark.sql import Column, functions as F

from beaconry.functions.columns import as_column

# A decimal number with optional sign, fraction and exponent; nothing a lenient cast adds.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def attribute(bag, key: str) -> Column:
    """``bag[key]``, with ``''`` for a missing key."""
    return F.coalesce(as_column(bag)[key], F.lit(""))


def sorted_map(bag) -> Column:
    """The same map with its entries in key order, so equal maps compare equal."""
    return F.map_from_entries(F.sort_array(F.map_entries(as_column(bag))))


def canonical_key(bag) -> Column:
    """An order-insensitive text key of a map."""
    return F.to_json(sorted_map(bag))


def numeric_or_null(text) -> Column:
    """``text`` as double when it is a plain decimal number, else NULL."""
    text = as_column(text)
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))
