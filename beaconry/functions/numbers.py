"""Culture-invariant text of numbers."""

from pyspark.sql import Column, functions as F


def invariant_double_sql(value: str, name: str = "t") -> str:
    """SQL of the shortest round-trip text of a double: plain for exponents -5..14, else
    like ``1.5E+17`` or ``2E-10``. ``name`` is a lambda variable free in ``value``."""
    t = name
    exponent = f"cast(regexp_extract({t}, 'E(-?[0-9]+)$', 1) as int)"
    digits = f"regexp_extract({t}, 'E-?([0-9]+)$', 1)"
    return (
        f"element_at(transform(array(cast(try_cast({value} as double) as string)), {t} -> CASE "
        f"WHEN {t} NOT LIKE '%E%' THEN regexp_replace({t}, '[.]0$', '') "
        f"WHEN {exponent} BETWEEN -5 AND 14 THEN "
        f"regexp_replace(cast(try_cast({t} as decimal(38,22)) as string), '[.]?0+$', '') "
        f"ELSE concat(regexp_replace(regexp_extract({t}, '^(-?[0-9.]+)E', 1), '[.]0$', ''), "
        f"IF({t} LIKE '%E-%', 'E-', 'E+'), lpad({digits}, greatest(2, length({digits})), '0')) END), 1)"
    )


def invariant_double(column: str) -> Column:
    return F.expr(invariant_double_sql(column))
