"""Masking of variable parts of log bodies, and template ids."""

from pyspark.sql import Column, functions as F

from beaconry.functions.columns import as_column

WILDCARD = "<*>"

# What is masked, in this order. (?U) makes \b, \d and \s Unicode-aware.
UUID_PATTERN = r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"
HEX_PATTERN = r"(?U)\b(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{6,}\b"
NUMBER_PATTERN = r"(?U)\b\d+(\.\d+)?\b"


def mask_body(body, max_chars: int | None = None) -> Column:
    """UUIDs, hex words and numbers replaced by ``<*>``.

    Whole bodies by default; ``max_chars`` masks only that many leading characters.
    """
    text = F.coalesce(as_column(body), F.lit(""))
    if max_chars is not None:
        text = F.substring(text, 1, max_chars)
    for pattern in (UUID_PATTERN, HEX_PATTERN, NUMBER_PATTERN):
        text = F.regexp_replace(text, pattern, WILDCARD)
    return text


def normalized(masked) -> Column:
    """Masked text with its tokens separated by single blanks."""
    return F.trim(F.regexp_replace(masked, r"(?U)\s+", " "))


def pattern_id(template) -> Column:
    """First 16 hex digits of the template's SHA-256; ``''`` for an empty template."""
    template = as_column(template)
    return F.when(template == "", "").otherwise(F.substring(F.sha2(template.cast("binary"), 256), 1, 16))
