"""Text expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ascii_lower(value: Column | str) -> Column:
    """Lower case for A-Z only, the folding that LIKE is defined with here."""
    return F.translate(_col(value), string.ascii_uppercase, string.ascii_lowercase)


def contains_pattern(text: Column, pattern: Column) -> Column:
    """``text LIKE '%' || pattern || '%'`` without case, % and _ being wildcards.

    A pattern without wildcards is a plain substring search; LIKE would compile an expression
    per row. A backslash is an ordinary character, so it is doubled for Spark's default escape.
    """
    text, pattern = ascii_lower(text), ascii_lower(pattern)
    escaped = F.replace(pattern, F.lit("\\"), F.lit("\\\\"))
    wild = F.contains(pattern, F.lit("%")) | F.contains(pattern, F.lit("_"))
    return F.when(wild, F.like(text, F.concat(F.lit("%"), escaped, F.lit("%")))).otherwise(
        F.contains(text, pattern)
    )


def or_na(value: Column | str) -> Column:
    """The text, or N/A when it is missing or empty."""
    return F.coalesce(F.nullif(_col(value), F.lit("")), F.lit("N/A"))


def clean(value: Column | str) -> Column:
    """Trimmed text, '' for NULL."""
    return F.trim(F.coalesce(_col(value), F.lit("")))
