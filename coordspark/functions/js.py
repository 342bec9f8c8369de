"""Column functions with the loose-typing rules of the source system's data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    """Strip all Unicode white space."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def blank(c: Column | str) -> Column:
    """Null, empty or white space only."""
    return col(c).isNull() | (F.length(trim(c)) == 0)


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """Halves go up, also below zero."""
    scale = 10**digits
    value = F.floor(col(c) * scale + 0.5)
    return value if digits == 0 else value / scale


def or_default(c: Column | str, default: Column) -> Column:
    """Null, zero and the empty string give way to the default."""
    c = col(c)
    return F.when(c.isNull() | (c.cast("string").isin("", "0", "0.0")), default).otherwise(c)


def parse_float(c: Column | str) -> Column:
    """The numeric prefix of a string, or null."""
    return F.regexp_extract(col(c), _NUMBER, 1).try_cast("double")


def not_set(c: Column | str) -> Column:
    return F.when(col(c).isNull() | (col(c) == ""), "(not set)").otherwise(trim(c))
