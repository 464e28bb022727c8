"""Text expressions with the relational engine's semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pg_concat(*cols: Column | str) -> Column:
    """CONCAT that reads NULL as '' (Spark's ``concat`` returns NULL instead)."""
    return F.concat(*[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols])


def full_name(first: str | Column = "first_name", last: str | Column = "last_name") -> Column:
    """``CONCAT(first, ' ', last)``."""
    return pg_concat(first, F.lit(" "), last)


def contains_ci(col: Column | str, needle: str) -> Column:
    """Case-insensitive substring test; the needle is literal text (no wildcards)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(c).contains(needle.lower())
