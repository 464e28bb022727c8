"""M1, M2: the two materialized views, as batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.fixtures import Library


def reader_summary(lib: Library, loans: DataFrame | None = None, readers: DataFrame | None = None,
                   users: DataFrame | None = None) -> DataFrame:
    """M1: readers ⋈ users ⟕ loans with total and active loan counts per reader."""
    l = loans if loans is not None else lib.loans
    r = readers if readers is not None else lib.readers
    u = users if users is not None else lib.users
    counts = l.groupBy(F.col("reader_id").alias("id")).agg(
        F.count("id").alias("total_loans"), F.count_if(F.col("status") == "borrowed").alias("active_loans"))
    base = r.join(u.select(F.col("id").alias("_uid"), "username"), F.col("user_id") == F.col("_uid")).select(
        "id", "first_name", "last_name", "email", "username")
    j = base.join(counts, "id", "left")
    return j.select("id", "first_name", "last_name", "email", "username",
                    F.coalesce("total_loans", F.lit(0).cast("long")).alias("total_loans"),
                    F.coalesce("active_loans", F.lit(0).cast("long")).alias("active_loans"))


def book_genres(lib: Library, books: DataFrame | None = None) -> DataFrame:
    """M2: distinct non-null genres (sort with ``orderBy('genre')`` when presenting)."""
    b = books if books is not None else lib.books
    return b.where(F.col("genre").isNotNull()).select("genre").distinct()
