"""Reports over loans, reservations and readers.

The reference writes these as joins followed by COUNT DISTINCT over a double
left-join fan-out and a global RANK. Here each side is pre-aggregated on its
own key before any join (map-side partial aggregation, one row per key per
task), and ranks come from ``functions.ordering.global_rank``.
Loan and reservation ids are primary keys, so COUNT(DISTINCT id) per group
equals COUNT(id) on the un-fanned side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_between, in_period, lit_date
from ..functions.ordering import global_rank
from ..functions.text import full_name
from ..sources.fixtures import Library
from .loans import loans_with_due


def loan_counts(loans: DataFrame, key: str) -> DataFrame:
    """Per ``key``: loans and borrowed loans."""
    return loans.groupBy(key).agg(F.count("id").alias("loans_count"),
                                  F.count_if(F.col("status") == "borrowed").alias("active_loans"))


def reservation_counts(res: DataFrame, key: str) -> DataFrame:
    """Per ``key``: reservations and pending reservations."""
    return res.groupBy(key).agg(F.count("id").alias("reservations_count"),
                                F.count_if(F.col("status") == "pending").alias("pending_reservations"))


def _zero(*cols: str) -> list:
    return [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in cols]


def report_popular_books(lib: Library) -> DataFrame:
    """Per book loans, reservations, active loans, pending reservations and popularity rank."""
    b = lib.books.alias("b")
    a = lib.authors.alias("a")
    base = b.join(a, F.col("b.author_id") == F.col("a.id")).select(
        F.col("b.id").alias("book_id"), F.col("b.title").alias("title"),
        full_name("a.first_name", "a.last_name").alias("author"))
    lc = loan_counts(lib.loans, "book_id")
    rc = reservation_counts(lib.reservations, "book_id")
    j = base.join(lc, "book_id", "left").join(rc, "book_id", "left").select(
        "book_id", "title", "author",
        *_zero("loans_count", "reservations_count", "active_loans", "pending_reservations"))
    return global_rank(j, ["loans_count", "reservations_count"],
                       [F.desc("loans_count"), F.desc("reservations_count")], out="popularity_rank")


def _loan_people(lib: Library, loans: DataFrame) -> DataFrame:
    """Loans joined to book title, author name and reader name/contact."""
    b = lib.books.select(F.col("id").alias("_bid"), "title", F.col("author_id").alias("_aid"))
    a = lib.authors.select(F.col("id").alias("_auth"), full_name().alias("author"))
    r = lib.readers.select(F.col("id").alias("_rid"), full_name().alias("reader"),
                           F.col("email"), F.col("phone_number"))
    return (loans.join(b, F.col("book_id") == F.col("_bid"))
            .join(a, F.col("_aid") == F.col("_auth"))
            .join(r, F.col("reader_id") == F.col("_rid")))


def _days_overdue(as_of) -> "F.Column":
    d = lit_date(as_of)
    return F.when(F.col("due_date") < d, days_between(d, F.col("due_date")))


def report_active_loans(lib: Library, as_of: dt.date | str) -> DataFrame:
    """Borrowed loans with due date, overdue flag, days overdue and overdue rank.

    Rank is ``RANK() OVER (ORDER BY days_overdue DESC NULLS LAST)``; the
    report order is ``is_overdue DESC NULLS FIRST, loan_date DESC``.
    """
    borrowed = lib.loans.where(F.col("status") == "borrowed")
    j = _loan_people(lib, loans_with_due(lib, as_of, borrowed))
    rows = j.select(F.col("id").alias("loan_id"), "title", "author", "reader", "loan_date", "due_date",
                    "is_overdue", _days_overdue(as_of).alias("days_overdue"))
    return global_rank(rows, ["days_overdue"], [F.col("days_overdue").desc_nulls_last()], out="overdue_rank")


def overdue_loans(lib: Library, as_of: dt.date | str) -> DataFrame:
    """Borrowed loans whose completed reservation ended before ``as_of`` (inner due join)."""
    d = lit_date(as_of)
    borrowed = lib.loans.where(F.col("status") == "borrowed")
    due = (lib.reservations.where((F.col("status") == "completed") & (F.col("end_date") < d))
           .select(F.col("book_id").alias("_rb"), F.col("reader_id").alias("_rr"), F.col("end_date").alias("due_date")))
    return borrowed.join(due, (F.col("book_id") == F.col("_rb")) & (F.col("reader_id") == F.col("_rr")))


def report_overdue_loans(lib: Library, as_of: dt.date | str, loans: DataFrame | None = None) -> DataFrame:
    """Overdue borrowed loans with reader contact, most overdue first."""
    j = _loan_people(lib, overdue_loans(lib, as_of) if loans is None else loans)
    return j.select(F.col("id").alias("loan_id"), "title", "author", "reader", "loan_date", "due_date",
                    days_between(lit_date(as_of), F.col("due_date")).alias("days_overdue"),
                    "email", "phone_number")


def report_reader_activity(lib: Library) -> DataFrame:
    """Per reader loans, reservations, active loans and pending reservations."""
    r = lib.readers.select(F.col("id").alias("reader_id"), full_name().alias("reader"), "email",
                           "registration_date")
    j = (r.join(loan_counts(lib.loans, "reader_id"), "reader_id", "left")
         .join(reservation_counts(lib.reservations, "reader_id"), "reader_id", "left"))
    return j.select("reader_id", "reader", "email", "registration_date",
                    *_zero("loans_count", "reservations_count", "active_loans", "pending_reservations"))


def report_period_loans(lib: Library, period: str, as_of: dt.date | str) -> DataFrame:
    """P5: loans made in the period, newest first."""
    l = lib.loans.where(in_period("loan_date", period, as_of))
    j = _loan_people(lib, l)
    return j.select(F.col("id").alias("loan_id"), "title", "author", "reader", "loan_date", "return_date", "status")


def report_period_reservations(lib: Library, period: str, as_of: dt.date | str) -> DataFrame:
    """Reservations created in the period, newest first."""
    r = lib.reservations.where(in_period("created_at", period, as_of))
    j = _loan_people(lib, r)
    return j.select(F.col("id").alias("reservation_id"), "title", "author", "reader", "created_at",
                    "start_date", "end_date", "status")


def report_period_readers(lib: Library, period: str, as_of: dt.date | str) -> DataFrame:
    """Readers registered in the period with their loan and reservation totals.

    Readers are filtered first; the loan and reservation sides are reduced to
    the surviving reader ids (semi join) before they are counted.
    """
    r = lib.readers.where(in_period("registration_date", period, as_of)).select(
        F.col("id").alias("reader_id"), full_name().alias("reader"), "email", "phone_number", "address",
        "registration_date")
    ids = r.select("reader_id")
    lc = lib.loans.join(ids, "reader_id", "left_semi").groupBy("reader_id").agg(F.count("id").alias("total_loans"))
    rc = (lib.reservations.join(ids, "reader_id", "left_semi").groupBy("reader_id")
          .agg(F.count("id").alias("total_reservations")))
    j = r.join(lc, "reader_id", "left").join(rc, "reader_id", "left")
    return j.select("reader_id", "reader", "email", "phone_number", "address", "registration_date",
                    *_zero("total_loans", "total_reservations"))


def report_period_overdue(lib: Library, period: str, as_of: dt.date | str) -> DataFrame:
    """P2 restricted to loans made in the period."""
    l = overdue_loans(lib, as_of).where(in_period("loan_date", period, as_of))
    return report_overdue_loans(lib, as_of, l)


PERIOD_REPORTS = {
    "loans": report_period_loans,
    "reservations": report_period_reservations,
    "readers": report_period_readers,
    "overdue": report_period_overdue,
}


def period_report(lib: Library, report_type: str, period: str, as_of: dt.date | str) -> DataFrame:
    """Dispatch of the period report by type; unknown types are rejected."""
    if report_type not in PERIOD_REPORTS:
        raise ValueError(f"Invalid report type: {report_type!r}")
    return PERIOD_REPORTS[report_type](lib, period, as_of)
