"""Loans with due dates and overdue flags as of a chosen day.

``due_date`` is not stored: it is the ``end_date`` of the *completed*
reservation for the same (book, reader). A reader who borrowed the same book
twice has two completed reservations, so such loans fan out; that is the
relational result and it is kept.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lit_date
from ..functions.ordering import PagedTable, SortKey, columns_of, page, seek_page
from ..functions.text import full_name
from ..session import materialize
from ..sources.fixtures import Library


def completed_reservations(lib: Library) -> DataFrame:
    """Right side of the due-date join, filtered before the join (the literal in ON)."""
    return (lib.reservations.where(F.col("status") == "completed")
            .select(F.col("book_id").alias("_rb"), F.col("reader_id").alias("_rr"),
                    F.col("end_date").alias("due_date")))


def loans_with_due(lib: Library, as_of: dt.date | str, loans: DataFrame | None = None) -> DataFrame:
    """Loans ⟕ completed reservations on (book_id, reader_id), plus ``is_overdue``.

    ``is_overdue = status = 'borrowed' AND due_date < as_of`` with SQL three-valued
    logic: a borrowed loan without a due date gives NULL.
    """
    l = loans if loans is not None else lib.loans
    r = completed_reservations(lib)
    j = l.join(r, (l.book_id == r._rb) & (l.reader_id == r._rr), "left").drop("_rb", "_rr")
    return j.withColumn("is_overdue", (F.col("status") == "borrowed") & (F.col("due_date") < lit_date(as_of)))


def _books_titles(lib: Library) -> DataFrame:
    return lib.books.select(F.col("id").alias("_bid"), "title", F.col("author_id").alias("_aid"))


def _reader_names(lib: Library) -> DataFrame:
    return lib.readers.select(F.col("id").alias("_rid"), full_name().alias("reader"),
                              F.col("user_id"))


def _authors(lib: Library) -> DataFrame:
    return lib.authors.select(F.col("id").alias("_auth"), full_name().alias("author"))


LOAN_KEYS = [SortKey("loan_date", descending=True, nulls_first=True), SortKey("id"), SortKey("due_date")]


def loan_order():
    return columns_of(LOAN_KEYS)


def loan_rows(lib: Library, as_of: dt.date | str) -> DataFrame:
    """Rows of the staff loan list: loan with due date ⋈ book ⋈ reader."""
    l = loans_with_due(lib, as_of)
    j = (l.join(_books_titles(lib), l.book_id == F.col("_bid"))
         .join(_reader_names(lib), l.reader_id == F.col("_rid")))
    return j.select("id", "title", "reader", "loan_date", "return_date", "status", "due_date", "is_overdue")


def loans_page(lib: Library, as_of: dt.date | str, page_no: int = 1, per_page: int = 10) -> DataFrame:
    """L1: staff loan list, newest first, one page plus total."""
    return page(loan_rows(lib, as_of), loan_order(), page_no, per_page)


def loans_after(lib: Library, as_of: dt.date | str, last: dict | None, per_page: int = 10) -> DataFrame:
    """L1 by seeking: the loans behind the last one seen (its loan_date, id and due_date)."""
    return seek_page(loan_rows(lib, as_of), LOAN_KEYS, last, per_page)


def paged_loans(lib: Library, as_of: dt.date | str, ranges: int | None = None) -> PagedTable:
    """L1 stored by ranges of its order, for pages of any depth."""
    return PagedTable(loan_rows(lib, as_of), LOAN_KEYS, ranges)


def reader_loans(lib: Library, as_of: dt.date | str) -> DataFrame:
    """L2: every loan with author, due date and overdue flag, keyed by the reader's user id."""
    l = loans_with_due(lib, as_of)
    j = (l.join(_books_titles(lib), l.book_id == F.col("_bid"))
         .join(_authors(lib), F.col("_aid") == F.col("_auth"))
         .join(_reader_names(lib), l.reader_id == F.col("_rid")))
    return j.select("user_id", "id", "title", "author", "loan_date", "return_date", "status",
                    "due_date", "is_overdue")


def active_loans(lib: Library, as_of: dt.date | str) -> DataFrame:
    """L3: L2 restricted to borrowed loans (order: loan_date DESC)."""
    return reader_loans(lib, as_of).where(F.col("status") == "borrowed")


def loan_history(lib: Library, as_of: dt.date | str) -> DataFrame:
    """L4: L2 restricted to returned loans (order: return_date DESC NULLS FIRST)."""
    return reader_loans(lib, as_of).where(F.col("status") == "returned")


def count_per_key(df: DataFrame, key: str, out: str) -> DataFrame:
    """``COUNT(*) OVER (PARTITION BY key)`` as a partial aggregate joined back.

    A window would stream a hot key's whole group through one task; the
    aggregate combines map-side, and AQE broadcasts or splits the join back.
    """
    df = materialize(df, "counted")  # both sides of the join read one result
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias(out))
    return df.join(counts, key)


def loanable_reservations(lib: Library, as_of: dt.date | str) -> DataFrame:
    """Pending reservations whose window holds ``as_of`` on available books with no borrowed loan."""
    d = lit_date(as_of)
    b = lib.books.where(F.col("status") == "available").select(
        F.col("id").alias("book_id"), "title", F.col("author_id").alias("_aid"))
    res = lib.reservations.where((F.col("status") == "pending") & d.between(F.col("start_date"), F.col("end_date")))
    rd = lib.readers.select(F.col("id").alias("reader_id"), full_name().alias("reader_name"))
    borrowed = lib.loans.where(F.col("status") == "borrowed").select("book_id")
    j = (b.join(borrowed, "book_id", "left_anti")
         .join(_authors(lib), F.col("_aid") == F.col("_auth"))
         .join(res.select("book_id", "reader_id", "start_date", "end_date", "created_at"), "book_id")
         .join(rd, "reader_id"))
    rows = j.select(F.col("book_id").alias("id"), "title", "author", "reader_id", "reader_name",
                    "start_date", "end_date", "created_at")
    return count_per_key(rows, "id", "reservation_count")


def loanable_per_reader(lib: Library, as_of: dt.date | str) -> DataFrame:
    """L6 nested: one row per reader with its name and the list of books it can be lent, first reserved first.

    A reader's list is one array; ``loanable_by_reader`` has the same as flat rows.
    """
    l5 = loanable_reservations(lib, as_of)
    book = F.struct("created_at", "id", "title", "author", "start_date", "end_date", "reservation_count")
    # created_at first, so the array sorts by it: unset last, as an ascending SQL sort has it.
    unset = F.struct(F.col("created_at").isNull().alias("unset"), book.alias("book"))
    grouped = l5.groupBy("reader_id", "reader_name").agg(F.sort_array(F.collect_list(unset)).alias("books"))
    return grouped.select("reader_id", "reader_name", F.transform("books", lambda x: x["book"].dropFields("created_at")).alias("books"))


def loanable_by_reader(lib: Library, as_of: dt.date | str) -> DataFrame:
    """L5 grouped by reader, flattened: one row per (reader, book) with the reader's book count."""
    l5 = loanable_reservations(lib, as_of).select(
        "reader_id", "reader_name", F.col("id").alias("book_id"), "title", "author", "start_date", "end_date")
    return count_per_key(l5, "reader_id", "books_for_reader")
