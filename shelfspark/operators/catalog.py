"""Catalogue search, paging and the list filters offered by the client.

Optional predicates are added only when their argument is non-empty, so the
plan carries just the live filters (no ``:p = '' OR ...`` branches). Search
text is matched literally (``%`` and ``_`` are not wildcards).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date
from ..functions.ordering import PagedTable, SortKey, columns_of, page, seek_page
from ..functions.text import contains_ci, full_name
from ..sources.fixtures import Library
from .loans import loan_order, loans_with_due
from .reservations import reservation_order, reservation_rows

TITLE_KEYS = [SortKey("title"), SortKey("id")]


def title_order():
    return columns_of(TITLE_KEYS)


def _books_authors(lib: Library, with_publisher: bool) -> DataFrame:
    b = lib.books
    a = lib.authors.select(F.col("id").alias("_aid"), full_name().alias("author"))
    j = b.join(a, F.col("author_id") == F.col("_aid"))
    if with_publisher:
        p = lib.publishers.select(F.col("id").alias("_pid"), F.col("name").alias("publisher"))
        j = j.join(p, F.col("publisher_id") == F.col("_pid"), "left")
    return j


def _text_filters(df: DataFrame, title: str = "", author: str = "") -> DataFrame:
    if title:
        df = df.where(contains_ci("title", title))
    if author:
        df = df.where(contains_ci("author", author))
    return df


def catalog_rows(lib: Library, title: str = "", author: str = "", isbn: str = "", status: str = "",
                 genre: str = "") -> DataFrame:
    """Filtered catalogue rows of C1 (before paging)."""
    df = _text_filters(_books_authors(lib, True), title, author)
    if isbn:
        df = df.where(F.col("isbn").contains(isbn))
    if status:
        df = df.where(F.col("status") == status)
    if genre:
        df = df.where(F.col("genre") == genre)
    return df.select("id", "title", "isbn", "publication_year", "genre", "status", "description", "author",
                     "publisher")


def catalog_search(lib: Library, title: str = "", author: str = "", isbn: str = "", status: str = "",
                   genre: str = "", page_no: int = 1, per_page: int = 9) -> DataFrame:
    """Catalogue search, sorted by title (then id), one page with total and page count."""
    return page(catalog_rows(lib, title, author, isbn, status, genre), title_order(), page_no, per_page)


def catalog_after(lib: Library, last: dict | None, per_page: int = 9, **filters: str) -> DataFrame:
    """C1 by seeking: the books behind the last one seen (its title and id); ``filters`` as in ``catalog_rows``."""
    return seek_page(catalog_rows(lib, **filters), TITLE_KEYS, last, per_page)


def paged_catalog(lib: Library, ranges: int | None = None, **filters: str) -> PagedTable:
    """C1 stored by ranges of its order, for pages of any depth."""
    return PagedTable(catalog_rows(lib, **filters), TITLE_KEYS, ranges)


def available_books_basic(lib: Library, title: str = "", author: str = "", page_no: int = 1,
                          per_page: int = 10) -> DataFrame:
    """Available books, narrow projection, no publisher."""
    df = _text_filters(_books_authors(lib, False).where(F.col("status") == "available"), title, author)
    return page(df.select("id", "title", "isbn", "status", "author"), title_order(), page_no, per_page)


def available_books_for_reservation(lib: Library, title: str = "", author: str = "", page_no: int = 1,
                                    per_page: int = 9) -> DataFrame:
    """C1's projection for available books that have no borrowed loan."""
    borrowed = lib.loans.where(F.col("status") == "borrowed").select(F.col("book_id").alias("id"))
    df = _books_authors(lib, True).where(F.col("status") == "available").join(borrowed, "id", "left_anti")
    df = _text_filters(df, title, author)
    rows = df.select("id", "title", "isbn", "publication_year", "genre", "status", "description",
                     F.col("author").alias("author_name"), "publisher")
    return page(rows, title_order(), page_no, per_page)


def page_genres(page_df: DataFrame) -> DataFrame:
    """C4: distinct non-empty genres of the current page only (at most one page of rows)."""
    return page_df.where(F.col("genre").isNotNull() & (F.col("genre") != "")).select("genre").distinct()


def page_totals(df: DataFrame, per_page: int) -> DataFrame:
    """Total rows and page count of a filtered list (0 pages when empty)."""
    return df.agg(F.count(F.lit(1)).alias("total_count")).select(
        "total_count", F.ceil(F.col("total_count") / F.lit(per_page)).cast("long").alias("pages"))


def users_list(lib: Library) -> DataFrame:
    """Id, username, email, role (present ordered by username)."""
    return lib.users.select("id", "username", "email", "role")


def loans_filtered(lib: Library, as_of: dt.date | str, status: str = "", overdue: bool | None = None,
                   reader_name: str = "", book_title: str = "", page_no: int = 1,
                   per_page: int = 10) -> DataFrame:
    """The staff loan list (L1 rows) with the client's filters applied server-side."""
    l = loans_with_due(lib, as_of)
    b = lib.books.select(F.col("id").alias("_bid"), "title")
    r = lib.readers.select(F.col("id").alias("_rid"), full_name().alias("reader"))
    df = l.join(b, F.col("book_id") == F.col("_bid")).join(r, F.col("reader_id") == F.col("_rid"))
    if status:
        df = df.where(F.col("status") == status)
    if overdue is not None:
        df = df.where(F.coalesce("is_overdue", F.lit(False)) == F.lit(overdue))
    if reader_name:
        df = df.where(contains_ci("reader", reader_name))
    if book_title:
        df = df.where(contains_ci("title", book_title))
    rows = df.select("id", "title", "reader", "loan_date", "return_date", "status", "due_date", "is_overdue")
    return page(rows, loan_order(), page_no, per_page)


def date_filter_bounds(date_filter: str, as_of: dt.date | str) -> tuple[dt.date, dt.date]:
    """today / tomorrow / this_week / next_week (ISO weeks, Monday first)."""
    d = as_date(as_of)
    monday = d - dt.timedelta(days=d.weekday())
    if date_filter == "today":
        return d, d
    if date_filter == "tomorrow":
        return d + dt.timedelta(days=1), d + dt.timedelta(days=1)
    if date_filter == "this_week":
        return monday, monday + dt.timedelta(days=6)
    if date_filter == "next_week":
        return monday + dt.timedelta(days=7), monday + dt.timedelta(days=13)
    raise ValueError(f"Invalid date filter: {date_filter!r}")


def reservations_filtered(lib: Library, as_of: dt.date | str, status: str = "", reader_name: str = "",
                          book_title: str = "", date_filter: str = "", page_no: int = 1,
                          per_page: int = 10) -> DataFrame:
    """The staff reservation list (V3 rows) with the client's filters; dates test start_date."""
    df = reservation_rows(lib)
    if status:
        df = df.where(F.col("status") == status)
    if reader_name:
        df = df.where(contains_ci("reader", reader_name))
    if book_title:
        df = df.where(contains_ci("title", book_title))
    if date_filter:
        lo, hi = date_filter_bounds(date_filter, as_of)
        df = df.where(F.col("start_date").between(F.lit(lo), F.lit(hi)))
    return page(df, reservation_order(), page_no, per_page)


def split_author_name(lib: Library) -> DataFrame:
    """The edit form's split of "first last" into the first two space tokens, with a lossless flag."""
    a = lib.authors.select("id", "first_name", "last_name", full_name().alias("full_name"))
    parts = F.split("full_name", " ")
    first = F.coalesce(F.get(parts, 0), F.lit(""))
    last = F.coalesce(F.get(parts, 1), F.lit(""))
    return a.select("id", "full_name", first.alias("split_first_name"), last.alias("split_last_name"),
                    ((first == F.col("first_name")) & (last == F.col("last_name"))).alias("lossless"))
