"""V1-V6: reservation lists and availability / conflict checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.intervals import covered, earliest_ending_from
from ..functions.ordering import PagedTable, SortKey, columns_of, page, seek_page
from ..functions.text import full_name
from ..sources.fixtures import Library


def book_reservations(lib: Library) -> DataFrame:
    """V1: non-cancelled reservations of every book (present ordered by book_id, start_date)."""
    return (lib.reservations.where(F.col("status") != "cancelled")
            .select("book_id", "id", "start_date", "end_date", "status"))


def _res_book_author(lib: Library) -> DataFrame:
    b = lib.books.select(F.col("id").alias("_bid"), F.col("title").alias("book_title"),
                         F.col("status").alias("book_status"), F.col("author_id").alias("_aid"))
    a = lib.authors.select(F.col("id").alias("_auth"), full_name().alias("author_name"))
    r = lib.readers.select(F.col("id").alias("_rid"), "user_id")
    res = lib.reservations.where(F.col("status") != "cancelled")
    return (res.join(b, F.col("book_id") == F.col("_bid")).join(a, F.col("_aid") == F.col("_auth"))
            .join(r, F.col("reader_id") == F.col("_rid")))


def user_reservations(lib: Library) -> DataFrame:
    """V2: per user, non-cancelled reservations with title, author, book status and reader id."""
    return _res_book_author(lib).select("user_id", "id", "book_title", "author_name", "start_date", "end_date",
                                        "status", "book_status", "reader_id")


def my_reservations(lib: Library) -> DataFrame:
    """V4: V2 without the reader id and with the self-service column names."""
    return _res_book_author(lib).select("user_id", "id", F.col("book_title").alias("title"),
                                        F.col("author_name").alias("author"), "start_date", "end_date", "status",
                                        "book_status")


def reservation_rows(lib: Library) -> DataFrame:
    """Rows of the staff reservation list (V3, C8): reservation ⋈ book ⋈ reader."""
    b = lib.books.select(F.col("id").alias("_bid"), "title")
    r = lib.readers.select(F.col("id").alias("_rid"), full_name().alias("reader"))
    j = lib.reservations.join(b, F.col("book_id") == F.col("_bid")).join(r, F.col("reader_id") == F.col("_rid"))
    return j.select("id", "start_date", "end_date", "status", "title", "reader")


RESERVATION_KEYS = [SortKey("start_date", descending=True, nulls_first=True), SortKey("id")]


def reservation_order():
    return columns_of(RESERVATION_KEYS)


def reservations_page(lib: Library, page_no: int = 1, per_page: int = 10) -> DataFrame:
    """V3: all reservations, latest start first, one page plus total."""
    return page(reservation_rows(lib), reservation_order(), page_no, per_page)


def reservations_after(lib: Library, last: dict | None, per_page: int = 10) -> DataFrame:
    """V3 by seeking: the reservations behind the last one seen (its start_date and id)."""
    return seek_page(reservation_rows(lib), RESERVATION_KEYS, last, per_page)


def paged_reservations(lib: Library, ranges: int | None = None) -> PagedTable:
    """V3 stored by ranges of its order, for pages of any depth."""
    return PagedTable(reservation_rows(lib), RESERVATION_KEYS, ranges)


def check_availability(lib: Library, requests: DataFrame, join_readers: bool = True, with_holder: bool = True) -> DataFrame:
    """V5: availability of (req_id, book_id, start_date, end_date) requests, in bulk.

    Per request: book_exists, book_status ('not_found' when missing),
    has_conflict (a non-cancelled reservation of the book overlapping the
    closed interval) and, unless left out, current_holder (reader of the
    earliest-starting such reservation, then lowest id). With ``join_readers`` a
    reservation whose reader row is missing does not count, as in the table
    function.
    """
    res = lib.reservations.where(F.col("status") != "cancelled").select(
        F.col("id").cast("long").alias("_res_id"), F.col("book_id").alias("_rbook"), F.col("reader_id").alias("_rreader"),
        F.col("start_date").alias("_rs"), F.col("end_date").alias("_re"))
    known = lib.readers.select(F.col("id").alias("_rreader"), full_name().alias("_holder"))
    counted = res.join(known.select("_rreader"), "_rreader", "left_semi") if join_readers else res
    found = earliest_ending_from(requests, counted, "book_id", "start_date", "_rbook", "_rs", "_re", "_res_id", "_earliest")
    conflict = F.coalesce(F.col("_earliest._rs") <= F.col("end_date"), F.lit(False))
    books = lib.books.select(F.col("id").alias("_bid"), F.col("status").alias("_bstatus"))
    out = found.join(books, F.col("book_id") == F.col("_bid"), "left").select(
        *requests.columns, F.col("_bid").isNotNull().alias("book_exists"),
        F.coalesce("_bstatus", F.lit("not_found")).alias("book_status"),
        conflict.alias("has_conflict"), F.when(conflict, F.col("_earliest._res_id")).alias("_met"))
    if not with_holder:
        return out.drop("_met")
    holders = res.join(known, "_rreader").select("_res_id", F.col("_holder").alias("current_holder"))
    # Requests that meet no reservation go by a hash of their own, or all of them would be the one NULL key of the join.
    spread = F.coalesce("_met", F.xxhash64(*requests.columns))
    return out.join(holders, (spread == F.col("_res_id")) & F.col("_met").isNotNull(), "left").drop("_met", "_res_id")


def conflict_dates(lib: Library, requests: DataFrame) -> DataFrame:
    """V6: client-side date check of (req_id, user_id, book_id, start_date, end_date) requests.

    ``book_conflict``: the start or end date falls inside a non-cancelled
    reservation of the same book; ``user_conflict``: inside a non-cancelled
    reservation of any book held by one of the user's readers. Both are sweeps
    over days: no (point, reservation) pairs even when one book or user holds
    most reservations, and no rows for the days or weeks of long ones.
    """
    res = lib.reservations.where(F.col("status") != "cancelled").select("book_id", "reader_id", F.col("start_date").alias("_rs"), F.col("end_date").alias("_re"))
    res = res.where(F.col("_rs") <= F.col("_re"))
    rd = lib.readers.select(F.col("id").alias("reader_id"), F.col("user_id").alias("_user"))
    pts = requests.select("req_id", "user_id", "book_id", F.explode(F.array("start_date", "end_date")).alias("_d"))

    def hits(key: str, held: DataFrame, held_key: str, out: str) -> DataFrame:
        inside = covered(pts.select("req_id", F.col(key).alias("_pk"), "_d"), held, "_pk", "_d", held_key, "_rs", "_re")
        return inside.select("req_id").distinct().withColumn(out, F.lit(True))

    out = (requests.join(hits("book_id", res, "book_id", "_bc"), "req_id", "left")
           .join(hits("user_id", res.join(rd, "reader_id"), "_user", "_uc"), "req_id", "left"))
    bc = F.coalesce("_bc", F.lit(False))
    uc = F.coalesce("_uc", F.lit(False))
    return out.select(*requests.columns, bc.alias("book_conflict"), uc.alias("user_conflict"),
                      (bc | uc).alias("has_conflict"))
