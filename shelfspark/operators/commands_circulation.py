"""Reservations, cancellations, loans, returns and the status sync."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_date, lit_date, lit_ntz
from ..functions.intervals import overlap_groups
from ..session import ship_package
from ..sources.fixtures import Library
from .batch import CommandResult, checkpoint, first_failure, first_per_key, merge_rows, new_ids
from .reservations import check_availability


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests sorted by group and batch order: the accepted ones.

    The accepted intervals of a group are apart, so only the last one to start by a request's end can meet it. They are all
    that is carried, at most one for each day of the calendar.
    """
    group, starts, ends = None, [], []
    for b in batches:
        accepted = []
        for i, (k, g, s, e) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_k", "_g", "_s", "_e")), strict=True)):
            if (k, g) != group:
                group, starts, ends = (k, g), [], []
            at = bisect_right(starts, e)
            if at == 0 or ends[at - 1] < s:
                starts.insert(at, s)
                ends.insert(at, e)
                accepted.append(i)
        yield b.select(["cmd_id", "submitted_at"]).take(pa.array(accepted, pa.int64()))


def accept_in_order(cands: DataFrame, key: str = "book_id", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Sequential acceptance of interval requests: ``cmd_id, submitted_at`` of the accepted ones.

    A request is accepted iff no *earlier* (``submitted_at, cmd_id``) accepted
    request of the same key overlaps it, the result of running the requests
    one by one. Of requests for the same days only the first can be accepted, so
    it alone goes on. A key's requests fall into groups that share no day, and
    each group streams through a task in batch order; what it carries is
    bounded by the calendar. Requires start <= end (the callers' checks reject
    other requests first).
    """
    ship_package(cands.sparkSession)
    base = cands.select(F.col(key).alias("_k"), F.unix_date(start).alias("_s"), F.unix_date(end).alias("_e"), F.struct("submitted_at", "cmd_id").alias("_o"))
    first = checkpoint(base.groupBy("_k", "_s", "_e").agg(F.min("_o").alias("_o")).select("_k", "_s", "_e", "_o.*"), "requests")
    rows = first.join(overlap_groups(first, "_k", "_s", "_e", "_g"), ["_k", "_s"])
    ordered = rows.repartition("_k", "_g").sortWithinPartitions("_k", "_g", "submitted_at", "cmd_id")
    return ordered.mapInArrow(_fold, T.StructType([first.schema["cmd_id"], first.schema["submitted_at"]]))


def _reserve(lib: Library, cmds: DataFrame, checks, join_readers: bool, conflict_reason: str,
             reader_col) -> CommandResult:
    av = check_availability(lib, cmds.withColumnRenamed("cmd_id", "req_id"), join_readers, with_holder=False) \
        .withColumnRenamed("req_id", "cmd_id")
    c = checkpoint(av.withColumn("_reader_id", reader_col).withColumn("_pre", first_failure(*checks(av))),
                   "reservation-checks")
    # A request with an id is an accepted one.
    acc = new_ids(accept_in_order(c.where(F.col("_pre").isNull())), ["submitted_at", "cmd_id"], lib.reservations, out="reservation_id")
    c = checkpoint(c.join(acc.select("cmd_id", "reservation_id"), "cmd_id", "left"), "reservation-decisions")
    rows = c.where(F.col("reservation_id").isNotNull()).select(
        F.col("reservation_id").alias("id"), "book_id", F.col("_reader_id").alias("reader_id"), F.col("submitted_at").alias("created_at"),
        "start_date", "end_date", F.lit("pending").alias("status"))
    res = lib.reservations.unionByName(rows, allowMissingColumns=True)
    ok = F.col("reservation_id").isNotNull()
    outcomes = c.select("cmd_id", ok.alias("ok"), F.coalesce("_pre", F.when(~ok, F.lit(conflict_reason))).alias("reason"), "reservation_id")
    return CommandResult({"reservations": res}, outcomes)


def create_reservations(lib: Library, cmds: DataFrame) -> CommandResult:
    """Reader self-service reservations ``(cmd_id, submitted_at, user_id, book_id, start_date, end_date)``.

    Checks in order: dates present, start not before the command's own day,
    end not before start, book exists, user is a reader, book available, no
    overlap with stored reservations; then accepted requests block later
    overlapping ones in the batch.
    """
    rd = lib.readers.groupBy(F.col("user_id").alias("_uid")).agg(F.min("id").alias("_rid"))
    cmds = cmds.join(rd, cmds.user_id == rd._uid, "left").drop("_uid")

    def checks(av):
        return [
            (F.col("start_date").isNotNull() & F.col("end_date").isNotNull(), "Invalid date format"),
            (F.col("start_date") >= F.to_date("submitted_at"), "Start date cannot be in the past"),
            (F.col("end_date") >= F.col("start_date"), "End date must be after start date"),
            (F.col("book_exists"), "Book not found"),
            (F.col("_rid").isNotNull(), "User is not a registered reader"),
            (F.col("book_status") == "available", "Book is not available"),
            (~F.col("has_conflict"), "Book is already reserved"),
        ]
    return _reserve(lib, cmds, checks, True, "Book is already reserved", F.col("_rid"))


def admin_create_reservations(lib: Library, cmds: DataFrame) -> CommandResult:
    """Staff reservations ``(cmd_id, submitted_at, reader_id, book_id, start_date, end_date)``.

    No past-date and no reader check; the conflict check counts every
    non-cancelled reservation (no reader join).
    """
    def checks(av):
        return [
            (F.col("start_date").isNotNull() & F.col("end_date").isNotNull(), "Invalid date format"),
            (F.col("end_date") >= F.col("start_date"), "End date must be after start date"),
            (F.col("book_exists"), "Book not found"),
            (F.col("book_status") == "available", "Book not available"),
            (~F.col("has_conflict"), "Date conflict"),
        ]
    return _reserve(lib, cmds, checks, False, "Date conflict", F.col("reader_id"))


def cancel_reservations(lib: Library, cmds: DataFrame, now: dt.datetime) -> CommandResult:
    """``(cmd_id, submitted_at, reservation_id)``: set 'cancelled' unless 'completed'; cancelling twice succeeds."""
    res = lib.reservations
    ok_ids = res.where(F.col("status") != "completed").select(F.col("id").alias("reservation_id"))
    flagged = cmds.join(ok_ids.withColumn("_ok", F.lit(True)), "reservation_id", "left")
    outcomes = flagged.select("cmd_id", "reservation_id", F.coalesce("_ok", F.lit(False)).alias("ok"),
                              F.when(F.col("_ok").isNull(), F.lit("Reservation not found or cannot be cancelled"))
                              .alias("reason"))
    target = cmds.select(F.col("reservation_id").alias("id")).distinct()
    changed = res.join(target, "id", "left_semi").where(F.col("status") != "completed") \
        .withColumn("status", F.lit("cancelled"))
    return CommandResult({"reservations": merge_rows(res, changed, "id", now)}, outcomes)


def create_loans(lib: Library, cmds: DataFrame, as_of: dt.date | str) -> CommandResult:
    """Loans ``(cmd_id, submitted_at, book_id, reader_id)`` from pending reservations.

    Valid when the book is available and a pending reservation of (book,
    reader) holds ``as_of``; the first valid command per book wins (the book
    is borrowed afterwards); its reservation is the lowest matching id. The
    accepted set inserts loans, marks books borrowed and reservations completed.
    """
    d = lit_date(as_of)
    now = dt.datetime.combine(as_date(as_of), dt.time())
    res = (lib.reservations.where((F.col("status") == "pending") & d.between(F.col("start_date"), F.col("end_date")))
           .groupBy("book_id", "reader_id").agg(F.min("id").alias("_res_id")))
    avail = lib.books.where(F.col("status") == "available").select(F.col("id").alias("book_id"))
    c = cmds.join(res, ["book_id", "reader_id"], "left").join(
        avail.withColumn("_avail", F.lit(True)), "book_id", "left")
    valid = c.where(F.col("_res_id").isNotNull() & F.col("_avail").isNotNull())
    winners = valid.groupBy("book_id").agg(F.min(F.struct("submitted_at", "cmd_id")).alias("_w")) \
        .select(F.col("_w.cmd_id").alias("cmd_id"))
    acc = new_ids(valid.join(winners, "cmd_id", "left_semi"), ["submitted_at", "cmd_id"], lib.loans, out="loan_id")
    loans = lib.loans.unionByName(acc.select(
        F.col("loan_id").alias("id"), "book_id", "reader_id", lit_ntz(now).alias("loan_date"),
        F.lit(None).cast(lib.loans.schema["return_date"].dataType).alias("return_date"),
        F.lit("borrowed").alias("status")), allowMissingColumns=True)
    # Only the columns that change travel to the merge.
    books = merge_rows(lib.books, lib.books.select("id").join(acc.select(F.col("book_id").alias("id")), "id", "left_semi")
                       .withColumn("status", F.lit("borrowed")), "id", now)
    reservations = merge_rows(lib.reservations, lib.reservations.select("id").join(acc.select(F.col("_res_id").alias("id")), "id", "left_semi")
                              .withColumn("status", F.lit("completed")), "id", now)
    outcomes = c.join(acc.select("cmd_id", "loan_id"), "cmd_id", "left").select(
        "cmd_id", F.col("loan_id").isNotNull().alias("ok"),
        F.when(F.col("loan_id").isNull(), F.lit("Invalid loan request")).alias("reason"), "loan_id")
    return CommandResult({"loans": loans, "books": books, "reservations": reservations}, outcomes)


def return_loans(lib: Library, cmds: DataFrame, as_of: dt.date | str) -> CommandResult:
    """``(cmd_id, submitted_at, loan_id)``: borrowed -> returned with ``return_date``; the loan's book becomes available.

    The first command on a borrowed loan succeeds; any other command fails
    with 'Invalid return request'.
    """
    now = dt.datetime.combine(as_date(as_of), dt.time())
    borrowed = lib.loans.where(F.col("status") == "borrowed").select(F.col("id").alias("loan_id"), "book_id", F.lit(True).alias("_out"))
    j = first_per_key(cmds, "loan_id").join(borrowed, "loan_id", "left")
    ok = F.col("_out").isNotNull() & F.col("_first")
    outcomes = j.select("cmd_id", "loan_id", ok.alias("ok"), F.when(~ok, F.lit("Invalid return request")).alias("reason"))
    done = j.where(ok).select("loan_id", "book_id")
    rt = lib.loans.schema["return_date"].dataType
    changed = (lib.loans.select("id").join(done.select(F.col("loan_id").alias("id")), "id", "left_semi")
               .withColumn("status", F.lit("returned")).withColumn("return_date", lit_ntz(now).cast(rt)))
    books = merge_rows(lib.books, lib.books.select("id").join(done.select(F.col("book_id").alias("id")).distinct(), "id", "left_semi")
                       .withColumn("status", F.lit("available")), "id", now)
    return CommandResult({"loans": merge_rows(lib.loans, changed, "id", now), "books": books}, outcomes)


def sync_book_status(lib: Library) -> DataFrame:
    """Books whose id has a borrowed loan get status 'borrowed'; others keep theirs."""
    on_loan = lib.loans.where(F.col("status") == "borrowed").select(F.col("book_id").alias("_b")).distinct()
    j = lib.books.join(on_loan, F.col("id") == F.col("_b"), "left")
    return j.withColumn("status", F.when(F.col("_b").isNotNull(), F.lit("borrowed")).otherwise(F.col("status"))) \
        .drop("_b")
