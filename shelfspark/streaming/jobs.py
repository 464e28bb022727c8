"""M3-M7 as Structured Streaming jobs.

Each job reads a file stream, runs until the available input is consumed
(``availableNow``) and returns the result table as a DataFrame read back from
its sink in the shared checkpoint folder (never collected to the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import Library, book_changes, loan_changes, reader_changes
from .runner import KeyedTable, newest, run_available
from .sources import circulation_events, file_stream, utc_event_time
from .state import Alternation, Spacing, decide_in_order


# ------------------------------------------------------------------ M3
_PROFILE = "struct<ts: timestamp_ntz, change_id: bigint, deleted: boolean, first_name: string, last_name: string, email: string, username: string>"


def loan_counts(changes: DataFrame) -> DataFrame:
    """What loan changes (old_reader_id, old_status, new_reader_id, new_status; no old or no new reader: insert, delete) do to readers' counts."""
    side = lambda who, sign: F.struct(
        F.col(f"{who}_reader_id").alias("id"), F.lit(sign).cast("long").alias("total_loans"),
        F.when(F.col(f"{who}_status") == "borrowed", sign).otherwise(0).cast("long").alias("active_loans"))
    return changes.select(F.inline(F.array(side("old", -1), side("new", 1)))).where(F.col("id").isNotNull()) \
        .withColumn("profile", F.lit(None).cast(_PROFILE))


def reader_profiles(changes: DataFrame) -> DataFrame:
    """Reader changes (id, ts, change_id, deleted, first_name, last_name, email, username) as rows of the summary; the latest holds."""
    profile = F.struct("ts", "change_id", "deleted", "first_name", "last_name", "email", "username").cast(_PROFILE)
    return changes.select("id", F.lit(0).cast("long").alias("total_loans"), F.lit(0).cast("long").alias("active_loans"), profile.alias("profile"))


def _merged_readers(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.sum("total_loans").alias("total_loans"), F.sum("active_loans").alias("active_loans"),
                                  F.max("profile").alias("profile"))


def maintain_reader_summary(lib: Library, loans: DataFrame, readers: DataFrame | None = None, base: str | None = None,
                            checkpoint: str | None = None) -> DataFrame:
    """M3: keep the reader summary (M1) fresh under streams of loan changes and reader changes (insert, update, delete).

    Counts move by what each change takes and gives, profiles follow the latest
    ``(ts, change_id)``: neither depends on the micro-batches or on late rows.
    """
    spark = lib.spark
    users = lib.users.select(F.col("id").alias("user_id"), "username")
    start = lib.readers.select("id", "user_id", "first_name", "last_name", "email").join(users, "user_id").withColumns(
        {"ts": F.lit("0001-01-01").cast("timestamp_ntz"), "change_id": F.lit(-1).cast("long"), "deleted": F.lit(False)})
    held = lib.loans.select(F.lit(None).cast("long").alias("old_reader_id"), F.lit(None).cast("string").alias("old_status"),
                            F.col("reader_id").alias("new_reader_id"), F.col("status").alias("new_status"))
    table = KeyedTable(spark, "reader_summary", ["id"], _merged_readers, reader_profiles(start).unionByName(loan_counts(held)), base)
    changes = loan_counts(loans) if readers is None else loan_counts(loans).unionByName(reader_profiles(readers))
    run_available(changes.writeStream.foreachBatch(table.apply), spark, "reader_summary", checkpoint)
    return table.current().where(F.col("profile").isNotNull() & ~F.col("profile.deleted")).select(
        "id", "profile.first_name", "profile.last_name", "profile.email", "profile.username", "total_loans", "active_loans")


def stream_reader_summary(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """M3 over the loans that 'borrow' events insert."""
    ev = circulation_events(file_stream(spark, sf_dir, "events", max_files))
    return maintain_reader_summary(Library(spark, sf_dir), loan_changes(ev).where("old_reader_id IS NULL"))


def stream_reader_summary_changes(spark: SparkSession, sf_dir: str, max_files: int | None = None, base: str | None = None,
                                  checkpoint: str | None = None) -> DataFrame:
    """M3 over inserted, returned and deleted loans, and changed and deleted readers."""
    ev = lambda: circulation_events(file_stream(spark, sf_dir, "events", max_files))
    return maintain_reader_summary(Library(spark, sf_dir), loan_changes(ev()), reader_changes(ev()), base, checkpoint)


# ------------------------------------------------------------------ M4
def _merged_genres(rows: DataFrame) -> DataFrame:
    return rows.groupBy("genre").agg(F.sum("n").alias("n"))


def maintain_book_genres(changes: DataFrame, base: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """M4: distinct non-null genres under a stream of book changes (old_genre, new_genre); a genre leaves with its last book."""
    spark = changes.sparkSession
    table = KeyedTable(spark, "book_genres", ["genre"], _merged_genres, base=base)
    side = lambda who, sign: F.struct(F.col(f"{who}_genre").alias("genre"), F.lit(sign).cast("long").alias("n"))
    counts = changes.select(F.inline(F.array(side("old", -1), side("new", 1)))).where(F.col("genre").isNotNull())
    run_available(counts.writeStream.foreachBatch(table.apply), spark, "book_genres", checkpoint)
    genres = table.current()
    return spark.createDataFrame([], "genre string") if genres is None else genres.where("n > 0").select("genre")


def stream_book_genres(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """M4 over inserted books."""
    return maintain_book_genres(book_changes(file_stream(spark, sf_dir, "part", max_files)).where("inserted"))


def stream_book_genres_changes(spark: SparkSession, sf_dir: str, max_files: int | None = None, base: str | None = None,
                               checkpoint: str | None = None) -> DataFrame:
    """M4 over inserted, changed and deleted books."""
    return maintain_book_genres(book_changes(file_stream(spark, sf_dir, "part", max_files)), base, checkpoint)


# ------------------------------------------------------------------ M5
def _timed(events: DataFrame, watermark: str) -> DataFrame:
    return events.withColumn("event_time", utc_event_time("ts")).withWatermark("event_time", watermark)


def _decided(events: DataFrame, rule, name: str, base: str | None, checkpoint: str | None) -> DataFrame | None:
    """Newest decision (event_id, key, kind, accepted) on each event; None before the first."""
    spark = events.sparkSession
    table = KeyedTable(spark, name, ["event_id"], newest("event_id"), base=base)
    decisions = decide_in_order(events, rule)
    run_available(decisions.writeStream.outputMode("update").foreachBatch(
        lambda rows, epoch: table.apply(rows.withColumn("version", F.lit(epoch).cast("long")), epoch)), spark, name, checkpoint)
    return table.current()


def stream_book_status(spark: SparkSession, sf_dir: str, max_files: int | None = None, base: str | None = None,
                       checkpoint: str | None = None, watermark: str = "30 days") -> DataFrame:
    """M5: per book a borrow is accepted only when the book is available, a return only when borrowed.

    After any event the state is fixed by that event's action alone (an
    accepted or a refused borrow both leave the book borrowed), so an event is
    accepted when the one before it had the other action; the first compares
    with 'return' (available). Events come in any order within the watermark, and
    decisions that an earlier event changes are told again; events later than that
    are dropped. State is kept per book (``OrderedFold``), so an epoch costs its events.
    """
    ev = circulation_events(file_stream(spark, sf_dir, "events", max_files)).where(F.col("action").isin("borrow", "return"))
    rows = _timed(ev, watermark).select(F.col("book_id").alias("key"), "event_id", (F.col("action") == "borrow").cast("int").alias("kind"), "event_time")
    out = _decided(rows, Alternation(), "book_status", base, checkpoint)
    if out is None:
        return spark.createDataFrame([], "event_id long, book_id long, action string, accepted boolean, status_after string")
    borrow = F.col("kind") == 1
    return out.select("event_id", F.col("key").alias("book_id"), F.when(borrow, "borrow").otherwise("return").alias("action"), "accepted",
                      F.when(borrow, "borrowed").otherwise("available").alias("status_after"))


# ------------------------------------------------------------------ M6
PENDING_DAYS = 30


def stream_pending_requests(spark: SparkSession, sf_dir: str, max_files: int | None = None, base: str | None = None,
                            checkpoint: str | None = None, watermark: str = "30 days") -> DataFrame:
    """M6: per user a request is refused while an accepted, undecided request is younger than 30 days.

    Request events ('view') and decision events ('signup', an approval or
    rejection) of one user apply in (ts, event_id) order; a decision clears
    the pending request. The state of a user is the end of the 30 days as of the
    watermark and the events beyond it; only those are run through again.
    """
    ev = file_stream(spark, sf_dir, "events", max_files).where(F.col("event_type").isin("view", "signup"))
    rows = _timed(ev, watermark).select(F.col("user_id").alias("key"), "event_id", (F.col("event_type") == "view").cast("int").alias("kind"), "event_time")
    out = _decided(rows, Spacing(PENDING_DAYS * 86_400_000_000), "pending_requests", base, checkpoint)
    if out is None:
        return spark.createDataFrame([], "event_id long, user_id long, accepted boolean")
    return out.where("kind = 1").select("event_id", F.col("key").alias("user_id"), "accepted")


# ------------------------------------------------------------------ M7
def stream_period_counts(spark: SparkSession, sf_dir: str, watermark: str = "30 days", max_files: int | None = None,
                         base: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """M7: loans and reservations per day and per ISO week as events arrive.

    Event-time windows on a watermark: rows later than the watermark are
    dropped, closed windows leave the state. Weeks are 7-day windows shifted
    by 4 days from the epoch (a Thursday), so they start on Monday. Each
    micro-batch's updated counts are merged into the result; a job given the same
    ``base`` and ``checkpoint`` resumes.
    """
    ev = (circulation_events(file_stream(spark, sf_dir, "events", max_files))
          .where(F.col("action").isin("borrow", "reserve"))
          .withColumn("event_time", utc_event_time("ts")).withWatermark("event_time", watermark))
    # One aggregation for both grains: every event counts once per day and once per week.
    grains = F.explode(F.array(
        F.struct(F.lit("day").alias("granularity"), F.to_date("ts").alias("window_start")),
        F.struct(F.lit("week").alias("granularity"), F.to_date(F.date_trunc("week", "ts")).alias("window_start"))))
    counts = (ev.select("event_time", "action", grains.alias("g"))
              .groupBy(F.window("event_time", "7 days", "7 days", "4 days"), "g.granularity", "g.window_start",
                       "action")
              .agg(F.count(F.lit(1)).alias("n")).select("granularity", "window_start", "action", "n"))
    key = ["granularity", "window_start", "action"]
    # An updated count is never below the one it replaces.
    table = KeyedTable(spark, "period_counts", key, lambda rows: rows.groupBy(*key).agg(F.max("n").alias("n")), base=base)
    run_available(counts.writeStream.outputMode("update").foreachBatch(table.apply), spark, "period_counts", checkpoint)
    cur = table.current()
    if cur is None:
        return spark.createDataFrame([], "granularity string, window_start date, action string, n long")
    return cur
