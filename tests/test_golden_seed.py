"""Hand-checked facts on the reference's own seed, with its relative dates frozen at as_of.

Reduced transcription of the seed (ids in insertion order): the eleven users,
eight readers, the five books and authors that loans and reservations touch,
the three registration requests, five reservations and four loans.
"""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import commands_circulation as WL
from shelfspark.operators import loans as L
from shelfspark.operators import readers as R
from shelfspark.operators import reports as P
from shelfspark.operators import reservations as V
from shelfspark.operators import views as M
from shelfspark.sources.fixtures import Library

D = dt.date(2024, 6, 15)


def d(n):
    return D + dt.timedelta(days=n)


def ts(n):
    return dt.datetime.combine(d(n), dt.time())


@pytest.fixture(scope="module")
def seed(spark):
    # Seed rows (names, emails, titles, relative dates).
    users = spark.createDataFrame([
        (1, "worker_1", "worker1@library.com", "worker", True, ts(-100)),
        (2, "worker_2", "worker2@library.com", "worker", True, ts(-100)),
        (3, "worker_3", "worker3@library.com", "worker", True, ts(-100)),
        (4, "john_doe", "john@example.com", "user", True, ts(-100)),
        (5, "jane_smith", "jane@example.com", "user", True, ts(-100)),
        (6, "prof_smith", "prof.smith@university.edu", "user", True, ts(-100)),
        (7, "dr_jones", "dr.jones@research.org", "user", True, ts(-100)),
        (8, "tech_lead", "techlead@company.com", "user", True, ts(-100)),
        (9, "developer1", "dev1@startup.com", "user", True, ts(-100)),
        (10, "carlos_garcia", "carlos@example.com", "user", True, ts(-100)),
        (11, "yuki_tanaka", "yuki@example.com", "user", True, ts(-100)),
    ], "id long, username string, email string, role string, is_active boolean, created_at timestamp_ntz")
    readers = spark.createDataFrame([
        (1, 4, "John", "Doe", "john@example.com"), (2, 5, "Jane", "Smith", "jane@example.com"),
        (3, 6, "Professor", "Smith", "prof.smith@university.edu"), (4, 7, "Dr.", "Jones", "dr.jones@research.org"),
        (5, 8, "Alex", "Tech", "techlead@company.com"), (6, 9, "Sam", "Developer", "dev1@startup.com"),
        (7, 10, "Carlos", "Garcia", "carlos@example.com"), (8, 11, "Yuki", "Tanaka", "yuki@example.com"),
    ], "id long, user_id long, first_name string, last_name string, email string").select(
        "*", F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("card_number"),
        F.lit(None).cast("string").alias("phone_number"), F.lit(ts(-50)).alias("registration_date"))
    authors = spark.createDataFrame([(1, "Robert C.", "Martin"), (2, "Haruki", "Murakami"), (3, "Frank", "Herbert"),
                                     (4, "Umberto", "Eco"), (6, "J.R.R.", "Tolkien")],
                                    "id long, first_name string, last_name string")
    books = spark.createDataFrame([
        (1, "Clean Code", 1, "9780132350884", 2008, "Computer Science"),
        (2, "1Q84", 2, "9780307593313", 2011, "Magical Realism"),
        (3, "Dune", 3, "9780441172719", 1965, "Science Fiction"),
        (4, "The Name of the Rose", 4, None, 1980, "Historical Mystery"),
        (5, "The Hobbit", 6, None, 1937, "Fantasy"),
    ], "id long, title string, author_id long, isbn string, publication_year int, genre string").select(
        "*", F.lit(None).cast("long").alias("publisher_id"), F.lit(None).cast("string").alias("description"),
        F.lit("available").alias("status"))
    requests = spark.createDataFrame([(1, 8, ts(0)), (2, 9, ts(-1)), (3, 10, ts(-2))],
                                     "id long, user_id long, created_at timestamp_ntz").select(
        "*", F.lit("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("processed_at"),
        F.lit(None).cast("string").alias("rejection_reason"))
    reservations = spark.createDataFrame([
        (1, 1, 1, d(0), d(14), "pending"), (2, 2, 3, d(5), d(19), "pending"), (3, 3, 5, d(-10), d(4), "completed"),
        (4, 4, 7, d(15), d(29), "cancelled"), (5, 5, 8, d(-5), d(9), "pending"),
    ], "id long, book_id long, reader_id long, start_date date, end_date date, status string").withColumn(
        "created_at", F.lit(ts(-20)))
    loans = spark.createDataFrame([
        (1, 3, 5, ts(-30), None, "borrowed"), (2, 2, 3, ts(-45), ts(-30), "returned"),
        (3, 1, 1, ts(-20), None, "borrowed"), (4, 5, 8, ts(-60), ts(-45), "returned"),
    ], "id long, book_id long, reader_id long, loan_date timestamp_ntz, return_date timestamp_ntz, status string")
    lib = Library(spark).override(users=users, readers=readers, authors=authors, books=books,
                                  reader_registration_requests=requests, reservations=reservations, loans=loans)
    # The seed ends with UPDATE books SET status = 'borrowed' WHERE id IN (borrowed loans).
    return lib.override(books=WL.sync_book_status(lib))


def test_status_sync_marks_books_1_and_3(seed):
    assert {r.id for r in seed.books.where("status = 'borrowed'").collect()} == {1, 3}


def test_due_dates_and_overdue(seed):
    rows = {r.id: (r.due_date, r.is_overdue) for r in L.loans_with_due(seed, D).collect()}
    assert rows[1] == (d(4), False)
    assert rows[3] == (None, None)  # borrowed, no completed reservation: NULL flag
    assert rows[2][0] is None and rows[4][0] is None
    assert P.report_overdue_loans(seed, D).count() == 0
    late = P.report_overdue_loans(seed, d(5)).collect()
    assert [(r.loan_id, r.days_overdue) for r in late] == [(1, 1)]


def test_loanable_now_is_the_hobbit_for_yuki(seed):
    rows = L.loanable_reservations(seed, D).collect()
    assert [(r.id, r.reader_name, r.reservation_count) for r in rows] == [(5, "Yuki Tanaka", 1)]


def test_pending_requests_and_unregistered(seed):
    flags = {r.user_id: r.has_pending_request for r in R.pending_request_flags(seed, D).collect()}
    assert {u for u, f in flags.items() if f} == {8, 9, 10}
    assert R.unregistered_users(seed).count() == 0


def test_popular_books_ranks(seed):
    got = {r.book_id: (r.loans_count, r.reservations_count, r.active_loans, r.pending_reservations,
                       r.popularity_rank) for r in P.report_popular_books(seed).collect()}
    assert got == {1: (1, 1, 1, 1, 1), 2: (1, 1, 0, 1, 1), 3: (1, 1, 1, 0, 1), 4: (0, 1, 0, 0, 5),
                   5: (1, 1, 0, 1, 1)}


def test_reader_summary(seed):
    got = {r.id: (r.total_loans, r.active_loans) for r in M.reader_summary(seed).collect()}
    assert got[5] == (1, 1) and got[1] == (1, 1) and got[3] == (1, 0) and got[8] == (1, 0) and got[2] == (0, 0)


def test_availability_check(seed, spark):
    req = spark.createDataFrame([(1, 5, d(0), d(3)), (2, 4, d(15), d(20)), (3, 99, d(0), d(1))],
                                "req_id long, book_id long, start_date date, end_date date")
    got = {r.req_id: (r.book_exists, r.book_status, r.has_conflict, r.current_holder)
           for r in V.check_availability(seed, req).collect()}
    assert got == {1: (True, "available", True, "Yuki Tanaka"), 2: (True, "available", False, None),
                   3: (False, "not_found", False, None)}
