"""Users, readers and registration requests, computed for all users at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, lit_ntz
from ..functions.ordering import page
from ..sources.fixtures import Library


def unregistered_users(lib: Library) -> DataFrame:
    """Active users with role 'user' and no reader row."""
    u = lib.users.where((F.col("role") == "user") & F.col("is_active"))
    r = lib.readers.select(F.col("user_id").alias("id"))
    return u.join(r, "id", "left_anti").select("id", "username", "email")


def reader_requests_page(lib: Library, status: str = "pending", page_no: int = 1, per_page: int = 10) -> DataFrame:
    """R2: registration requests of one status ('processed' = approved or rejected), newest first."""
    rr = lib.reader_registration_requests
    cond = F.col("status").isin("approved", "rejected") if status == "processed" else F.col("status") == status
    sort_col = "processed_at" if status == "processed" else "created_at"
    u = lib.users.select(F.col("id").alias("user_id"), "username", "email")
    j = rr.where(cond).join(u, "user_id")
    rows = j.select("id", "status", "created_at", "processed_at", "username", "email", "user_id", "rejection_reason")
    return page(rows, [F.col(sort_col).desc_nulls_first(), F.col("id")], page_no, per_page)


def _pending_users(lib: Library, as_of: dt.date | str) -> DataFrame:
    since = dt.datetime.combine(as_date(as_of) - dt.timedelta(days=30), dt.time())
    rr = lib.reader_registration_requests
    return (rr.where((F.col("status") == "pending") & (F.col("created_at") > lit_ntz(since)))
            .select(F.col("user_id").alias("_pu")).distinct())


def pending_request_flags(lib: Library, as_of: dt.date | str) -> DataFrame:
    """Per user, whether a pending request younger than 30 days exists."""
    p = _pending_users(lib, as_of)
    return (lib.users.join(p, F.col("id") == F.col("_pu"), "left")
            .select(F.col("id").alias("user_id"), F.col("_pu").isNotNull().alias("has_pending_request")))


def reader_status_flags(lib: Library, as_of: dt.date | str) -> DataFrame:
    """Per user, is_reader and has_pending_request (two EXISTS as joins on distinct keys)."""
    p = _pending_users(lib, as_of)
    rd = lib.readers.select(F.col("user_id").alias("_ru")).distinct()
    j = (lib.users.join(rd, F.col("id") == F.col("_ru"), "left")
         .join(p, F.col("id") == F.col("_pu"), "left"))
    return j.select(F.col("id").alias("user_id"), F.col("_ru").isNotNull().alias("is_reader"),
                    F.col("_pu").isNotNull().alias("has_pending_request"))


def readers_active_loans(lib: Library) -> DataFrame:
    """Readers with the number of borrowed loans (0 when none)."""
    n = (lib.loans.where(F.col("status") == "borrowed").groupBy(F.col("reader_id").alias("id"))
         .agg(F.count("id").alias("active_loans")))
    j = lib.readers.join(n, "id", "left")
    return j.select("id", "first_name", "last_name", "email", "card_number", "phone_number",
                    F.coalesce("active_loans", F.lit(0).cast("long")).alias("active_loans"))


def readers_for_loan(lib: Library) -> DataFrame:
    """Readers that belong to an existing user."""
    u = lib.users.select(F.col("id").alias("user_id"))
    return lib.readers.join(u, "user_id", "left_semi").select("id", "first_name", "last_name", "email", "card_number")


def _profiles(lib: Library) -> DataFrame:
    """(id, card_number, registration_date) of each user's reader with the lowest id; the date is NULL without a card."""
    prof = lib.readers.groupBy(F.col("user_id").alias("id")).agg(F.min(F.struct(F.col("id").alias("rid"), "card_number", "registration_date")).alias("p"))
    return prof.select("id", "p.card_number", F.when(F.col("p.card_number").isNotNull(), F.col("p.registration_date")).alias("registration_date"))


def _loans_of_users(lib: Library) -> DataFrame:
    titles = lib.books.select(F.col("id").alias("book_id"), F.col("title").alias("book_title"))
    owners = lib.readers.select(F.col("id").alias("reader_id"), F.col("user_id").alias("owner"))
    return lib.loans.join(titles, "book_id").join(owners, "reader_id").select(
        "owner", F.col("id").alias("loan_id"), "book_title", "loan_date", "return_date", F.col("status").alias("loan_status"))


def user_details(lib: Library) -> DataFrame:
    """Per user the profile and loan history, flattened to one row per (user, loan).

    Users without loans keep one row with NULL loan fields. The reader profile
    is taken from the user's reader with the lowest id and is NULL when that
    reader has no card number.
    """
    # Users and loans are two kinds of rows of one table: the users' own rows are kept where no loan joins them, without
    # a left join whose inner side a hot user would hold in one task.
    users = lib.users.join(_profiles(lib), "id", "left").select(
        F.col("id").alias("user_id"), "username", "email", "role", "created_at", "card_number", "registration_date")
    loans = _loans_of_users(lib)
    cols = ["book_title", "loan_date", "return_date", "loan_status"]
    have = loans.groupBy("owner").agg(F.lit(True).alias("has"))
    flagged = users.join(have, F.col("user_id") == F.col("owner"), "left").drop("owner")
    with_loans = flagged.where("has").join(loans, F.col("user_id") == F.col("owner"))
    without = flagged.where("has IS NULL").select("*", *(F.lit(None).cast(loans.schema[c].dataType).alias(c) for c in cols))
    return with_loans.select(*users.columns, *cols).unionByName(without.select(*users.columns, *cols))


def user_profiles(lib: Library) -> DataFrame:
    """R7 nested: one row per user with ``reader_profile`` (NULL without a card number) and ``loan_history``, newest loan first.

    A user's history is one array, empty without loans; ``user_details`` has the same as flat rows.
    """
    loan = F.struct("book_title", "loan_date", "return_date", F.col("loan_status").alias("status"))
    # Sorted from the last: no date before all, then the latest, of equal dates the lowest loan.
    key = F.struct(F.col("loan_date").isNull().alias("undated"), "loan_date", (-F.col("loan_id")).alias("lowest"), loan.alias("loan"))
    history = _loans_of_users(lib).groupBy("owner").agg(F.sort_array(F.collect_list(key), asc=False).alias("h"))
    history = history.select("owner", F.transform("h", lambda x: x["loan"]).alias("loan_history"))
    profile = F.when(F.col("card_number").isNotNull(), F.struct("card_number", "registration_date"))
    empty = F.array().cast(history.schema["loan_history"].dataType)
    return lib.users.join(_profiles(lib), "id", "left").join(history, F.col("id") == F.col("owner"), "left").select(
        F.col("id").alias("user_id"), "username", "email", "role", "created_at", profile.alias("reader_profile"),
        F.coalesce("loan_history", empty).alias("loan_history"))


def user_statistics_report(lib: Library) -> DataFrame:
    """Users ⟕ readers with 'Yes'/'No' reader flag."""
    r = lib.readers.select(F.col("user_id").alias("_ru"), F.col("id").alias("_rid"), "registration_date")
    j = lib.users.join(r, F.col("id") == F.col("_ru"), "left")
    return j.select(F.col("id").alias("user_id"), "username", "email", "role", "created_at", "registration_date",
                    F.when(F.col("_rid").isNotNull(), "Yes").otherwise("No").alias("is_reader"))
