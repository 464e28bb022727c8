"""Registration requests and decisions, roles, deletes and sign-ups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, lit_ntz
from ..sources.fixtures import Library
from .batch import CommandResult, checkpoint, first_failure, first_per_key, merge_rows, new_ids
from .ordered import accept_sign_ups


#: Columns of a registration request that describe the person and go on to the reader.
PERSONAL = ("first_name", "last_name", "address", "phone_number")


def submit_reader_requests(lib: Library, cmds: DataFrame, as_of: dt.date | str) -> CommandResult:
    """``(cmd_id, submitted_at, user_id)`` and the personal fields the command carries -> new pending requests.

    Rejected with 'Pending request exists' when the user has a pending
    request created after ``as_of - 30 days``, or an earlier command of the
    same user in this batch was accepted (the batch runs at ``as_of``).
    """
    since = dt.datetime.combine(as_date(as_of) - dt.timedelta(days=30), dt.time())
    rr = lib.reader_registration_requests
    blocked = (rr.where((F.col("status") == "pending") & (F.col("created_at") > lit_ntz(since)))
               .select(F.col("user_id").alias("_bu")).distinct())
    c = first_per_key(cmds, "user_id").join(blocked, F.col("user_id") == F.col("_bu"), "left")
    c = c.withColumn("reason", first_failure((F.col("_bu").isNull(), "Pending request exists"),
                                             (F.col("_first"), "Pending request exists")))
    acc = new_ids(c.where(F.col("reason").isNull()), ["submitted_at", "cmd_id"], rr, out="request_id")
    # The batch runs at ``as_of`` (that is why an accepted request blocks later ones of
    # its user), so new requests are stamped with that clock.
    now = dt.datetime.combine(as_date(as_of), dt.time())
    rows = acc.select(F.col("request_id").alias("id"), "user_id", lit_ntz(now).alias("created_at"),
                      F.lit("pending").alias("status"), *[p for p in PERSONAL if p in acc.columns])
    requests = rr.unionByName(rows, allowMissingColumns=True)
    outcomes = c.join(acc.select("cmd_id", "request_id"), "cmd_id", "left").select(
        "cmd_id", F.col("reason").isNull().alias("ok"), "reason", "request_id")
    return CommandResult({"reader_registration_requests": requests}, outcomes)


def decide_requests(lib: Library, cmds: DataFrame) -> CommandResult:
    """W6 + W7: ``(cmd_id, submitted_at, request_id, processor_id, decision, reason)``.

    A reject needs a non-blank reason ('Rejection reason required'). The
    first valid decision on a pending request wins; every other one gets
    'Request not found or already processed'. Approvals insert a reader
    with the request's personal fields (no email, no card); both set status,
    processed_by and processed_at and leave the request's other columns alone.
    """
    rr = lib.reader_registration_requests
    well_formed = (F.col("decision") == "approve") | (
        (F.col("decision") == "reject") & (F.length(F.trim(F.coalesce("reason", F.lit("")))) > 0))
    c = cmds.withColumn("_wf", well_formed)
    pending = rr.where(F.col("status") == "pending").select(F.col("id").alias("request_id"), "user_id")
    valid = c.where("_wf").join(pending, "request_id")
    winners = first_per_key(valid, "request_id").where("_first").select("cmd_id", "user_id")
    c = c.join(winners, "cmd_id", "left").withColumn(
        "_reason", first_failure((F.col("_wf"), "Rejection reason required"),
                                 (F.col("user_id").isNotNull(), "Request not found or already processed")))
    won = c.where(F.col("_reason").isNull())
    changed = won.select(F.col("request_id").alias("id"),
                         F.when(F.col("decision") == "approve", "approved").otherwise("rejected").alias("status"),
                         F.col("submitted_at").alias("processed_at"),
                         F.when(F.col("decision") == "reject", F.col("reason")).alias("rejection_reason"),
                         F.col("processor_id").alias("processed_by"))
    base = rr if "processed_by" in rr.columns else rr.withColumn("processed_by", F.lit(None).cast("long"))
    # The decided rows keep all other columns; they are stamped with their own decision's time.
    requests = merge_rows(base, changed, "id", F.col("processed_at"))
    personal = [p for p in PERSONAL if p in rr.columns]
    approved = won.where(F.col("decision") == "approve")
    if personal:
        approved = approved.join(rr.select(F.col("id").alias("request_id"), *personal), "request_id")
    readers_new = new_ids(approved, ["submitted_at", "cmd_id"], lib.readers, out="reader_id")
    readers = lib.readers.unionByName(
        readers_new.select(F.col("reader_id").alias("id"), "user_id", *personal,
                           F.col("submitted_at").cast(lib.readers.schema["registration_date"].dataType)
                           .alias("registration_date")),
        allowMissingColumns=True)
    outcomes = c.join(readers_new.select("cmd_id", "reader_id"), "cmd_id", "left").select(
        "cmd_id", F.col("_reason").isNull().alias("ok"), F.col("_reason").alias("reason"), "reader_id")
    return CommandResult({"reader_registration_requests": requests, "readers": readers}, outcomes)


def promote_users(lib: Library, cmds: DataFrame, now: dt.datetime) -> CommandResult:
    """``(cmd_id, submitted_at, user_id, role)``; role must be 'user' or 'worker', the last valid command of a user stays."""
    u = lib.users.select(F.col("id").alias("user_id")).withColumn("_found", F.lit(True))
    c = cmds.join(u, "user_id", "left").withColumn(
        "reason", first_failure((F.col("_found").isNotNull(), "User not found"),
                                (F.col("role").isin("user", "worker"), "Invalid role")))
    last = c.where(F.col("reason").isNull()).groupBy(F.col("user_id").alias("id")).agg(
        F.max_by("role", F.struct("submitted_at", "cmd_id")).alias("role"))
    outcomes = c.select("cmd_id", "user_id", "role", F.col("reason").isNull().alias("ok"), "reason")
    return CommandResult({"users": merge_rows(lib.users, last, "id", now)}, outcomes)


def delete_users(lib: Library, cmds: DataFrame) -> CommandResult:
    """``(cmd_id, submitted_at, user_id)``: delete users except admins; their readers and requests keep rows with user_id NULL.

    After a user's first deletion further commands find no user.
    """
    u = lib.users.select(F.col("id").alias("user_id"), F.col("role").alias("_role"), F.lit(True).alias("_found"))
    admin = F.coalesce(F.col("_role") == "admin", F.lit(False))
    c = first_per_key(cmds, "user_id").join(u, "user_id", "left").withColumn(
        "reason", first_failure((F.col("_found").isNotNull(), "User not found"), (~admin, "Cannot delete admin users"),
                                (F.col("_first"), "User not found")))
    gone = c.where(F.col("reason").isNull()).select(F.col("user_id").alias("_gone"))
    users = lib.users.join(gone, F.col("id") == F.col("_gone"), "left_anti")

    def null_out(df: DataFrame, col: str) -> DataFrame:
        j = df.join(gone, F.col(col) == F.col("_gone"), "left")
        return j.withColumn(col, F.when(F.col("_gone").isNull(), F.col(col))).drop("_gone")

    readers = null_out(lib.readers, "user_id")
    rr = null_out(lib.reader_registration_requests, "user_id")
    if "processed_by" in rr.columns:
        rr = null_out(rr, "processed_by")
    outcomes = c.select("cmd_id", "user_id", F.col("reason").isNull().alias("ok"), "reason")
    return CommandResult({"users": users, "readers": readers, "reader_registration_requests": rr}, outcomes)


# The startup admin account.
ADMIN_USERNAME = "admin"
ADMIN_EMAIL = "admin@library.com"


def bootstrap_admin(users: DataFrame) -> DataFrame:
    """Insert the 'admin' user when no user has that username (insert-if-absent)."""
    spark = users.sparkSession
    absent = users.where(F.col("username") == ADMIN_USERNAME).agg((F.count(F.lit(1)) == 0).alias("a")).scalar()
    row = new_ids(spark.range(1).select(F.lit(ADMIN_USERNAME).alias("username"), F.lit(ADMIN_EMAIL).alias("email"))
                  .where(absent), ["username"], users, out="id")
    return users.unionByName(row.select("id", "username", "email", F.lit("admin").alias("role"),
                                        F.lit(True).alias("is_active")), allowMissingColumns=True)


def _nameless() -> Column:
    return F.col("username").isNull() | F.col("email").isNull()


def register_users(lib: Library, cmds: DataFrame, bootstrap: bool = True) -> CommandResult:
    """``(cmd_id, submitted_at, username, email)`` sign-ups.

    Rejected with 'Username or email already exists' when either key is taken
    in the table or by an earlier accepted sign-up of the batch. Acceptance
    chains across the two keys; it is decided in batch order within groups of
    sign-ups that share keys (``operators/ordered.py``). New users get role
    'user' unless the table is empty, then the first becomes 'admin'. A command
    without a username or email fails with 'Failed to register user' (both are
    NOT NULL).
    """
    users = bootstrap_admin(lib.users) if bootstrap else lib.users
    tu = users.select(F.col("username").alias("_tu")).distinct()
    te = users.select(F.col("email").alias("_te")).distinct()
    c = checkpoint(cmds.join(tu, F.col("username") == F.col("_tu"), "left").join(te, F.col("email") == F.col("_te"), "left")
                   .select("cmd_id", "submitted_at", "username", "email",
                           (F.col("_tu").isNull() & F.col("_te").isNull() & ~_nameless()).alias("_open")), "sign-up-checks")
    accepted = accept_sign_ups(c.where("_open").drop("_open"))
    acc = new_ids(accepted, ["submitted_at", "cmd_id"], users, out="user_id")
    c = checkpoint(c.join(acc.select("cmd_id", "user_id"), "cmd_id", "left"), "sign-up-decisions")
    acc = c.where(F.col("user_id").isNotNull())
    # First user ever becomes admin: only when the table (after bootstrap) is empty.
    is_empty = users.agg((F.count(F.lit(1)) == 0).alias("e")).scalar()
    rows = acc.select(F.col("user_id").alias("id"), "username", "email",
                      F.when(is_empty & (F.col("user_id") == 1), "admin").otherwise("user").alias("role"),
                      F.lit(True).alias("is_active"), F.col("submitted_at").alias("created_at"))
    users_new = users.unionByName(rows, allowMissingColumns=True)
    ok = F.col("user_id").isNotNull()
    outcomes = c.select("cmd_id", ok.alias("ok"), F.when(_nameless(), F.lit("Failed to register user"))
                        .when(~ok, F.lit("Username or email already exists")).alias("reason"), "user_id")
    return CommandResult({"users": users_new}, outcomes)
