"""Registered load, sink and audit queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators.audit import audit_constraints, audit_sql
from ..session import scratch_path
from ..sources.fixtures import CIRCULATION_TABLES, FIXTURE_COLUMNS
from ..sources.loads import insert_if_absent, load_tables, resolve_keys
from ..sources.schema import SCHEMAS
from ..sources.sinks import export_snapshot
from .queries_reads import P6_ARGS, PERIOD_RESERVATIONS, READER_ACTIVITY, overdue_sql
from .registry import AS_OF_LOANS, register


@register("s2_insert_if_absent", """
WITH c AS (SELECT username, email, ROW_NUMBER() OVER (PARTITION BY username ORDER BY submitted_at, cmd_id) AS rn
           FROM register_commands)
SELECT username, email FROM users
UNION ALL
SELECT username, email FROM c WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM users u WHERE u.username = c.username)
""")
def _s2(lib):
    new = lib.register_commands.select("username", "submitted_at", "cmd_id", "email")
    out = insert_if_absent(lib.users.select("username", "email"), new, "username", order=["submitted_at", "cmd_id"])
    return out.select("username", "email")


@register("s3_resolve_keys", """
SELECT bc.cmd_id, bc.publisher, p.id AS publisher_id
FROM book_commands bc LEFT JOIN (SELECT name, min(id) AS id FROM publishers GROUP BY name) p ON p.name = bc.publisher
""")
def _s3(lib):
    facts = lib.book_commands.select("cmd_id", "publisher")
    return resolve_keys(facts, lib.publishers, {"publisher": "name"}, "id", "publisher_id")


#: Columns of the fixture tables that are timestamps; the others have one text form in either engine.
_STAMPS = {"loan_date", "processed_at", "created_at"}
_DATES = {("users", "created_at")}


def _row_text(table: str) -> str:
    form = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c in _STAMPS and (table, c) not in _DATES else f"CAST({c} AS VARCHAR)"
    return " || '|' || ".join(f"COALESCE({form(c)}, '\\N')" for c in FIXTURE_COLUMNS[table])


@register("s7_export_snapshot", "\nUNION ALL\n".join(
    f"""SELECT '{t}' AS "table", count(*) AS "rows", CAST(CAST(COALESCE(sum(CAST('0x' || substr(md5({_row_text(t)}), 1, 8) AS BIGINT)), 0)
  AS HUGEINT) AS VARCHAR) AS content_hash FROM {t}""" for t in CIRCULATION_TABLES))
def _s7(lib):
    tables = {t: lib.table(t) for t in CIRCULATION_TABLES}
    return export_snapshot(lib.spark, tables, scratch_path(lib.spark, "snapshot"))


@register("s8_audit_violations", f"""
WITH bad AS (SELECT id, CASE WHEN id % 50 <> 0 THEN title END AS title, CASE WHEN id % 70 = 0 THEN author_id + 1000000 ELSE author_id END AS author_id,
               CASE WHEN id % 40 = 1 THEN 'same' ELSE isbn END AS isbn, publisher_id,
               CASE WHEN id % 60 = 0 THEN 999 WHEN id % 60 = 1 THEN {AS_OF_LOANS.year + 1} ELSE publication_year END AS year, repeat(genre, 20) AS genre
             FROM books)
SELECT 'books' AS table_name, 'not_null' AS rule, 'title' AS column_name, CAST(id AS VARCHAR) AS row_key, CAST(NULL AS VARCHAR) AS detail
FROM bad WHERE title IS NULL
UNION ALL SELECT 'books', 'unique', 'isbn', 'same', CAST(count(*) AS VARCHAR) FROM bad WHERE isbn = 'same' HAVING count(*) > 1
UNION ALL SELECT 'books', 'varchar_length', 'genre', CAST(id AS VARCHAR), CAST(length(genre) AS VARCHAR) FROM bad WHERE length(genre) > 100
UNION ALL SELECT 'books', 'check_publication_year', 'publication_year', CAST(id AS VARCHAR), CAST(year AS VARCHAR) FROM bad
  WHERE year NOT BETWEEN 1000 AND {AS_OF_LOANS.year}
UNION ALL SELECT 'books', 'foreign_key', 'author_id', CAST(id AS VARCHAR), CAST(author_id AS VARCHAR) FROM bad
  WHERE author_id NOT IN (SELECT id FROM authors)
""")
def _s8v(lib):
    i = F.col("id")
    bad = lib.books.withColumns({
        "title": F.when(i % 50 != 0, F.col("title")),
        "author_id": F.when(i % 70 == 0, F.col("author_id") + 1_000_000).otherwise(F.col("author_id")),
        "isbn": F.when(i % 40 == 1, "same").otherwise(F.col("isbn")),
        "publication_year": F.when(i % 60 == 0, 999).when(i % 60 == 1, AS_OF_LOANS.year + 1).otherwise(F.col("publication_year")),
        "genre": F.repeat("genre", F.lit(20))})
    return audit_constraints({"books": bad, "authors": lib.authors, "publishers": lib.publishers}, AS_OF_LOANS)


@register("s8_audit_constraints", audit_sql(FIXTURE_COLUMNS, AS_OF_LOANS))
def _s8(lib):
    return audit_constraints({t: lib.table(t) for t in CIRCULATION_TABLES}, AS_OF_LOANS)


# ---------------------------------------------------------------- report writers, read back
import datetime as _dt  # noqa: E402

from ..functions.dates import in_period, period_bounds  # noqa: E402
from ..operators import reports as P  # noqa: E402
from ..operators.presentation import list_order  # noqa: E402
from ..operators.readers import user_statistics_report  # noqa: E402
from ..sources.sinks import write_period_report, write_report_csv, write_report_json  # noqa: E402
from .registry import AS_OF_LOANABLE  # noqa: E402

P9_ARGS = ("week", _dt.date(1998, 6, 18))  # a Thursday: 1998-06-15 .. 1998-06-18


def _strings(cols: list[str]) -> str:
    return ", ".join(f"`{c}` string" for c in cols)


@register("p9_in_period", f"""
SELECT id, loan_date FROM loans
WHERE CAST(loan_date AS DATE) BETWEEN DATE '{period_bounds(*P9_ARGS)[0]}' AND DATE '{period_bounds(*P9_ARGS)[1]}'
""")
def _p9(lib):
    return lib.loans.where(in_period("loan_date", *P9_ARGS)).select("id", "loan_date")


_S4_COLS = ["loan_id", "title", "author", "reader", "loan_date", "due_date", "days_overdue", "email", "phone_number"]
D_LOANS = f"DATE '{AS_OF_LOANS.isoformat()}'"


@register("s4_report_json", f"""
SELECT CAST(loan_id AS VARCHAR) AS loan_id, title, author, reader, strftime(loan_date, '%Y-%m-%dT%H:%M:%S') AS loan_date,
  strftime(due_date, '%Y-%m-%d') AS due_date, CAST(days_overdue AS VARCHAR) AS days_overdue, email, phone_number
FROM ({overdue_sql(D_LOANS)}) x
""")
def _s4(lib):
    path = scratch_path(lib.spark, "report-json")
    write_report_json(P.report_overdue_loans(lib, AS_OF_LOANS), path, order=list_order("report_overdue_loans"))
    return lib.spark.read.schema(_strings(_S4_COLS)).json(path)


S5_HEADER = {"reader": "Reader", "email": "Email", "loans_count": "Total Loans",
             "reservations_count": "Total Reservations", "active_loans": "Active Loans",
             "pending_reservations": "Pending Reservations", "registration_date": "Registration Date"}


@register("s5_report_csv", f"""
SELECT reader AS "Reader", email AS "Email", CAST(loans_count AS VARCHAR) AS "Total Loans",
  CAST(reservations_count AS VARCHAR) AS "Total Reservations", CAST(active_loans AS VARCHAR) AS "Active Loans",
  CAST(pending_reservations AS VARCHAR) AS "Pending Reservations", COALESCE(strftime(registration_date, '%Y-%m-%d'), 'N/A') AS "Registration Date"
FROM ({READER_ACTIVITY}) x
""")
def _s5(lib):
    path = scratch_path(lib.spark, "report-csv")
    write_report_csv(P.report_reader_activity(lib), path, S5_HEADER, null_label="N/A",
                     order=list_order("report_reader_activity"))
    return lib.spark.read.schema(_strings(list(S5_HEADER.values()))).option("header", True).csv(path)


_USERS_HEADER = {"username": "Username", "email": "Email", "role": "Role", "is_reader": "Is Reader", "created_at": "Created At",
                 "registration_date": "Registration Date"}


@register("s5_user_statistics_csv", """
SELECT username AS "Username", email AS "Email", role AS "Role", CASE WHEN signed IS NULL THEN 'No' ELSE 'Yes' END AS "Is Reader",
  strftime(created_at, '%Y-%m-%d') AS "Created At", COALESCE(strftime(signed, '%Y-%m-%d'), 'N/A') AS "Registration Date"
FROM (SELECT *, (SELECT max(registration_date) FROM readers WHERE user_id = users.id) AS signed FROM users) x
""")
def _s5u(lib):
    path = scratch_path(lib.spark, "users-csv")
    write_report_csv(user_statistics_report(lib), path, _USERS_HEADER, null_label="N/A", order=list_order("user_statistics_report"))
    return lib.spark.read.schema(_strings(list(_USERS_HEADER.values()))).option("header", True).csv(path)


S6_ARGS = P6_ARGS
_S6_COLS = ["reservation_id", "title", "author", "reader", "created_at", "start_date", "end_date", "status",
            "report_type", "period_start", "period_end"]


@register("s6_period_report", f"""
SELECT CAST(reservation_id AS VARCHAR) AS reservation_id, title, author, reader, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
  strftime(start_date, '%Y-%m-%d') AS start_date, strftime(end_date, '%Y-%m-%d') AS end_date, status,
  'reservations' AS report_type, '{period_bounds(*S6_ARGS)[0]}' AS period_start, '{period_bounds(*S6_ARGS)[1]}' AS period_end
FROM ({PERIOD_RESERVATIONS}) x
""")
def _s6(lib):
    path = scratch_path(lib.spark, "period-report")
    start, end = period_bounds(*S6_ARGS)
    write_period_report(P.period_report(lib, "reservations", *S6_ARGS), "reservations", start, end, path)
    return lib.spark.read.schema(_strings(_S6_COLS)).option("header", True).csv(path)


_SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def _declared(table: str) -> str:
    """The fixture's columns in the declared types, NULL for those it does not hold."""
    return "SELECT " + ", ".join(
        f"CAST({f.name if f.name in FIXTURE_COLUMNS[table] else 'NULL'} AS {_SQL_TYPES[f.dataType.simpleString()]}) AS {f.name}"
        for f in SCHEMAS[table].fields) + f" FROM {table}"


def _s1(table: str):
    def run(lib):
        path = scratch_path(lib.spark, "s1-tables")
        lib.table(table).write.mode("overwrite").parquet(f"{path}/{table}")
        return load_tables(lib.spark, path, [table])[table]
    return run


for _table in CIRCULATION_TABLES:
    register("s1_load_tables" if _table == "books" else f"s1_load_{_table}", _declared(_table))(_s1(_table))
