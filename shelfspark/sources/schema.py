"""Declared schemas of the eight circulation tables.

Types follow the relational DDL: SERIAL/INTEGER ids become LongType, the
publication year IntegerType, VARCHAR/TEXT StringType, DATE DateType and
TIMESTAMP without zone TimestampNTZType. ``password_hash`` is not carried.
VARCHAR lengths are kept here as data so the audit can check them.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, B = T.LongType(), T.IntegerType(), T.StringType(), T.BooleanType()
D, TS = T.DateType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "authors": _schema(("id", L, False), ("first_name", S, False), ("last_name", S, False),
                       ("created_at", TS, True), ("updated_at", TS, True)),
    "publishers": _schema(("id", L, False), ("name", S, False),
                          ("created_at", TS, True), ("updated_at", TS, True)),
    "books": _schema(("id", L, False), ("title", S, False), ("author_id", L, True), ("isbn", S, True),
                     ("publisher_id", L, True), ("publication_year", I, True), ("genre", S, True),
                     ("status", S, True), ("description", S, True),
                     ("created_at", TS, True), ("updated_at", TS, True)),
    "users": _schema(("id", L, False), ("username", S, False), ("email", S, False), ("role", S, True),
                     ("is_active", B, True), ("created_at", TS, True), ("updated_at", TS, True)),
    "readers": _schema(("id", L, False), ("first_name", S, False), ("last_name", S, False),
                       ("address", S, True), ("email", S, True), ("card_number", S, True),
                       ("registration_date", TS, True), ("phone_number", S, True), ("user_id", L, True),
                       ("created_at", TS, True), ("updated_at", TS, True)),
    "reservations": _schema(("id", L, False), ("book_id", L, True), ("reader_id", L, True),
                            ("reservation_date", TS, True), ("start_date", D, False), ("end_date", D, False),
                            ("status", S, True), ("created_at", TS, True), ("updated_at", TS, True)),
    "loans": _schema(("id", L, False), ("book_id", L, True), ("reader_id", L, True), ("loan_date", TS, True),
                     ("return_date", TS, True), ("status", S, True),
                     ("created_at", TS, True), ("updated_at", TS, True)),
    "reader_registration_requests": _schema(
        ("id", L, False), ("user_id", L, True), ("first_name", S, False), ("last_name", S, False),
        ("address", S, False), ("phone_number", S, False), ("status", S, True), ("created_at", TS, True),
        ("processed_by", L, True), ("processed_at", TS, True), ("rejection_reason", S, True),
        ("updated_at", TS, True)),
}

# Fixed values from the DDL: VARCHAR(n) limits per (table, column).
VARCHAR_LIMITS: dict[tuple[str, str], int] = {
    ("authors", "first_name"): 100, ("authors", "last_name"): 100,
    ("publishers", "name"): 200,
    ("books", "title"): 200, ("books", "isbn"): 20, ("books", "genre"): 100, ("books", "status"): 20,
    ("users", "username"): 80, ("users", "email"): 120, ("users", "role"): 20,
    ("readers", "first_name"): 100, ("readers", "last_name"): 100, ("readers", "address"): 200,
    ("readers", "email"): 100, ("readers", "card_number"): 50, ("readers", "phone_number"): 20,
    ("reservations", "status"): 20, ("loans", "status"): 20,
    ("reader_registration_requests", "first_name"): 100, ("reader_registration_requests", "last_name"): 100,
    ("reader_registration_requests", "address"): 200, ("reader_registration_requests", "phone_number"): 20,
    ("reader_registration_requests", "status"): 20,
}

# Fixed values from the DDL: unique keys and foreign keys.
UNIQUE_KEYS: dict[str, list[tuple[str, ...]]] = {
    "authors": [("id",), ("first_name", "last_name")],
    "publishers": [("id",), ("name",)],
    "books": [("id",), ("isbn",)],
    "users": [("id",), ("username",), ("email",)],
    "readers": [("id",), ("email",), ("card_number",)],
    "reservations": [("id",)],
    "loans": [("id",)],
    "reader_registration_requests": [("id",)],
}
FOREIGN_KEYS: list[tuple[str, str, str]] = [
    ("books", "author_id", "authors"), ("books", "publisher_id", "publishers"),
    ("readers", "user_id", "users"),
    ("reservations", "book_id", "books"), ("reservations", "reader_id", "readers"),
    ("loans", "book_id", "books"), ("loans", "reader_id", "readers"),
    ("reader_registration_requests", "user_id", "users"),
    ("reader_registration_requests", "processed_by", "users"),
]
