"""Presentation order of the lists that are not paged.

The operators return unordered results, as a sort is only worth its shuffle
where rows are shown or written. ``presented`` sorts a result for that (a
distributed range sort), and the report writers take ``list_order`` as their
``order``. Every order ends in keys that tell the rows apart; NULLs come first
in descending and last in ascending keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sort keys of each list; a leading minus is descending.
LIST_ORDERS: dict[str, list[str]] = {
    "users_list": ["username", "id"],
    "unregistered_users": ["username", "id"],
    "readers_active_loans": ["last_name", "first_name", "id"],
    "readers_for_loan": ["last_name", "first_name", "id"],
    "user_details": ["user_id", "-loan_date", "book_title", "return_date", "loan_status"],
    "user_statistics_report": ["username", "user_id", "registration_date"],
    "active_loans": ["-loan_date", "id", "due_date"],
    "loan_history": ["-return_date", "id", "due_date"],
    "loanable_reservations": ["created_at", "id", "reader_id", "start_date", "end_date"],
    "loanable_by_reader": ["reader_name", "reader_id", "title", "book_id", "start_date", "end_date"],
    "book_reservations": ["book_id", "start_date", "id"],
    "user_reservations": ["user_id", "-start_date", "id"],
    "my_reservations": ["user_id", "-start_date", "id"],
    "report_active_loans": ["-is_overdue", "-loan_date", "loan_id", "due_date"],
    "report_overdue_loans": ["-days_overdue", "loan_id", "due_date"],
    "report_reader_activity": ["reader", "reader_id"],
    "report_period_loans": ["-loan_date", "loan_id"],
    "report_period_reservations": ["-created_at", "reservation_id"],
    "report_period_readers": ["-registration_date", "reader_id"],
    "report_period_overdue": ["-days_overdue", "loan_id", "due_date"],
    "book_genres": ["genre"],
}


def list_order(name: str) -> list[Column]:
    return [F.col(k[1:]).desc_nulls_first() if k[0] == "-" else F.col(k).asc_nulls_last() for k in LIST_ORDERS[name]]


def presented(df: DataFrame, name: str) -> DataFrame:
    return df.orderBy(*list_order(name))
