"""Registered read queries (catalogue, readers, loans, reservations, reports)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import loans as L
from ..operators import reports as P
from .registry import AS_OF_LOANABLE, AS_OF_LOANS, register

D_LOANS = f"DATE '{AS_OF_LOANS.isoformat()}'"
D_LOANABLE = f"DATE '{AS_OF_LOANABLE.isoformat()}'"


# ---------------------------------------------------------------- reports
def _counts(name: str, table: str, key: str, status: str) -> str:
    """Rows of a table by key, and those in one status."""
    return f"{name} AS (SELECT {key} AS k, count(*) AS n, count(*) FILTER (status = '{status}') AS m FROM {table} GROUP BY {key})"


# Better ranks are counted over the few different pairs of counts.
@register("p4_popular_books", f"""
WITH {_counts("lent", "loans", "book_id", "borrowed")}, {_counts("held", "reservations", "book_id", "pending")},
t AS (SELECT id, title, author_id, COALESCE(lent.n, 0) AS x, COALESCE(held.n, 0) AS y, COALESCE(lent.m, 0) AS a, COALESCE(held.m, 0) AS p
      FROM books LEFT JOIN lent ON lent.k = id LEFT JOIN held ON held.k = id WHERE author_id IN (SELECT id FROM authors)),
pairs AS (SELECT x, y, count(*) AS c FROM t GROUP BY x, y),
ranks AS (SELECT x, y, 1 + COALESCE((SELECT sum(c) FROM pairs o WHERE o.x > pairs.x OR o.x = pairs.x AND o.y > pairs.y), 0) AS r FROM pairs)
SELECT t.id AS book_id, title, (SELECT first_name || ' ' || last_name FROM authors WHERE authors.id = author_id) AS author, x AS loans_count,
  y AS reservations_count, a AS active_loans, p AS pending_reservations,
  CAST((SELECT r FROM ranks WHERE ranks.x = t.x AND ranks.y = t.y) AS BIGINT) AS popularity_rank
FROM t
""")
def _p4(lib):
    return P.report_popular_books(lib)


# ---------------------------------------------------------------- loans
# Readers and books with the names they are listed under.
_NAMED = """who AS (SELECT *, first_name || ' ' || last_name AS name FROM readers),
work AS (SELECT id, title, (SELECT first_name || ' ' || last_name FROM authors WHERE authors.id = author_id) AS name
  FROM books WHERE author_id IN (SELECT id FROM authors))"""


def _of_book(column: str) -> str:
    return f"(SELECT {column} FROM work WHERE work.id = book_id)"


def _numbered(rows: str, per_page: int, order: str, offset: int) -> str:
    """One page of a row set with the number of all its rows and pages."""
    n = f"(SELECT count(*) FROM {rows})"
    return f"SELECT *, {n} AS total_count, ({n} + {per_page - 1}) // {per_page} AS pages FROM {rows} ORDER BY {order} LIMIT {per_page} OFFSET {offset}"


# A loan's due dates: the ends of the reader's completed reservations of the book, or one unknown date.
_DUE = """due AS (SELECT loans.id AS loan_id, end_date FROM loans, reservations
  WHERE reservations.status = 'completed' AND (reservations.book_id, reservations.reader_id) = (loans.book_id, loans.reader_id)),
dated AS (SELECT * FROM due UNION ALL SELECT id, NULL FROM loans WHERE id NOT IN (SELECT loan_id FROM due)),
""" + _NAMED


def _page_of_loans(where: str, offset: int) -> str:
    """Ten of the loans that pass a filter, with the number of all that do."""
    return f"""
WITH {_DUE},
entry AS (SELECT * FROM (
  SELECT l.id, (SELECT title FROM books WHERE books.id = book_id) AS title, name AS reader, loan_date, return_date, status,
    end_date AS due_date, status = 'borrowed' AND end_date < {D_LOANS} AS is_overdue
  FROM dated, loans l, who WHERE loan_id = l.id AND who.id = reader_id AND book_id IN (SELECT id FROM books)) x WHERE {where})
SELECT *, (SELECT count(*) FROM entry) AS total_count, CAST(CEIL((SELECT count(*) FROM entry) / 10.0) AS BIGINT) AS pages
FROM entry ORDER BY loan_date DESC NULLS FIRST, id, due_date NULLS LAST LIMIT 10 OFFSET {offset}"""


@register("l1_loans_page", _page_of_loans("true", 20))
def _l1(lib):
    return L.loans_page(lib, AS_OF_LOANS, page_no=3, per_page=10)


_L2 = f"""
WITH {_DUE}
SELECT who.user_id, l.id, work.title, work.name AS author, loan_date, return_date, l.status, end_date AS due_date,
  l.status = 'borrowed' AND end_date < {D_LOANS} AS is_overdue
FROM dated, loans l, work, who WHERE loan_id = l.id AND work.id = book_id AND who.id = reader_id
"""


@register("l2_reader_loans", _L2)
def _l2(lib):
    return L.reader_loans(lib, AS_OF_LOANS)


@register("l3_active_loans", _L2 + " AND l.status = 'borrowed'")
def _l3(lib):
    return L.active_loans(lib, AS_OF_LOANS)


@register("l4_loan_history", _L2 + " AND l.status = 'returned'")
def _l4(lib):
    return L.loan_history(lib, AS_OF_LOANS)


# Requests for the day on books that stand on the shelf.
_L5 = f"""
WITH {_NAMED},
shelf AS (SELECT id FROM books WHERE status = 'available' EXCEPT SELECT book_id FROM loans WHERE status = 'borrowed'),
asked AS (SELECT * FROM reservations WHERE status = 'pending' AND start_date <= {D_LOANABLE} AND end_date >= {D_LOANABLE}
          AND book_id IN (SELECT id FROM shelf INTERSECT SELECT id FROM work) AND reader_id IN (SELECT id FROM who)),
often AS (SELECT book_id, count(*) AS n FROM asked GROUP BY book_id)
SELECT book_id AS id, {_of_book("title")} AS title, {_of_book("name")} AS author, reader_id,
  (SELECT name FROM who WHERE who.id = reader_id) AS reader_name, start_date, end_date, created_at, n AS reservation_count
FROM asked NATURAL JOIN often
"""


@register("l5_loanable_reservations", _L5)
def _l5(lib):
    return L.loanable_reservations(lib, AS_OF_LOANABLE)


@register("l6_loanable_by_reader", f"""
WITH l5 AS ({_L5})
SELECT reader_id, reader_name, id AS book_id, title, author, start_date, end_date,
  COUNT(*) OVER (PARTITION BY reader_id) AS books_for_reader
FROM l5
""")
def _l6(lib):
    return L.loanable_by_reader(lib, AS_OF_LOANABLE)


@register("l6_loanable_per_reader", f"""
WITH l5 AS ({_L5})
SELECT reader_id, reader_name, (COUNT(*) OVER (PARTITION BY reader_id))::INT AS n_books,
  (ROW_NUMBER() OVER (PARTITION BY reader_id ORDER BY created_at NULLS LAST, id, title, author, start_date, end_date) - 1)::INT AS pos,
  id, title, author, start_date, end_date, reservation_count
FROM l5
""")
def _l6n(lib):
    p = L.loanable_per_reader(lib, AS_OF_LOANABLE)
    return p.select("reader_id", "reader_name", F.size("books").alias("n_books"), F.posexplode("books").alias("pos", "book")).select("*", "book.*").drop("book")


def _reservation_rows(where: str, limit: str) -> str:
    return f"""
WITH person AS (SELECT id AS rid, COALESCE(first_name, '') || ' ' || COALESCE(last_name, '') AS reader FROM readers),
listed AS (SELECT id, start_date, end_date, status, (SELECT title FROM books WHERE books.id = book_id) AS title, reader FROM reservations, person
           WHERE rid = reader_id AND book_id IN (SELECT id FROM books))
SELECT *{", (SELECT count(*) FROM listed) AS total_count, (SELECT (count(*) + 9) // 10 FROM listed) AS pages" if not where else ""}
FROM listed {where} ORDER BY start_date DESC NULLS FIRST, id {limit}"""


@register("v3_reservations_after", _reservation_rows("WHERE start_date < DATE '1997-03-01' OR start_date = DATE '1997-03-01' AND id > 500", "LIMIT 10"))
def _v3s(lib):
    return V.reservations_after(lib, {"start_date": dt.date(1997, 3, 1), "id": 500})


@register("v3_reservations_deep_page", _reservation_rows("", "LIMIT 10 OFFSET 2490"))
def _v3d(lib):
    return V.paged_reservations(lib, ranges=16).page(250, 10)


@register("c1_catalog_after", """
WITH named AS (SELECT id AS aid, COALESCE(first_name, '') || ' ' || COALESCE(last_name, '') AS author FROM authors)
SELECT books.id, title, isbn, publication_year, genre, status, description, author, (SELECT name FROM publishers WHERE publishers.id = publisher_id) AS publisher
FROM books, named WHERE aid = author_id AND status = 'available' AND (title, books.id) > ('Bolt', 100) ORDER BY title, books.id LIMIT 9
""")
def _c1s(lib):
    return C.catalog_after(lib, {"title": "Bolt", "id": 100}, status="available")


def _open_loans(day: str) -> str:
    """Borrowed loans with their due dates and days overdue on a day."""
    return f"""WITH {_DUE},
late AS (SELECT loan_id, work.title, work.name AS author, who.name AS reader, email, phone_number, loan_date, end_date AS due_date,
           CASE WHEN end_date < {day} THEN date_diff('day', end_date, {day}) END AS days
         FROM dated, loans l, work, who WHERE l.status = 'borrowed' AND loan_id = l.id AND work.id = book_id AND who.id = reader_id)"""


@register("p1_active_loans", f"""{_open_loans(D_LOANS)},
step AS (SELECT days, count(*) AS c FROM late WHERE days IS NOT NULL GROUP BY days),
place AS (SELECT days, 1 + COALESCE((SELECT sum(c) FROM step o WHERE o.days > step.days), 0) AS r FROM step)
SELECT loan_id, title, author, reader, loan_date, due_date, due_date < {D_LOANS} AS is_overdue, late.days AS days_overdue,
  CAST(COALESCE(r, 1 + (SELECT count(days) FROM late)) AS BIGINT) AS overdue_rank
FROM late LEFT JOIN place ON place.days = late.days
""")
def _p1(lib):
    return P.report_active_loans(lib, AS_OF_LOANS)


def overdue_sql(day: str, also: str = "true") -> str:
    return f"""{_open_loans(day)}
SELECT loan_id, title, author, reader, loan_date, due_date, days AS days_overdue, email, phone_number
FROM late WHERE days IS NOT NULL AND {also}
"""


@register("p2_overdue_loans", overdue_sql(D_LOANS))
def _p2(lib):
    return P.report_overdue_loans(lib, AS_OF_LOANS)


READER_ACTIVITY = f"""
WITH {_counts("lent", "loans", "reader_id", "borrowed")}, {_counts("held", "reservations", "reader_id", "pending")}
SELECT id AS reader_id, first_name || ' ' || last_name AS reader, email, COALESCE(lent.n, 0) AS loans_count,
  COALESCE(held.n, 0) AS reservations_count, registration_date, COALESCE(lent.m, 0) AS active_loans, COALESCE(held.m, 0) AS pending_reservations
FROM readers LEFT JOIN lent ON lent.k = id LEFT JOIN held ON held.k = id
"""


@register("p3_reader_activity", READER_ACTIVITY)
def _p3(lib):
    return P.report_reader_activity(lib)


# Period reports: (period, as_of) and the resulting closed date range.
P5_ARGS = ("year", AS_OF_LOANABLE)       # 1998-01-01 .. 1998-06-15
P6_ARGS = ("month", AS_OF_LOANABLE)      # 1998-06-01 .. 1998-06-15
P7_ARGS = ("year", AS_OF_LOANS)          # 2001-01-01 .. 2001-08-15
P8_ARGS = ("year", AS_OF_LOANABLE)


def _between(period_args) -> str:
    from ..functions.dates import period_bounds
    lo, hi = period_bounds(*period_args)
    return f"BETWEEN DATE '{lo.isoformat()}' AND DATE '{hi.isoformat()}'"


def period_rows(table: str, made: str, period_args, id_name: str, dates: str) -> str:
    """Rows of a table made in a period, with title, author and reader."""
    from ..functions.dates import period_bounds
    lo, hi = period_bounds(*period_args)
    return f"""
WITH {_NAMED}
SELECT id AS {id_name}, {_of_book("title")} AS title, {_of_book("name")} AS author, (SELECT name FROM who WHERE who.id = reader_id) AS reader, {dates}, status
FROM {table} WHERE {made} >= DATE '{lo.isoformat()}' AND {made} < DATE '{hi.isoformat()}' + INTERVAL 1 DAY
  AND book_id IN (SELECT id FROM work) AND reader_id IN (SELECT id FROM who)"""


@register("p5_period_loans", period_rows("loans", "loan_date", P5_ARGS, "loan_id", "loan_date, return_date"))
def _p5(lib):
    return P.report_period_loans(lib, *P5_ARGS)


PERIOD_RESERVATIONS = period_rows("reservations", "created_at", P6_ARGS, "reservation_id", "created_at, start_date, end_date")


@register("p6_period_reservations", PERIOD_RESERVATIONS)
def _p6(lib):
    return P.report_period_reservations(lib, *P6_ARGS)


@register("p7_period_readers", f"""
SELECT id AS reader_id, first_name || ' ' || last_name AS reader, email, phone_number, address, registration_date,
  (SELECT count(*) FROM loans WHERE reader_id = readers.id) AS total_loans,
  (SELECT count(*) FROM reservations WHERE reader_id = readers.id) AS total_reservations
FROM readers WHERE CAST(registration_date AS DATE) {_between(P7_ARGS)}
""")
def _p7(lib):
    return P.report_period_readers(lib, *P7_ARGS)


@register("p8_period_overdue",
          overdue_sql(D_LOANABLE, f"CAST(loan_date AS DATE) {_between(P8_ARGS)}"))
def _p8(lib):
    return P.report_period_overdue(lib, *P8_ARGS)


# ---------------------------------------------------------------- readers
from ..operators import readers as R  # noqa: E402
from .registry import AS_OF_REQUESTS  # noqa: E402

D_REQ = f"DATE '{AS_OF_REQUESTS.isoformat()}'"
_PENDING = f"""SELECT 1 FROM reader_registration_requests rr WHERE rr.user_id = u.id AND rr.status = 'pending'
  AND rr.created_at > {D_REQ} - INTERVAL 30 DAY"""


@register("r1_unregistered_users", """
SELECT id, username, email FROM users WHERE is_active AND role = 'user' AND id NOT IN (SELECT user_id FROM readers WHERE user_id IS NOT NULL)
""")
def _r1(lib):
    return R.unregistered_users(lib)


def _requests(passes: str, newest: str, offset: int) -> str:
    """A page of the registration requests in some statuses, newest first."""
    return f"""
WITH listed AS (SELECT id, status, created_at, processed_at, (SELECT username FROM users WHERE users.id = user_id) AS username,
                  (SELECT email FROM users WHERE users.id = user_id) AS email, user_id, rejection_reason
                FROM reader_registration_requests WHERE {passes} AND user_id IN (SELECT id FROM users))
{_numbered("listed", 10, f"{newest} DESC NULLS FIRST, id", offset)}"""


@register("r2_reader_requests_page", _requests("list_contains(['approved', 'rejected'], status)", "processed_at", 10))
def _r2(lib):
    return R.reader_requests_page(lib, "processed", page_no=2)


@register("r3_pending_request_flags", f"""
SELECT u.id AS user_id, EXISTS ({_PENDING}) AS has_pending_request FROM users u
""")
def _r3(lib):
    return R.pending_request_flags(lib, AS_OF_REQUESTS)


@register("r4_reader_status_flags", f"""
SELECT u.id AS user_id, EXISTS (SELECT 1 FROM readers r WHERE r.user_id = u.id) AS is_reader,
  EXISTS ({_PENDING}) AS has_pending_request FROM users u
""")
def _r4(lib):
    return R.reader_status_flags(lib, AS_OF_REQUESTS)


@register("r5_readers_active_loans", """
SELECT id, first_name, last_name, email, card_number, phone_number,
  (SELECT count(*) FROM loans WHERE status = 'borrowed' AND reader_id = readers.id) AS active_loans
FROM readers
""")
def _r5(lib):
    return R.readers_active_loans(lib)


@register("r6_readers_for_loan", """
SELECT r.id, r.first_name, r.last_name, r.email, r.card_number FROM readers r JOIN users u ON r.user_id = u.id
""")
def _r6(lib):
    return R.readers_for_loan(lib)


@register("r7_user_details", """
SELECT u.id AS user_id, u.username, u.email, u.role, u.created_at, p.card_number,
  CASE WHEN p.card_number IS NOT NULL THEN p.reg END AS registration_date,
  h.book_title, h.loan_date, h.return_date, h.loan_status
FROM users u
LEFT JOIN (SELECT user_id, arg_min(card_number, id) AS card_number, arg_min(registration_date, id) AS reg
           FROM readers GROUP BY user_id) p ON p.user_id = u.id
LEFT JOIN (SELECT r.user_id, b.title AS book_title, l.loan_date, l.return_date, l.status AS loan_status
           FROM loans l JOIN books b ON l.book_id = b.id JOIN readers r ON l.reader_id = r.id) h ON h.user_id = u.id
""")
def _r7(lib):
    return R.user_details(lib)


@register("r7_user_profiles", """
WITH owned AS (SELECT loans.*, user_id AS owner FROM loans, readers WHERE readers.id = reader_id AND book_id IN (SELECT id FROM books)),
card AS (SELECT DISTINCT ON (user_id) user_id AS owner, card_number, registration_date FROM readers ORDER BY user_id, id),
history AS (SELECT owner, ROW_NUMBER() OVER (PARTITION BY owner ORDER BY loan_date DESC NULLS FIRST, id) - 1 AS pos, loan_date, return_date, status,
              (SELECT title FROM books WHERE books.id = book_id) AS book_title FROM owned)
SELECT id AS user_id, username, email, role, created_at, card_number IS NOT NULL AS has_profile, card_number,
  CASE WHEN card_number IS NOT NULL THEN registration_date END AS registration_date,
  (SELECT count(*) FROM owned WHERE owner = users.id)::INT AS n_loans, pos::INT AS pos, book_title, loan_date, return_date, status
FROM users LEFT JOIN card ON card.owner = id LEFT JOIN history ON history.owner = id
""")
def _r7n(lib):
    p = R.user_profiles(lib)
    return p.select("user_id", "username", "email", "role", "created_at", F.col("reader_profile").isNotNull().alias("has_profile"), "reader_profile.*",
                    F.size("loan_history").alias("n_loans"), F.posexplode_outer("loan_history").alias("pos", "loan")).select("*", "loan.*").drop("loan")


@register("r8_user_statistics", """
SELECT u.id AS user_id, u.username, u.email, u.role, u.created_at, r.registration_date,
  CASE WHEN r.id IS NOT NULL THEN 'Yes' ELSE 'No' END AS is_reader
FROM users u LEFT JOIN readers r ON u.id = r.user_id
""")
def _r8(lib):
    return R.user_statistics_report(lib)


# ---------------------------------------------------------------- catalogue
from ..operators import catalog as C  # noqa: E402

_C1_BODY = """
  SELECT id, title, isbn, publication_year, genre, status, description,
    (SELECT first_name || ' ' || last_name FROM authors WHERE authors.id = author_id) AS author,
    (SELECT name FROM publishers WHERE publishers.id = publisher_id) AS publisher,
    (SELECT count(*) FROM books WHERE contains(lower(title), 'bolt') AND author_id IN (SELECT id FROM authors)) AS total_count
  FROM books WHERE contains(lower(title), 'bolt') AND author_id IN (SELECT id FROM authors)
  ORDER BY title, id LIMIT 9 OFFSET 9"""


@register("c1_catalog_search", f"""
SELECT t.*, CAST(CEIL(t.total_count / 9.0) AS BIGINT) AS pages FROM ({_C1_BODY}) t
""")
def _c1(lib):
    return C.catalog_search(lib, title="Bolt", page_no=2)


def _shelf(passes: str, author: str = "author", also: str = "") -> str:
    """Books with their names, those that pass."""
    columns = also or f"id, title, isbn, publication_year, genre, status, description, {author}, publisher"
    return f"""
WITH {_NAMED},
every AS (SELECT books.*, work.name AS {author}, (SELECT name FROM publishers WHERE publishers.id = publisher_id) AS publisher
          FROM books, work WHERE work.id = books.id),
listed AS (SELECT {columns} FROM every WHERE {passes})"""


@register("c2_available_books_basic", _shelf("status = 'available' AND contains(lower(author), '000000003')", also="id, title, isbn, status, author")
          + "\n" + _numbered("listed", 10, "title, id", 0))
def _c2(lib):
    return C.available_books_basic(lib, author="000000003", page_no=1)


@register("c3_available_for_reservation", _shelf(
    "status = 'available' AND contains(lower(title), 'red') AND id NOT IN (SELECT book_id FROM loans WHERE status = 'borrowed')", "author_name")
    + "\n" + _numbered("listed", 9, "title, id", 18))
def _c3(lib):
    return C.available_books_for_reservation(lib, title="red", page_no=3)


@register("c4_page_genres", f"""
SELECT DISTINCT genre FROM ({_C1_BODY}) t WHERE genre IS NOT NULL AND genre <> ''
""")
def _c4(lib):
    return C.page_genres(C.catalog_search(lib, title="Bolt", page_no=2))


@register("c5_page_totals", """
SELECT COUNT(*) AS total_count, CAST(CEIL(COUNT(*) / 9.0) AS BIGINT) AS pages
FROM books b JOIN authors a ON b.author_id = a.id
WHERE LOWER(b.title) LIKE '%gear%' AND b.status = 'available'
""")
def _c5(lib):
    return C.page_totals(C.catalog_rows(lib, title="gear", status="available"), 9)


@register("c6_users_list", "SELECT id, username, email, role FROM users")
def _c6(lib):
    return C.users_list(lib)


@register("c7_loans_filtered", f"""{_page_of_loans("status = 'borrowed' AND due_date < " + D_LOANS + " AND contains(lower(title), 'bolt')", 0)}
""")
def _c7(lib):
    return C.loans_filtered(lib, AS_OF_LOANS, status="borrowed", overdue=True, book_title="bolt")


@register("c8_reservations_filtered", """
SELECT t.*, CAST(CEIL(t.total_count / 10.0) AS BIGINT) AS pages FROM (
  SELECT res.id, res.start_date, res.end_date, res.status, b.title,
    CONCAT(r.first_name, ' ', r.last_name) AS reader, COUNT(*) OVER () AS total_count
  FROM reservations res JOIN books b ON res.book_id = b.id JOIN readers r ON res.reader_id = r.id
  WHERE res.status = 'pending' AND res.start_date BETWEEN DATE '1998-06-01' AND DATE '1998-06-07'
  ORDER BY res.start_date DESC NULLS FIRST, res.id LIMIT 10 OFFSET 0) t
""")
def _c8(lib):
    return C.reservations_filtered(lib, "1998-06-03", status="pending", date_filter="this_week")


@register("c9_split_author_name", """
SELECT id, CONCAT(first_name, ' ', last_name) AS full_name,
  COALESCE(split_part(CONCAT(first_name, ' ', last_name), ' ', 1), '') AS split_first_name,
  COALESCE(split_part(CONCAT(first_name, ' ', last_name), ' ', 2), '') AS split_last_name,
  (COALESCE(split_part(CONCAT(first_name, ' ', last_name), ' ', 1), '') = first_name
   AND COALESCE(split_part(CONCAT(first_name, ' ', last_name), ' ', 2), '') = last_name) AS lossless
FROM authors
""")
def _c9(lib):
    return C.split_author_name(lib)


# ---------------------------------------------------------------- reservations
from ..operators import reservations as V  # noqa: E402


@register("v1_book_reservations",
          "SELECT book_id, id, start_date, end_date, status FROM reservations WHERE status <> 'cancelled'")
def _v1(lib):
    return V.book_reservations(lib)


def _own_reservations(title: str, author: str, also: str = "") -> str:
    """What readers have reserved and not cancelled, by user."""
    return f"""
WITH {_NAMED}
SELECT user_id, reservations.id, {_of_book("title")} AS {title}, {_of_book("name")} AS {author}, start_date, end_date, status,
  (SELECT books.status FROM books WHERE books.id = book_id) AS book_status{also}
FROM reservations, who WHERE who.id = reader_id AND status <> 'cancelled' AND book_id IN (SELECT id FROM work)"""


@register("v2_user_reservations", _own_reservations("book_title", "author_name", ", reader_id"))
def _v2(lib):
    return V.user_reservations(lib)


@register("v3_reservations_page", _reservation_rows("", "LIMIT 10 OFFSET 40"))
def _v3(lib):
    return V.reservations_page(lib, page_no=5)


@register("v4_my_reservations", _own_reservations("title", "author"))
def _v4(lib):
    return V.my_reservations(lib)


@register("v5_check_availability", """
SELECT q.*, b.id IS NOT NULL AS book_exists, COALESCE(b.status, 'not_found') AS book_status,
  fc.req_id IS NOT NULL AS has_conflict, fc.holder AS current_holder
FROM availability_requests q
LEFT JOIN books b ON b.id = q.book_id
LEFT JOIN (
  SELECT req_id, holder FROM (
    SELECT q2.req_id, CONCAT(rd.first_name, ' ', rd.last_name) AS holder,
      ROW_NUMBER() OVER (PARTITION BY q2.req_id ORDER BY r.start_date, r.id) AS rn
    FROM availability_requests q2
    JOIN reservations r ON r.book_id = q2.book_id AND r.status <> 'cancelled'
      AND r.start_date <= q2.end_date AND r.end_date >= q2.start_date
    JOIN readers rd ON r.reader_id = rd.id) x
  WHERE rn = 1) fc ON fc.req_id = q.req_id
""")
def _v5(lib):
    return V.check_availability(lib, lib.availability_requests)


_IN = "((q.start_date BETWEEN r.start_date AND r.end_date) OR (q.end_date BETWEEN r.start_date AND r.end_date))"


@register("v6_conflict_dates", f"""
SELECT x.*, (x.book_conflict OR x.user_conflict) AS has_conflict FROM (
  SELECT q.*,
    EXISTS (SELECT 1 FROM reservations r WHERE r.book_id = q.book_id AND r.status <> 'cancelled' AND {_IN})
      AS book_conflict,
    EXISTS (SELECT 1 FROM reservations r JOIN readers rd ON r.reader_id = rd.id
            WHERE rd.user_id = q.user_id AND r.status <> 'cancelled' AND {_IN}) AS user_conflict
  FROM availability_requests q) x
""")
def _v6(lib):
    return V.conflict_dates(lib, lib.availability_requests)


# ---------------------------------------------------------------- views
from ..operators import views as M  # noqa: E402


@register("m1_reader_summary", """
SELECT id, first_name, last_name, email, (SELECT username FROM users WHERE users.id = user_id) AS username,
  (SELECT count(*) FROM loans WHERE reader_id = readers.id) AS total_loans,
  (SELECT count(*) FROM loans WHERE reader_id = readers.id AND status = 'borrowed') AS active_loans
FROM readers WHERE user_id IN (SELECT id FROM users)
""")
def _m1(lib):
    return M.reader_summary(lib)


@register("m2_book_genres", "SELECT DISTINCT genre FROM books WHERE genre IS NOT NULL")
def _m2(lib):
    return M.book_genres(lib)


# ---------------------------------------------------------------- parameter variants
@register("c1_catalog_search_filters", _shelf("contains(isbn, '00001') AND status = 'available' AND genre = 'PROMO'")
          + "\n" + _numbered("listed", 9, "title, id", 0))
def _c1b(lib):
    return C.catalog_search(lib, isbn="00001", status="available", genre="PROMO", page_no=1)


@register("r2_reader_requests_pending", _requests("status = 'pending'", "created_at", 0))
def _r2b(lib):
    return R.reader_requests_page(lib, "pending", page_no=1)


P5_TODAY = ("today", "1996-11-01")


@register("p5_period_loans_today", period_rows("loans", "loan_date", P5_TODAY, "loan_id", "loan_date, return_date"))
def _p5b(lib):
    return P.report_period_loans(lib, *P5_TODAY)
