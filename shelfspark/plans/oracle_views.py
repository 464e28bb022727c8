"""SQL oracle: the fixture views and one reference-shaped SQL text per query.

The oracle runs in DuckDB on the driver tables. Each text inlines the views
it needs as CTEs, in dependency order. The view texts are fixed values that
must equal the DataFrame derivations in ``sources/fixtures.py``.
"""

from __future__ import annotations

# Fixture view definitions.
VIEWS: dict[str, str] = {
    "authors": """SELECT s_suppkey AS id, split_part(s_name,'#',1) AS first_name, split_part(s_name,'#',2) AS last_name FROM supplier""",
    "publishers": """SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation""",
    "users": """SELECT c_custkey AS id, c_name AS username, lower(c_name) || '@example.com' AS email,
 CASE WHEN c_custkey % 50 = 0 THEN 'worker' ELSE 'user' END AS role, c_acctbal >= 0 AS is_active,
 DATE '1995-01-01' + CAST(c_custkey * 37 % 2000 AS INT) AS created_at FROM customer""",
    "readers": """SELECT c_custkey + 100000 AS id, c_custkey AS user_id, 'R' || CAST(c_custkey % 17 AS STRING) AS first_name,
 c_name AS last_name, lower(c_name) || '@example.com' AS email, c_mktsegment AS address,
 CAST(NULL AS STRING) AS card_number, '555-' || lpad(CAST(c_custkey AS STRING), 7, '0') AS phone_number,
 DATE '1995-01-01' + CAST(c_custkey * 53 % 2400 AS INT) AS registration_date FROM customer WHERE c_custkey % 5 <> 4""",
    "loans": """SELECT l.id, l.book_id, o.o_custkey + 100000 AS reader_id, l.loan_date,
 CASE WHEN l.flag = 'N' AND l.l_orderkey % 20 = 0 THEN NULL ELSE CAST(l.loan_date AS DATE) + CAST(1 + l.id % 40 AS INT) END AS return_date,
 CASE WHEN l.flag = 'N' AND l.l_orderkey % 20 = 0 THEN 'borrowed' ELSE 'returned' END AS status
 FROM (SELECT l_orderkey, l_orderkey * 10 + l_linenumber AS id, min(l_partkey) AS book_id, min(l_shipdate) AS loan_date, max(l_returnflag) AS flag
       FROM lineitem GROUP BY l_orderkey, l_linenumber) l
 JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_custkey % 5 <> 4""",
    "reservations": """SELECT l.id, l.book_id, l.reader_id, o.o_orderdate AS created_at, CAST(l.loan_date AS DATE) AS start_date,
 CAST(l.loan_date AS DATE) + CAST(1 + l.id % 21 AS INT) AS end_date,
 CASE WHEN l.status = 'borrowed' AND l.id % 5 <> 0 THEN 'completed' WHEN l.id % 4 = 0 THEN 'pending' WHEN l.id % 4 = 1 THEN 'cancelled' ELSE 'completed' END AS status
 FROM loans l JOIN orders o ON (l.id - l.id % 10) / 10 = o.o_orderkey""",
    "books": """SELECT p.p_partkey AS id, p.p_name AS title, p.p_partkey % 10 AS author_id, '978' || lpad(CAST(p.p_partkey AS STRING), 10, '0') AS isbn,
 CASE WHEN p.p_size % 7 = 0 THEN NULL ELSE CAST(p.p_size % 25 AS BIGINT) END AS publisher_id, 1950 + p.p_size AS publication_year,
 CASE WHEN p.p_partkey % 13 = 0 THEN NULL ELSE p.p_type END AS genre, p.p_brand AS description,
 CASE WHEN b.book_id IS NULL THEN 'available' ELSE 'borrowed' END AS status
 FROM part p LEFT JOIN (SELECT DISTINCT book_id FROM loans WHERE status = 'borrowed') b ON p.p_partkey = b.book_id""",
    "reader_registration_requests": """SELECT event_id AS id, user_id, ts AS created_at,
 CASE WHEN event_id % 3 = 0 THEN 'pending' WHEN event_id % 3 = 1 THEN 'approved' ELSE 'rejected' END AS status,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts + INTERVAL 1 DAY END AS processed_at,
 CASE WHEN event_id % 3 = 2 THEN props ELSE NULL END AS rejection_reason,
 'F' || CAST(user_id AS STRING) AS first_name, 'L' || CAST(user_id AS STRING) AS last_name, props AS address,
 '557-' || CAST(event_id AS STRING) AS phone_number
 FROM events WHERE event_type = 'signup'""",
    "reservation_commands": """SELECT event_id AS cmd_id, ts AS submitted_at, user_id, event_id % 211 AS book_id,
 CAST(ts AS DATE) + CAST(event_id % 6 - 1 AS INT) AS start_date, CAST(ts AS DATE) + CAST(event_id % 6 - 1 + event_id % 14 - 1 AS INT) AS end_date
 FROM events WHERE event_type = 'click'""",
    "loan_commands": """SELECT r.id AS cmd_id, r.book_id, r.reader_id, r.created_at AS submitted_at FROM reservations r WHERE r.id % 3 = 0""",
    "return_commands": """SELECT id AS cmd_id, loan_date AS submitted_at, id AS loan_id FROM loans WHERE id % 7 = 0
 UNION ALL SELECT id + 1000000000000 AS cmd_id, loan_date AS submitted_at, id AS loan_id FROM loans WHERE id % 14 = 0""",
    "circulation_events": """SELECT event_id, ts, user_id + 100000 AS reader_id, user_id - user_id % 3 AS book_id,
 CASE event_type WHEN 'click' THEN 'reserve' WHEN 'purchase' THEN 'borrow' WHEN 'view' THEN 'return' WHEN 'error' THEN 'cancel' ELSE 'register' END AS action FROM events""",
    "book_commands": """SELECT p_partkey AS cmd_id, TIMESTAMP '2001-08-15 08:00:00' AS submitted_at, p_name || ' II' AS title,
 CASE WHEN p_partkey % 3 = 0 THEN 'New' ELSE 'Supplier' END AS author_first_name, lpad(CAST(p_partkey % 12 AS STRING), 9, '0') AS author_last_name,
 CASE WHEN p_partkey % 4 = 0 THEN 'PUBLISHER_' || CAST(p_size AS STRING) ELSE 'NATION_' || CAST(p_size % 25 AS STRING) END AS publisher,
 CASE WHEN p_partkey % 11 = 0 THEN '978' ELSE '979' END || lpad(CAST(p_partkey AS STRING), 10, '0') AS isbn,
 CASE WHEN p_partkey % 17 = 0 THEN 999 ELSE 1950 + p_size END AS publication_year, p_type AS genre, p_partkey + p_size - 25 AS book_id
 FROM part WHERE p_partkey % 5 = 0""",
    "request_commands": """SELECT event_id AS cmd_id, ts AS submitted_at, user_id, 'F' || CAST(user_id AS STRING) AS first_name,
 'L' || CAST(user_id AS STRING) AS last_name, props AS address, '556-' || CAST(user_id AS STRING) AS phone_number FROM events WHERE event_type = 'view'""",
    "decision_commands": """SELECT event_id AS cmd_id, ts AS submitted_at, event_id - event_id % 2 AS request_id, user_id AS processor_id,
 CASE WHEN value < 20 THEN 'approve' ELSE 'reject' END AS decision, props AS reason FROM events""",
    "cancel_commands": """SELECT id AS cmd_id, created_at AS submitted_at, id AS reservation_id FROM reservations WHERE id % 9 = 0
 UNION ALL SELECT id + 1000000000000 AS cmd_id, created_at AS submitted_at, id AS reservation_id FROM reservations WHERE id % 18 = 0""",
    "role_commands": """SELECT event_id AS cmd_id, ts AS submitted_at, user_id, CASE event_id % 3 WHEN 0 THEN 'worker' WHEN 1 THEN 'user' ELSE 'admin' END AS role
 FROM events WHERE event_type = 'error'""",
    "delete_commands": """SELECT event_id AS cmd_id, ts AS submitted_at, user_id FROM events WHERE event_type = 'click' AND event_id % 2 = 0""",
    "register_commands": """SELECT event_id AS cmd_id, ts AS submitted_at, CASE WHEN event_id % 97 <> 0 THEN 'new' || CAST(event_id % 700 AS STRING) END AS username,
 CASE WHEN event_id % 10 = 0 THEN 'customer#' || lpad(CAST(user_id AS STRING), 9, '0') ELSE 'm' || CAST(event_id % 900 AS STRING) END || '@example.com' AS email
 FROM events WHERE event_type = 'signup'""",
    "availability_requests": """SELECT o_orderkey AS req_id, o_orderdate AS submitted_at, o_custkey AS user_id, o_orderkey % 211 AS book_id,
 CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 - 1 AS INT) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 + o_orderkey % 14 - 2 AS INT) AS end_date
 FROM orders""",
}
