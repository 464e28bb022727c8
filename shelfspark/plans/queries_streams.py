"""Registered materialized-view and streaming queries (M3-M7)."""

from __future__ import annotations

from ..streaming import jobs as S
from .registry import register


@register("m3_stream_reader_summary", """
WITH fresh AS (SELECT reader_id AS k, count(*) AS n FROM circulation_events WHERE action = 'borrow' GROUP BY reader_id)
SELECT id, first_name, last_name, email, (SELECT username FROM users WHERE users.id = user_id) AS username,
  (SELECT count(*) FROM loans WHERE reader_id = readers.id) + COALESCE(n, 0) AS total_loans,
  (SELECT count(*) FROM loans WHERE reader_id = readers.id AND status = 'borrowed') + COALESCE(n, 0) AS active_loans
FROM readers LEFT JOIN fresh ON k = id WHERE user_id IN (SELECT id FROM users)
""")
def _m3(lib):
    return S.stream_reader_summary(lib.spark, lib.sf_dir)


@register("m4_stream_book_genres", "SELECT DISTINCT genre FROM books WHERE genre IS NOT NULL")
def _m4(lib):
    return S.stream_book_genres(lib.spark, lib.sf_dir)


@register("m3_reader_summary_changes", """
WITH taken AS (SELECT reader_id AS k, count(*) AS n, count(*) FILTER (WHERE event_id % 3 <> 0) AS out_now
               FROM circulation_events WHERE action = 'borrow' AND event_id % 5 <> 0 GROUP BY reader_id),
changed AS (SELECT DISTINCT ON (reader_id) reader_id AS rid, event_id AS e FROM circulation_events WHERE action = 'register'
            ORDER BY reader_id, ts DESC, event_id DESC),
base AS (SELECT readers.id, first_name, last_name, readers.email, users.username FROM readers, users WHERE users.id = user_id),
now AS (SELECT COALESCE(id, rid) AS id, e, first_name, last_name, email, username FROM base FULL JOIN changed ON rid = id
        WHERE e IS NULL OR e % 7 <> 0)
SELECT id, CASE WHEN e IS NULL THEN first_name ELSE 'S' || e END AS first_name, CASE WHEN e IS NULL THEN last_name ELSE 'Changed' END AS last_name,
  CASE WHEN e IS NULL THEN email ELSE 's' || e || '@example.com' END AS email, CASE WHEN e IS NULL THEN username ELSE 'u' || e END AS username,
  (SELECT count(*) FROM loans WHERE reader_id = now.id) + COALESCE(n, 0) AS total_loans,
  (SELECT count(*) FROM loans WHERE reader_id = now.id AND status = 'borrowed') + COALESCE(out_now, 0) AS active_loans
FROM now LEFT JOIN taken ON k = id
""")
def _m3c(lib):
    return S.stream_reader_summary_changes(lib.spark, lib.sf_dir)


@register("m4_book_genres_changes", """
SELECT DISTINCT p_type AS genre FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 13 <> 0
""")
def _m4c(lib):
    return S.stream_book_genres_changes(lib.spark, lib.sf_dir)


@register("m5_stream_book_status", """
SELECT event_id, book_id, action,
  action <> COALESCE(LAG(action) OVER (PARTITION BY book_id ORDER BY ts, event_id), 'return') AS accepted,
  CASE WHEN action = 'borrow' THEN 'borrowed' ELSE 'available' END AS status_after
FROM circulation_events WHERE action IN ('borrow', 'return')
""")
def _m5(lib):
    return S.stream_book_status(lib.spark, lib.sf_dir)


@register("m6_stream_pending_requests", """
WITH RECURSIVE
e AS (SELECT event_id, user_id, ts, event_type,
        ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
      FROM events WHERE event_type IN ('view', 'signup')),
f(user_id, k, since, event_id, event_type, accepted) AS (
  SELECT DISTINCT user_id, 0, CAST(NULL AS TIMESTAMP), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR),
    CAST(NULL AS BOOLEAN) FROM e
  UNION ALL
  SELECT e.user_id, e.k,
    CASE WHEN e.event_type = 'signup' THEN NULL
         WHEN f.since IS NULL OR NOT (f.since > e.ts - INTERVAL 30 DAY) THEN e.ts ELSE f.since END,
    e.event_id, e.event_type,
    CASE WHEN e.event_type = 'signup' THEN NULL
         ELSE (f.since IS NULL OR NOT (f.since > e.ts - INTERVAL 30 DAY)) END
  FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT event_id, user_id, accepted FROM f WHERE event_type = 'view'
""")
def _m6(lib):
    return S.stream_pending_requests(lib.spark, lib.sf_dir)


@register("m7_stream_period_counts", """
SELECT 'day' AS granularity, CAST(ts AS DATE) AS window_start, action, count(*) AS n
FROM circulation_events WHERE action IN ('borrow', 'reserve') GROUP BY 2, 3
UNION ALL
SELECT 'week' AS granularity, CAST(date_trunc('week', ts) AS DATE) AS window_start, action, count(*) AS n
FROM circulation_events WHERE action IN ('borrow', 'reserve') GROUP BY 2, 3
""")
def _m7(lib):
    return S.stream_period_counts(lib.spark, lib.sf_dir)
