"""Set-based command jobs against one-by-one Python models on the small fixture."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import commands_catalog as WC
from shelfspark.operators import commands_circulation as WL
from shelfspark.operators import commands_users as WU
from shelfspark.operators.batch import merge_rows
from shelfspark.operators.reservations import check_availability
from shelfspark.sources.fixtures import Library
from shelfspark.sources.store import TableStore
from shelfspark.streaming import jobs as S
from settings import SF_SMALL


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _sequential_reservations(lib, cmds_df, staff=False):
    books = {r["id"]: r["status"] for r in _rows(lib.books.select("id", "status"))}
    readers = _rows(lib.readers.select("id", "user_id"))
    reader_ids = {r["id"] for r in readers}
    by_user = {}
    for r in readers:
        by_user[r["user_id"]] = min(r["id"], by_user.get(r["user_id"], r["id"]))
    table = [r for r in _rows(lib.reservations.select("book_id", "reader_id", "start_date", "end_date", "status"))
             if r["status"] != "cancelled" and (staff or r["reader_id"] in reader_ids)]
    out = {}
    for c in sorted(_rows(cmds_df), key=lambda c: (c["submitted_at"], c["cmd_id"])):
        s, e, b = c["start_date"], c["end_date"], c["book_id"]
        reader = c.get("reader_id") if staff else by_user.get(c["user_id"])
        if s is None or e is None:
            reason = "Invalid date format"
        elif not staff and s < c["submitted_at"].date():
            reason = "Start date cannot be in the past"
        elif e < s:
            reason = "End date must be after start date"
        elif b not in books:
            reason = "Book not found"
        elif not staff and reader is None:
            reason = "User is not a registered reader"
        elif books[b] != "available":
            reason = "Book not available" if staff else "Book is not available"
        elif any(t["book_id"] == b and t["start_date"] <= e and t["end_date"] >= s for t in table):
            reason = "Date conflict" if staff else "Book is already reserved"
        else:
            reason = None
            table.append({"book_id": b, "reader_id": reader, "start_date": s, "end_date": e, "status": "pending"})
        out[c["cmd_id"]] = reason
    return out


def test_w8_in_batch_equals_sequential(lib):
    got = {r.cmd_id: r.reason for r in WL.create_reservations(lib, lib.reservation_commands).outcomes.collect()}
    assert got == _sequential_reservations(lib, lib.reservation_commands)


def _one_by_one(rows):
    """Accepted (cmd_id) of (cmd_id, submitted_at, book, start, end) rows."""
    held, out = {}, set()
    for i, at, book, s, e in sorted(rows, key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[0])):
        if not any(a <= e and s <= b for a, b in held.get(book, [])):
            held.setdefault(book, []).append((s, e))
            out.add(i)
    return out


REQUESTS = "cmd_id long, submitted_at timestamp_ntz, book_id long, start_date date, end_date date"


def test_accept_in_order_equals_one_by_one(spark):
    rng = random.Random(6)
    day = dt.date(1969, 6, 1)
    rows = []
    for i in range(1500):
        s = day + dt.timedelta(days=rng.randint(0, 1500))
        e = s + dt.timedelta(days=rng.choice([0, 1, 5, 20, 20, 200]))
        at = None if i % 97 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 300))
        rows.append((i, at, rng.choice([1, 1, 1, 2, 3, 4, 5]), s, e))
    rows += [(2000 + i, *rows[i][1:]) for i in range(0, 1500, 3)]  # repeated requests
    got = {r.cmd_id for r in WL.accept_in_order(spark.createDataFrame(rows, REQUESTS).repartition(5)).collect()}
    assert got == _one_by_one(rows)


@pytest.mark.parametrize("century", ["first", "last"])
def test_many_requests_of_one_book(spark, century):
    """100,000 requests of one book, and one for a hundred years that comes before or after them all; no days are made rows."""
    day = dt.date(1980, 1, 1)
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(seconds=i), 1, day + dt.timedelta(days=(i * 7919) % 9000), day + dt.timedelta(days=(i * 7919) % 9000 + i % 3)) for i in range(100_000)]
    rows.append((-1, at + dt.timedelta(days=-1 if century == "first" else 9), 1, day, day + dt.timedelta(days=36_500)))
    out = WL.accept_in_order(spark.createDataFrame(pd.DataFrame(rows, columns=[x.split()[0] for x in REQUESTS.split(", ")]), REQUESTS))
    got = {r.cmd_id for r in out.collect()}
    if century == "first":
        assert got == {-1}
        return
    taken, exp = set(), set()
    for i, _, _, s, e in rows[:-1]:
        days = range(s.toordinal(), e.toordinal() + 1)
        if taken.isdisjoint(days):
            taken.update(days)
            exp.add(i)
    assert got == exp


def test_w8_against_table_equals_sequential(lib):
    cmds = lib.availability_requests.withColumnRenamed("req_id", "cmd_id")
    got = {r.cmd_id: r.reason for r in WL.create_reservations(lib, cmds).outcomes.collect()}
    exp = _sequential_reservations(lib, cmds)
    assert got == exp
    assert any(v is None for v in exp.values()) and any(v == "Book is already reserved" for v in exp.values())


def test_w9_equals_sequential(lib):
    rd = lib.readers.groupBy(F.col("user_id").alias("_u")).agg(F.min("id").alias("reader_id"))
    c = lib.availability_requests.withColumnRenamed("req_id", "cmd_id")
    cmds = c.join(rd, c.user_id == rd._u, "left").drop("_u")
    got = {r.cmd_id: r.reason for r in WL.admin_create_reservations(lib, cmds).outcomes.collect()}
    assert got == _sequential_reservations(lib, cmds, staff=True)


def test_w8_no_two_accepted_overlap(lib):
    res = WL.create_reservations(lib, lib.reservation_commands)
    acc = res.outcomes.where("ok").join(lib.reservation_commands, "cmd_id").collect()
    for i, a in enumerate(acc):
        for b in acc[i + 1:]:
            if a.book_id == b.book_id:
                assert a.end_date < b.start_date or b.end_date < a.start_date


def test_w15_equals_sequential(lib):
    users = _rows(lib.users.select("username", "email"))
    names = {u["username"] for u in users} | {"admin"}
    emails = {u["email"] for u in users} | {"admin@library.com"}
    exp = {}
    for c in sorted(_rows(lib.register_commands), key=lambda c: (c["submitted_at"], c["cmd_id"])):
        if c["username"] is None or c["username"] in names or c["email"] in emails:
            exp[c["cmd_id"]] = False
        else:
            exp[c["cmd_id"]] = True
            names.add(c["username"])
            emails.add(c["email"])
    got = {r.cmd_id: r.ok for r in WU.register_users(lib, lib.register_commands).outcomes.collect()}
    assert got == exp


def _jobs(spark, run):
    """Number of Spark jobs that ``run`` starts, and its result."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out


def _sign_up_cases(rng, n):
    """Sign-ups that share usernames and emails, and a chain in which each takes the email of the next."""
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 500))
    rows = [(i, at(), f"u{rng.randint(0, n // 3)}", f"e{rng.randint(0, n // 3)}@x") for i in range(n)]
    return rows + [(10_000 + i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i), f"c{i // 2}", f"c{(i + 1) // 2}@x") for i in range(1000)]


def test_sign_ups_in_groups_equal_one_by_one(spark):
    from shelfspark.operators.ordered import accept_sign_ups
    rows = _sign_up_cases(random.Random(2), 600)
    names, mails, exp = set(), set(), set()
    for i, _, u, e in sorted(rows, key=lambda r: (r[1], r[0])):
        if u not in names and e not in mails:
            names.add(u)
            mails.add(e)
            exp.add(i)
    df = spark.createDataFrame(rows, "cmd_id long, submitted_at timestamp_ntz, username string, email string").repartition(4)
    jobs, got = _jobs(spark, lambda: {r.cmd_id for r in accept_sign_ups(df).collect()})
    assert got == exp
    assert jobs < 150  # the chain of 1,000 takes a logarithm of rounds


def test_isbn_claims_in_groups_equal_one_by_one(spark):
    from shelfspark.operators.ordered import decide_isbn_claims
    rng = random.Random(4)
    stored = [(b, f"i{b}" if b % 5 else None) for b in range(300)]
    claims = [(i, rng.randint(0, 99), rng.choice([None, *(f"i{rng.randint(0, 140)}" for _ in range(6)), f"new{rng.randint(0, 30)}"])) for i in range(500)]
    # a chain: each book takes the isbn that the one before has just left
    claims += [(1000 + i, 299 - i, "fresh" if i == 0 else f"i{300 - i}") for i in range(1, 150)]
    claims += [(990, 299, "other")]
    claims.sort()
    holder, held, exp = {x: b for b, x in stored if x}, dict(stored), {}
    for i, book, isbn in claims:
        exp[i] = isbn is None or holder.get(isbn, book) == book
        if exp[i]:
            if held.get(book) is not None:
                holder.pop(held[book], None)
            held[book] = isbn
            if isbn is not None:
                holder[isbn] = book
    df = spark.createDataFrame(claims, "cmd_id long, book_id long, isbn string").withColumn("o", F.struct(F.lit(0), "cmd_id")).repartition(4)
    jobs, got = _jobs(spark, lambda: {r.cmd_id: r.accepted for r in decide_isbn_claims(spark.createDataFrame(stored, "book_id long, isbn string"), df).collect()})
    assert got == exp
    assert jobs < 150


def test_w11_at_most_one_loan_per_book(lib):
    res = WL.create_loans(lib, lib.loan_commands, dt.date(1998, 6, 15))
    acc = res.outcomes.where("ok").join(lib.loan_commands, "cmd_id")
    assert acc.groupBy("book_id").count().where("count > 1").count() == 0
    books = res.tables["books"]
    borrowed = acc.select(F.col("book_id").alias("id"))
    assert books.join(borrowed, "id", "left_semi").where(F.col("status") != "borrowed").count() == 0


def test_w12_replay_changes_nothing(lib):
    first = WL.return_loans(lib, lib.return_commands, dt.date(2001, 8, 15))
    lib2 = lib.override(loans=first.tables["loans"].drop("updated_at"), books=first.tables["books"].drop("updated_at"))
    again = WL.return_loans(lib2, lib.return_commands, dt.date(2001, 8, 15))
    assert again.outcomes.where("ok").count() == 0


def test_merge_rows_replaces_and_stamps(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    ch = spark.createDataFrame([(2, "B"), (3, "C")], "id long, v string")
    out = {r.id: (r.v, r.updated_at is not None) for r in merge_rows(base, ch, "id", dt.datetime(2024, 1, 1)).collect()}
    assert out == {1: ("a", False), 2: ("B", True), 3: ("C", True)}


def test_merge_rows_keeps_unnamed_columns(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, v string, w long")
    ch = spark.createDataFrame([(2, None), (3, "C")], "id long, v string")
    out = {r.id: (r.v, r.w) for r in merge_rows(base, ch, "id", dt.datetime(2024, 1, 1)).collect()}
    assert out == {1: ("a", 10), 2: (None, 20), 3: ("C", None)}


def test_m5_equals_python_loop(spark, lib):
    got = {r.event_id: r.accepted for r in S.stream_book_status(spark, SF_SMALL).collect()}
    ev = lib.circulation_events.where(F.col("action").isin("borrow", "return")).toPandas()
    exp = {}
    for _, g in ev.sort_values(["ts", "event_id"]).groupby("book_id"):
        status = "available"
        for _, r in g.iterrows():
            ok = (r.action == "borrow" and status == "available") or (r.action == "return" and status == "borrowed")
            if ok:
                status = "borrowed" if r.action == "borrow" else "available"
            exp[int(r.event_id)] = ok
    assert got == exp


def test_m6_equals_python_loop(spark, lib):
    got = {r.event_id: r.accepted for r in S.stream_pending_requests(spark, SF_SMALL).collect()}
    ev = lib.raw("events").where(F.col("event_type").isin("view", "signup")).toPandas()
    exp = {}
    for _, g in ev.sort_values(["ts", "event_id"]).groupby("user_id"):
        since = None
        for _, r in g.iterrows():
            if r.event_type == "signup":
                since = None
                continue
            ok = since is None or not (since > r.ts - pd.Timedelta(days=30))
            if ok:
                since = r.ts
            exp[int(r.event_id)] = ok
    assert got == exp


def test_w5_replay_is_blocked(lib):
    as_of = dt.date(2024, 2, 27)
    first = WU.submit_reader_requests(lib, lib.request_commands, as_of)
    assert first.outcomes.where("ok").count() > 0
    lib2 = lib.override(reader_registration_requests=first.tables["reader_registration_requests"])
    again = WU.submit_reader_requests(lib2, lib.request_commands, as_of)
    # Every user who got a request through now has a pending one younger than 30 days.
    accepted_users = first.outcomes.where("ok").join(lib.request_commands, "cmd_id").select("user_id")
    assert again.outcomes.join(lib.request_commands, "cmd_id").join(accepted_users, "user_id", "left_semi") \
        .where("ok").count() == 0


def test_w10_cancel_twice_succeeds(lib):
    first = WL.cancel_reservations(lib, lib.cancel_commands, dt.datetime(2001, 8, 15))
    lib2 = lib.override(reservations=first.tables["reservations"].drop("updated_at"))
    again = WL.cancel_reservations(lib2, lib.cancel_commands, dt.datetime(2001, 8, 15))
    a = {r.reservation_id: r.ok for r in first.outcomes.collect()}
    b = {r.reservation_id: r.ok for r in again.outcomes.collect()}
    assert a == b  # the rule is only "not completed", so a repeat cancel succeeds again


def test_w11_replay_creates_no_loans(lib):
    as_of = dt.date(1998, 6, 15)
    first = WL.create_loans(lib, lib.loan_commands, as_of)
    assert first.outcomes.where("ok").count() > 0
    t = first.tables
    lib2 = lib.override(loans=t["loans"], books=t["books"].drop("updated_at"),
                        reservations=t["reservations"].drop("updated_at"))
    again = WL.create_loans(lib2, lib.loan_commands, as_of)
    assert again.outcomes.where("ok").count() == 0


def test_w4_equals_sequential(spark, lib):
    rnd = random.Random(5)
    books = [(i, f"b{i}", 1, f"i{i}" if i % 4 else None, 1, 2000, "g", "", "available") for i in range(12)]
    t0 = dt.datetime(2024, 1, 1)
    cmds = [(k, t0, rnd.randrange(14), f"i{rnd.randrange(16)}" if rnd.random() > 0.1 else None, 999 if k % 13 == 0 else 2001)
            for k in range(90)]
    held = {b[0]: b[3] for b in books}
    exp = {}
    for k, _, book, isbn, year in cmds:
        if book not in held:
            exp[k] = "Book not found"
        elif year < 1000:
            exp[k] = "Invalid publication year"
        elif isbn is not None and any(i == isbn and b != book for b, i in held.items()):
            exp[k] = "Duplicate isbn"
        else:
            exp[k], held[book] = None, isbn
    assert len(set(exp.values())) == 4
    small = lib.override(
        books=spark.createDataFrame(books, "id long, title string, author_id long, isbn string, publisher_id long, publication_year int, "
                                           "genre string, description string, status string"),
        authors=spark.createDataFrame([(1, "A", "B")], "id long, first_name string, last_name string"))
    c = spark.createDataFrame([(k, at, b, i, y, f"t{k}", "A", "B", "g") for k, at, b, i, y in cmds],
                              "cmd_id long, submitted_at timestamp_ntz, book_id long, isbn string, publication_year int, title string, "
                              "author_first_name string, author_last_name string, genre string")
    res = WC.update_books(small, c, dt.date(2024, 6, 1))
    assert {r.cmd_id: r.reason for r in res.outcomes.collect()} == exp
    assert {r.id: r.isbn for r in res.tables["books"].collect()} == held


def test_requests_without_a_holder_do_not_share_a_task(spark):
    day = dt.date(2000, 1, 1)
    lib = Library(spark, tables={
        "books": spark.createDataFrame([(1, "available"), (2, "available")], "id long, status string"),
        "readers": spark.createDataFrame([(7, "A", "B")], "id long, first_name string, last_name string"),
        "reservations": spark.createDataFrame([(10, 1, 7, day, day, "pending"), (11, 1, 8, day, day, "pending")],
                                              "id long, book_id long, reader_id long, start_date date, end_date date, status string")})
    rows = [(i, 1 if i == 3 else 2, day, day) for i in range(200)] + [(None, 2, day, day), (None, None, None, None), (10, 2, day, day), (10, 2, day, day)]
    requests = spark.createDataFrame(rows, "req_id long, book_id long, start_date date, end_date date")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = check_availability(lib, requests).withColumn("_task", F.spark_partition_id()).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted((r.req_id is None, r.req_id or 0) for r in found) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert [(r.req_id, r.current_holder) for r in found if r.has_conflict] == [(3, "A B")]
    assert all(r.current_holder is None for r in found if not r.has_conflict)
    tasks = pd.Series([r._task for r in found]).value_counts()
    assert len(tasks) > 1 and tasks.max() < len(rows) // 2


def test_stored_loans_take_their_commands_from_the_store(spark, monkeypatch):
    from shelfspark.plans.registry import QUERIES, load_all
    load_all()
    commands, first = {}, []
    for name in ("create_loans", "return_loans"):
        job = getattr(WL, name)
        monkeypatch.setattr(WL, name, lambda lib, cmds, as_of, name=name, job=job: commands.__setitem__(name, cmds) or job(lib, cmds, as_of))
    publish = TableStore.publish

    def watched(self, tables, based_on):
        if based_on < 0:
            first.extend(f for n in ("books", "loans", "reservations") for f in tables[n].inputFiles())
        return publish(self, tables, based_on)
    monkeypatch.setattr(TableStore, "publish", watched)
    stored = QUERIES["w11_w12_stored_loans"](spark, SF_SMALL)
    for cmds in commands.values():
        assert all("/tables/" in f for f in cmds.inputFiles())
    assert not any("lineitem" in f for f in first)
    lib = Library(spark, SF_SMALL)
    lent = WL.create_loans(lib, lib.loan_commands, dt.date(1998, 6, 15))
    after = lib.override(loans=lent.tables["loans"], books=lent.tables["books"])
    want = WL.return_loans(after, lib.return_commands, dt.date(2001, 8, 15)).tables["loans"].drop("updated_at")
    assert stored.exceptAll(want).count() == 0 and want.exceptAll(stored).count() == 0


def test_filter_on_lent_books_goes_below_the_grouping_of_lines(spark):
    books = Library(spark, SF_SMALL).books._jdf.queryExecution().optimizedPlan().toString()
    lines = books[books.index("Aggregate [l_orderkey"):]
    assert "% 20" in lines
