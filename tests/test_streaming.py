"""Streaming semantics beyond stream = batch: late data past the watermark is dropped."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from shelfspark.operators.views import reader_summary
from shelfspark.streaming import jobs as S


def _events(spark, start, n, first_id):
    rows = [(first_id + i, start + dt.timedelta(hours=6 * i), 1, "purchase", 1.0, "{}") for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                       "value double, props string")


def _write(spark, d, name, df, mtime):
    df.coalesce(1).write.parquet(os.path.join(d, name))
    for root, _, files in os.walk(os.path.join(d, name)):
        for f in files:
            os.utime(os.path.join(root, f), (mtime, mtime))


def test_late_rows_past_watermark_are_dropped(spark):
    # Late rows are judged against the watermark of the previous micro-batch, so the late
    # file comes third: batch 0 sets the watermark, batch 1 carries it, batch 2 is late.
    d = tempfile.mkdtemp(prefix="late-")
    _write(spark, d, "events.parquet", _events(spark, dt.datetime(2024, 3, 10), 40, 0), 1_900_000_000)
    _write(spark, d, "events_more.parquet", _events(spark, dt.datetime(2024, 3, 20), 8, 500), 1_950_000_000)
    _write(spark, d, "events_late.parquet", _events(spark, dt.datetime(2024, 1, 1), 8, 1000), 2_000_000_000)
    out = S.stream_period_counts(spark, d, watermark="1 day", max_files=1)
    days = {r.window_start: r.n for r in out.where("granularity = 'day'").collect()}
    assert sum(days.values()) == 48
    assert all(k >= dt.date(2024, 3, 10) for k in days)
    weeks = {r.window_start: r.n for r in out.where("granularity = 'week'").collect()}
    assert all(k.weekday() == 0 for k in weeks) and sum(weeks.values()) == 48


def test_without_watermark_pressure_late_rows_count(spark):
    d = tempfile.mkdtemp(prefix="late2-")
    _write(spark, d, "events.parquet", _events(spark, dt.datetime(2024, 3, 10), 40, 0), 1_900_000_000)
    _write(spark, d, "events_more.parquet", _events(spark, dt.datetime(2024, 3, 20), 8, 500), 1_950_000_000)
    _write(spark, d, "events_late.parquet", _events(spark, dt.datetime(2024, 1, 1), 8, 1000), 2_000_000_000)
    out = S.stream_period_counts(spark, d, watermark="365 days", max_files=1)
    assert sum(r.n for r in out.where("granularity = 'day'").collect()) == 56


def test_keyed_table_replay_and_restart(spark):
    from shelfspark.streaming.runner import KeyedTable
    base = tempfile.mkdtemp(prefix="keyed-")
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v long")
    table = lambda: KeyedTable(spark, "t", ["k"], lambda d: d.groupBy("k").agg(F.sum("v").alias("v")), rows((1, 10), (2, 20)), base)
    t = table()
    t.apply(rows((2, 1), (3, 30)), 0)
    t.apply(rows((1, 1)), 1)
    t.apply(rows((1, 1)), 1)  # replayed epoch: not counted twice
    t.apply(rows(), 2)
    assert {r.k: r.v for r in t.current().collect()} == {1: 11, 2: 21, 3: 30}
    again = table()  # restart: goes on from storage
    again.apply(rows((1, 1)), 1)
    again.apply(rows((4, 40), (4, 1)), 3)
    assert {r.k: r.v for r in again.current().collect()} == {1: 11, 2: 21, 3: 30, 4: 41}


def test_keyed_table_stays_small_and_an_epoch_costs_its_changes(spark):
    """After many epochs: a handful of runs and two lists; rows rewritten grow with rows times log(rows), not with epochs times rows."""
    from shelfspark.sources.files import list_names
    from shelfspark.streaming.runner import KeyedTable
    base, per_epoch, EPOCHS = tempfile.mkdtemp(prefix="epochs-"), 100, 50
    t = KeyedTable(spark, "t", ["k"], lambda d: d.groupBy("k").agg(F.sum("v").alias("v")), spark.range(10_000).selectExpr("id AS k", "1L AS v"), base)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        for e in range(EPOCHS):
            t.apply(spark.range(e * per_epoch, (e + 1) * per_epoch, 1, 1).selectExpr("10000 - 100 + id AS k", "1L AS v"), e)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    names = list_names(spark, base)
    runs = t.published()["runs"]
    assert len(runs) <= 8 and len([n for n in names if n.startswith("run-")]) <= 2 * len(runs) + 2
    assert len([n for n in list_names(spark, f"{base}/published") if n.endswith(".json")]) == 2
    assert sum(n for _, n, _ in t.work) == EPOCHS * per_epoch
    assert sum(f for _, _, f in t.work) <= 12 * (EPOCHS * per_epoch) + 3 * 20_000
    assert sorted(f for _, _, f in t.work)[EPOCHS // 2] <= 10 * per_epoch  # an epoch in the middle
    got = t.current().agg(F.count("k"), F.sum("v")).first()
    assert tuple(got) == (10_000 - 100 + EPOCHS * per_epoch, 10_000 + EPOCHS * per_epoch)


def test_reader_summary_follows_returns_and_resumes(spark, lib):
    """A return lowers active_loans, a delete total_loans; a resumed job counts nothing twice."""
    from settings import SF_SMALL
    d = tempfile.mkdtemp(prefix="changes-")
    for t in ("customer", "orders", "lineitem", "nation", "supplier", "part"):
        os.symlink(os.path.join(SF_SMALL, f"{t}.parquet"), os.path.join(d, f"{t}.parquet"))
    row = lambda i, user, kind: (i, dt.datetime(2024, 3, 10) + dt.timedelta(hours=i), user, kind, 1.0, "{}")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    # Reader of user 1: loan 1 stays out, 3 is returned, 5 deleted, 15 returned and deleted. Reader of user 2 is deleted by event 7.
    _write(spark, d, "events.parquet", spark.createDataFrame(
        [row(1, 1, "purchase"), row(3, 1, "purchase"), row(5, 1, "purchase"), row(7, 2, "signup")], schema), 1_900_000_000)
    base, checkpoint = tempfile.mkdtemp(prefix="base-"), tempfile.mkdtemp(prefix="ckpt-")
    before = {r.id: (r.total_loans, r.active_loans, r.last_name) for r in reader_summary(lib).collect()}
    run = lambda: {r.id: (r.total_loans, r.active_loans, r.last_name)
                   for r in S.stream_reader_summary_changes(spark, d, 1, base, checkpoint).collect()}
    total, active, name = before[100001]
    first = run()
    assert first == {**{k: v for k, v in before.items() if k != 100002}, 100001: (total + 2, active + 1, name)}
    _write(spark, d, "events_b.parquet", spark.createDataFrame(
        [row(15, 1, "purchase"), row(2, 1, "purchase"), row(4, 1, "signup"), row(6, 2, "signup")], schema), 1_950_000_000)
    # Event 6 came late: the deletion by event 7 is the later change.
    assert run() == {**first, 100001: (total + 3, active + 2, "Changed")}


def test_genre_leaves_with_its_last_book(spark):
    books = spark.createDataFrame([(None, "a"), (None, "b"), ("a", "c"), (None, None), ("c", None), (None, "b"), ("b", None)],
                                  "old_genre string, new_genre string")
    d = tempfile.mkdtemp(prefix="genres-")
    _write(spark, d, "books", books, 1_900_000_000)
    out = S.maintain_book_genres(spark.readStream.schema(books.schema).parquet(os.path.join(d, "books")))
    assert [r.genre for r in out.collect()] == ["b"]


def _three_events(spark):
    """One book and one user; the second file holds the earliest event."""
    d = tempfile.mkdtemp(prefix="order-")
    at = dt.datetime(2024, 3, 10)
    row = lambda i, hours, kind: (i, at + dt.timedelta(hours=hours), 1, kind, 1.0, "{}")
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    _write(spark, d, "events.parquet", spark.createDataFrame([row(120, 5, "purchase"), row(200, 9, "view")], schema), 1_900_000_000)
    _write(spark, d, "events_b.parquet", spark.createDataFrame([row(80, 1, "purchase"), row(90, 2, "view"), row(95, 3, "signup")], schema), 1_950_000_000)
    return d


def test_book_status_does_not_depend_on_the_batch_size(spark):
    d = _three_events(spark)
    runs = [{r.event_id: r.accepted for r in S.stream_book_status(spark, d, max_files=n).collect()} for n in (None, 1)]
    assert runs[0] == runs[1] == {80: True, 90: True, 120: True, 200: True}


def test_pending_requests_do_not_depend_on_the_batch_size(spark):
    d = _three_events(spark)
    runs = [{r.event_id: r.accepted for r in S.stream_pending_requests(spark, d, max_files=n).collect()} for n in (None, 1)]
    assert runs[0] == runs[1] == {90: True, 200: True}


def test_book_status_resumes_from_storage(spark):
    d = _three_events(spark)
    base, checkpoint = tempfile.mkdtemp(prefix="base-"), tempfile.mkdtemp(prefix="ckpt-")
    S.stream_book_status(spark, d, base=base, checkpoint=checkpoint)
    more = spark.createDataFrame([(300, dt.datetime(2024, 3, 11), 1, "view", 1.0, "{}")],
                                 "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    _write(spark, d, "events_c.parquet", more, 2_000_000_000)
    out = {r.event_id: r.accepted for r in S.stream_book_status(spark, d, base=base, checkpoint=checkpoint).collect()}
    assert out == {80: True, 90: True, 120: True, 200: True, 300: False}


SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _shuffled_days(spark, d, files=6, users=4, seed=0):
    """Events of some weeks, each file a run of days with events up to two days out of order; also as one list in order."""
    rng = random.Random(seed)
    rows = []
    for i in range(files * 40):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(days=6 * (i // 40), hours=rng.randint(0, 24 * 8))
        rows.append((i, ts, rng.choice([*range(users), None]), rng.choice(["purchase", "view", "signup", "view"]), 1.0, "{}"))
    for k in range(files):
        _write(spark, d, f"events{k}.parquet" if k else "events.parquet", spark.createDataFrame(rows[40 * k:40 * k + 40], SCHEMA), 1_900_000_000 + 1000 * k)
    return sorted(rows, key=lambda r: (r[1], r[0]))


def _status(rows):
    """M5 one event after the other."""
    last, out = {}, {}
    for i, _, user, kind, *_ in rows:
        if kind in ("purchase", "view"):
            book = None if user is None else user - user % 3
            out[i] = last.get(book, "view") != kind
            last[book] = kind
    return out


def _spacing(rows):
    """M6 one event after the other."""
    until, out = {}, {}
    for i, ts, user, kind, *_ in rows:
        if kind == "signup":
            until[user] = None
        elif kind == "view":
            out[i] = until.get(user) is None or ts >= until[user]
            until[user] = ts + dt.timedelta(days=30) if out[i] else until[user]
    return out


def test_ordered_jobs_fold_passed_events_and_take_late_ones(spark):
    """A watermark of ten days over five weeks: state is folded again and again, answers stay those of one pass in order."""
    d = tempfile.mkdtemp(prefix="weeks-")
    rows = _shuffled_days(spark, d)
    for n in (1, None):
        assert {r.event_id: r.accepted for r in S.stream_book_status(spark, d, n, watermark="10 days").collect()} == _status(rows)
        assert {r.event_id: r.accepted for r in S.stream_pending_requests(spark, d, n, watermark="10 days").collect()} == _spacing(rows)


def test_ordered_jobs_drop_what_the_watermark_has_passed(spark):
    d = tempfile.mkdtemp(prefix="dropped-")
    row = lambda i, day, kind: (i, dt.datetime(2024, 1, day), 1, kind, 1.0, "{}")
    files = [[row(1, 10, "purchase")], [row(2, 20, "purchase")], [row(3, 5, "purchase")], [row(4, 21, "view"), row(5, 20, "view")]]
    for k, rows in enumerate(files):
        _write(spark, d, f"events{k}.parquet" if k else "events.parquet", spark.createDataFrame(rows, SCHEMA), 1_900_000_000 + 1000 * k)
    out = {r.event_id: r.accepted for r in S.stream_book_status(spark, d, 1, watermark="2 days").collect()}
    assert out == {1: True, 2: False, 5: True, 4: False}


@pytest.mark.parametrize("job", [S.stream_book_status, S.stream_pending_requests])
def test_killed_job_resumes(spark, monkeypatch, job):
    """The job dies in its third epoch, once before and once behind its result's publication, and goes on from its checkpoint."""
    from shelfspark.streaming.runner import KeyedTable
    d = tempfile.mkdtemp(prefix="killed-")
    rows = _shuffled_days(spark, d, seed=3)
    expected = _status(rows) if job is S.stream_book_status else _spacing(rows)
    whole = KeyedTable.apply
    for late in (False, True):
        base, checkpoint = tempfile.mkdtemp(prefix="base-"), tempfile.mkdtemp(prefix="ckpt-")

        def dies(self, changes, epoch):
            if late or epoch != 2:
                whole(self, changes, epoch)
            if epoch == 2:
                raise RuntimeError("killed")

        monkeypatch.setattr(KeyedTable, "apply", dies)
        with pytest.raises(Exception, match="killed"):
            job(spark, d, 1, base, checkpoint, watermark="10 days")
        monkeypatch.setattr(KeyedTable, "apply", whole)
        assert {r.event_id: r.accepted for r in job(spark, d, 1, base, checkpoint, watermark="10 days").collect()} == expected


def test_period_counts_resume(spark):
    d = tempfile.mkdtemp(prefix="periods-")
    base, checkpoint = tempfile.mkdtemp(prefix="base-"), tempfile.mkdtemp(prefix="ckpt-")
    run = lambda: {(r.granularity, r.window_start): r.n for r in S.stream_period_counts(spark, d, base=base, checkpoint=checkpoint).collect()}
    _write(spark, d, "events.parquet", _events(spark, dt.datetime(2024, 3, 10), 6, 0), 1_900_000_000)
    assert run()["day", dt.date(2024, 3, 10)] == 4
    _write(spark, d, "events_b.parquet", _events(spark, dt.datetime(2024, 3, 11, 12), 4, 100), 1_950_000_000)
    out = run()
    assert out["day", dt.date(2024, 3, 10)] == 4 and out["day", dt.date(2024, 3, 11)] == 4 and sum(n for (g, _), n in out.items() if g == "week") == 10
