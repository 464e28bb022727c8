"""Distributed helpers against direct computations."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from shelfspark.functions.dates import period_bounds
from shelfspark.functions.intervals import earliest_ending_from
from shelfspark.functions.ordering import PagedTable, SortKey, global_rank, page, seek_page


def test_period_bounds():
    d = dt.date(2024, 6, 13)  # a Thursday
    assert period_bounds("today", d) == (d, d)
    assert period_bounds("week", d) == (dt.date(2024, 6, 10), d)
    assert period_bounds("month", d) == (dt.date(2024, 6, 1), d)
    assert period_bounds("year", d) == (dt.date(2024, 1, 1), d)
    try:
        period_bounds("decade", d)
        raise AssertionError("expected rejection")
    except ValueError:
        pass


def test_global_rank_matches_pandas(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 5), rnd.choice([None, 1, 2, 3])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a long, b long")
    got = global_rank(df, ["a", "b"], [F.col("a").desc(), F.col("b").desc_nulls_last()], out="r", partitions=4)
    got = {r.id: r.r for r in got.collect()}
    pdf = pd.DataFrame(rows, columns=["id", "a", "b"])
    # rank = 1 + rows strictly before in (a desc, b desc nulls last)
    def before(x, y):
        if x.a != y.a:
            return x.a > y.a
        bx = -1 if pd.isna(x.b) else x.b
        by = -1 if pd.isna(y.b) else y.b
        return bx > by
    exp = {}
    recs = list(pdf.itertuples())
    for r in recs:
        exp[r.id] = 1 + sum(1 for o in recs if before(o, r))
    assert got == exp


def test_dense_rank(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, 1)], "id long, v long")
    got = {r.id: r.r for r in global_rank(df, ["v"], [F.col("v").desc()], out="r", dense=True).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3}


def test_page_total_and_rows(spark):
    df = spark.createDataFrame([(i, f"t{i % 7}") for i in range(1, 24)], "id long, title string")
    p = page(df, [F.col("title"), F.col("id")], 3, 9).collect()
    assert len(p) == 5
    assert {r.total_count for r in p} == {23}
    assert {r.pages for r in p} == {3}
    assert page(df, [F.col("id")], 4, 9).count() == 0


def test_earliest_ending_from_equals_brute_force(spark):
    rnd = random.Random(3)
    base = dt.date(1969, 11, 1)  # days on both sides of the epoch
    def iv(i, n):
        s = base + dt.timedelta(days=rnd.randint(0, 400))
        return (i, rnd.randint(1, n), s, s + dt.timedelta(days=rnd.randint(-2, 30)))
    req = [iv(i, 5) for i in range(200)] + [(900, 1, None, base), (901, None, base, base)]
    res = [iv((-1) ** i * (1000 + i), 4) for i in range(150)] + [(2000, 1, None, base), (2001, 1, base, None), (2002, None, base, base)]
    res += [(3000, 2, base + dt.timedelta(days=900), base + dt.timedelta(days=40_000))]  # a century long
    a = spark.createDataFrame(req, "qid long, qk long, qs date, qe date")
    b = spark.createDataFrame(res, "rid long, rk long, rs date, re date")
    got = {r.qid: r.e and (r.e.rs, r.e.rid) for r in earliest_ending_from(a, b, "qk", "qs", "rk", "rs", "re", "rid", "e").collect()}
    whole = [r for r in res if r[1] and r[2] and r[3]]
    exp = {q[0]: min(((r[2], r[0]) for r in whole if r[1] == q[1] and q[2] and r[3] >= q[2]), default=None) for q in req}
    assert got == exp
    for q in req:  # and it tells which requests overlap an interval
        overlaps = any(q[2] and r[1] == q[1] and r[2] <= q[3] and r[3] >= q[2] for r in whole)
        assert overlaps == bool(got[q[0]] and got[q[0]][0] <= q[3])


def test_covered_points_equal_brute_force(spark):
    from shelfspark.functions.intervals import covered
    rnd = random.Random(11)
    base = dt.date(2024, 1, 1)
    ivs = [(rnd.randint(1, 3), s, s + dt.timedelta(days=rnd.randint(0, 6))) for s in (base + dt.timedelta(days=rnd.randint(0, 300)) for _ in range(60))]
    ivs.append((4, base - dt.timedelta(days=40_000), base + dt.timedelta(days=40_000)))
    pts = [(i, rnd.randint(1, 5), base + dt.timedelta(days=rnd.randint(-10, 310))) for i in range(400)] + [(900, 4, None), (901, None, base)]
    got = {r.pid for r in covered(spark.createDataFrame(pts, "pid long, k long, d date"), spark.createDataFrame(ivs, "ik long, s date, e date"), "k", "d", "ik", "s", "e").collect()}
    assert got == {i for i, k, d in pts if d and any(k == ik and s <= d <= e for ik, s, e in ivs)}
    plan = covered(spark.createDataFrame(pts, "pid long, k long, d date"), spark.createDataFrame(ivs, "ik long, s date, e date"), "k", "d", "ik", "s", "e")
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()


def _paged(spark):
    rnd = random.Random(9)
    rows = [(i, rnd.choice([None, *range(12)]), rnd.choice([None, "a", "b", "c"])) for i in range(997)]
    rnd.shuffle(rows)
    keys = [SortKey("d", descending=True, nulls_first=True), SortKey("s"), SortKey("id")]
    order = sorted(rows, key=lambda r: (r[1] is not None, -(r[1] or 0), r[2] is None, r[2] or "", r[0]))
    return spark.createDataFrame(rows, "id long, d int, s string"), keys, [r[0] for r in order]


def test_seek_pages_walk_the_whole_order(spark):
    df, keys, order = _paged(spark)
    seen, last = [], None
    while True:
        rows = seek_page(df, keys, last, 173).collect()
        if not rows:
            break
        seen += [r.id for r in rows]
        last = rows[-1].asDict()
    assert seen == order
    plan = seek_page(df, keys, last, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_paged_table_equals_offset_pages_and_reads_the_pages_ranges(spark):
    df, keys, order = _paged(spark)
    t = PagedTable(df, keys, ranges=10)
    assert t.total == 997 and sum(n for _, n in t.ranges) == 997 and len(t.ranges) > 5
    for no, per in ((1, 10), (37, 10), (100, 10), (101, 10), (2, 400), (3, 400), (1, 2000), (400, 10)):
        got = t.page(no, per).collect()
        assert [r.id for r in got] == order[(no - 1) * per:no * per]
        assert {tuple(r) for r in got} == {tuple(r) for r in page(df, [k.column() for k in keys], no, per).collect()}
    found, _ = t.located(50, 10)
    assert len(found) <= 2
    plan = t.page(50, 10)._jdf.queryExecution().executedPlan().toString()
    assert all("_range#" in x and "PartitionFilters: []" not in x for x in plan.splitlines() if "FileScan" in x)
    empty = PagedTable(df.limit(0), keys)
    assert empty.total == 0 and empty.page(1, 10).count() == 0
