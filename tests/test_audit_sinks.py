"""Constraint audit on data-quality cases, and the report / snapshot writers."""

import datetime as dt
import glob
import os
import tempfile

import pytest

from shelfspark.operators.audit import audit_constraints
from shelfspark.sources.loads import insert_if_absent, load_tables, resolve_keys
from shelfspark.sources.sinks import export_snapshot, write_period_report, write_report_csv, write_report_json


def test_audit_finds_each_case(spark):
    authors = spark.createDataFrame([(1, "A", "B"), (2, "A", "B")], "id long, first_name string, last_name string")
    books = spark.createDataFrame(
        [(1, "T", 1, "X1", 999), (2, None, 1, "X1", 2025), (3, "U", 7, "X3", 2000)],
        "id long, title string, author_id long, isbn string, publication_year int")
    users = spark.createDataFrame([(1, "u", "e" * 121)], "id long, username string, email string")
    loans = spark.createDataFrame([(1, 42, None, "borrowed")], "id long, book_id long, reader_id long, status string")
    v = audit_constraints({"authors": authors, "books": books, "users": users, "loans": loans}, dt.date(2024, 6, 15))
    got = {(r.table_name, r.rule, r.column_name) for r in v.collect()}
    assert ("authors", "unique", "first_name,last_name") in got
    assert ("books", "unique", "isbn") in got
    assert ("books", "not_null", "title") in got
    assert ("books", "check_publication_year", "publication_year") in got
    assert ("books", "foreign_key", "author_id") in got
    assert ("users", "varchar_length", "email") in got
    assert ("loans", "foreign_key", "book_id") in got
    years = {r.row_key for r in v.collect() if r.rule == "check_publication_year"}
    assert years == {"1", "2"}


def test_audit_scans_each_table_twice_at_most(spark, lib, tmp_path):
    from shelfspark.operators.audit import broken
    from shelfspark.sources.fixtures import CIRCULATION_TABLES
    for t in CIRCULATION_TABLES:
        lib.table(t).write.parquet(f"{tmp_path}/{t}")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    tables = {t: spark.read.parquet(f"{tmp_path}/{t}") for t in CIRCULATION_TABLES}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    first, second = plan(broken(tables, "2001-08-15")), plan(audit_constraints(tables, "2001-08-15"))
    for t in CIRCULATION_TABLES:
        assert first.count(f"{tmp_path}/{t}]") == 1 and second.count(f"{tmp_path}/{t}]") <= 1
    assert first.count("Exchange hashpartitioning") == 1
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_audit_keeps_composite_keys_and_repeated_rows_apart(spark):
    authors = spark.createDataFrame([(1, "a|b", "c"), (2, "a", "b|c"), (3, "x", None), (3, "x", None), (None, "n", "n")], "id long, first_name string, last_name string")
    books = spark.createDataFrame([(i, "t", a) for i, a in enumerate([1, 9, 9, 9, None])], "id long, title string, author_id long")
    out = sorted((r.table_name, r.rule, r.column_name, r.row_key or "", r.detail or "") for r in audit_constraints({"authors": authors, "books": books}, "2001-01-01").collect())
    assert out == sorted([("authors", "not_null", "id", "", ""), ("authors", "not_null", "last_name", "3", ""), ("authors", "not_null", "last_name", "3", ""),
                          ("authors", "unique", "id", "3", "2"), *(("books", "foreign_key", "author_id", str(i), "9") for i in (1, 2, 3))])


def test_report_writers(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("a", dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5)), ("b", None, None)],
                               "name string, day date, ts timestamp_ntz")
    write_report_csv(df, f"{d}/csv", {"name": "Name", "day": "Day"}, null_label="N/A")
    text = "".join(open(p).read() for p in glob.glob(f"{d}/csv/*.csv"))
    assert "Name,Day" in text and "b,N/A" in text and "a,2024-01-02" in text
    write_report_json(df, f"{d}/json")
    js = "".join(open(p).read() for p in glob.glob(f"{d}/json/*.json"))
    assert "2024-01-02T03:04:05" in js
    write_period_report(df.where("false"), "loans", dt.date(2024, 1, 1), dt.date(2024, 1, 7), f"{d}/period")
    files = glob.glob(f"{d}/period/**/*.csv", recursive=True)
    assert files and any("name,day,ts" in open(p).read() for p in files)


def test_snapshot_manifest_and_reload(spark, lib):
    d = tempfile.mkdtemp()
    m = export_snapshot(spark, {"authors": lib.authors, "publishers": lib.publishers}, d, dt.datetime(2024, 1, 1))
    rows = {r.table: r.rows for r in m.collect()}
    assert rows == {"authors": lib.authors.count(), "publishers": lib.publishers.count()}
    loaded = load_tables(spark, os.path.join(d, "20240101_000000"), ["authors", "publishers"])
    assert loaded["authors"].schema["created_at"].dataType.typeName() == "timestamp_ntz"
    assert loaded["authors"].count() == rows["authors"]


def test_insert_if_absent_and_resolve(spark):
    t = spark.createDataFrame([(1, "a")], "id long, name string")
    new = spark.createDataFrame([(5, "a", 2), (6, "b", 2), (7, "b", 1)], "id long, name string, o int")
    out = {r.name: r.id for r in insert_if_absent(t, new.select("id", "name", "o"), "name", order=["o"]).collect()}
    assert out == {"a": 1, "b": 7}
    facts = spark.createDataFrame([("a",), ("zz",)], "name string")
    got = {r.name: r.pid for r in resolve_keys(facts, t, {"name": "name"}, "id", "pid").collect()}
    assert got == {"a": 1, "zz": None}


def test_stored_tables_as_library(spark, lib, tmp_path):
    import datetime as dt

    from shelfspark.operators import commands_circulation as WL
    from shelfspark.operators import loans as L
    from shelfspark.operators import reports as P
    from shelfspark.operators import views as M
    from shelfspark.sources.fixtures import CIRCULATION_TABLES, Library
    from shelfspark.sources.loads import load_tables
    for t in CIRCULATION_TABLES:
        lib.table(t).write.parquet(f"{tmp_path}/{t}")
    stored = Library(spark, tables=load_tables(spark, str(tmp_path)))
    day = dt.date(1998, 6, 15)
    assert P.report_popular_books(stored).count() == P.report_popular_books(lib).count() > 0
    assert L.reader_loans(stored, day).count() == L.reader_loans(lib, day).count() > 0
    assert M.reader_summary(stored).count() == M.reader_summary(lib).count() > 0
    ok = [WL.create_loans(x, lib.loan_commands, day).outcomes.where("ok").count() for x in (stored, lib)]
    assert ok[0] == ok[1] > 0


def test_period_report_run_twice_leaves_one_copy(spark, tmp_path):
    import datetime as dt

    from shelfspark.sources.sinks import write_period_report
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    for days in (1, 1, 2):
        write_period_report(df, "x", dt.date(2024, 1, days), dt.date(2024, 1, 9), f"{tmp_path}/r")
    assert spark.read.option("header", True).csv(f"{tmp_path}/r").groupBy("period_start").count().collect()[0]["count"] == 2


def test_loads_refuse_tables_that_do_not_fit(spark, tmp_path):
    from shelfspark.sources.loads import SchemaMismatch
    spark.createDataFrame([(1, "A", "B")], "id int, first_name string, last_name string").write.parquet(f"{tmp_path}/a/authors")
    got = load_tables(spark, f"{tmp_path}/a", ["authors"])["authors"]
    assert got.schema["id"].dataType.typeName() == "long" and got.first().updated_at is None
    spark.createDataFrame([(1, "A", "B")], "id long, first_name string, last_name string").write.parquet(f"{tmp_path}/d/authors")
    assert load_tables(spark, f"{tmp_path}/d", ["authors"])["authors"].first().asDict() == {
        "id": 1, "first_name": "A", "last_name": "B", "created_at": None, "updated_at": None}
    spark.createDataFrame([(1, "A", "B")], "id long, first_name string, lastname string").write.parquet(f"{tmp_path}/b/authors")
    with pytest.raises(SchemaMismatch, match=r"last_name.*lastname"):
        load_tables(spark, f"{tmp_path}/b", ["authors"])


def test_store_publishes_a_batch_together(spark, lib, tmp_path):
    from shelfspark.operators import commands_circulation as WL
    from shelfspark.sources.fixtures import Library
    from shelfspark.sources.store import Conflict, TableStore
    store = TableStore(spark, str(tmp_path / "store"))
    assert store.load() == (-1, {})
    names = ["books", "loans", "reservations", "readers"]
    assert store.publish({n: lib.table(n) for n in names}, -1) == 0
    version, tables = store.load()
    now = Library(spark, tables=tables)
    result = WL.create_loans(now, lib.loan_commands, dt.date(1998, 6, 15))
    n, n_loans = result.outcomes.where("ok").count(), tables["loans"].count()
    before = {k: tables[k].groupBy("status").count().collect() for k in ("books", "loans", "reservations")}
    # a batch that fails on its last table leaves nothing behind
    bad = tables["reservations"].selectExpr("id", "raise_error('no') AS x")
    with pytest.raises(Exception, match="no"):
        store.publish({**result.tables, "reservations": bad}, version)
    assert store.load()[0] == 0
    assert store.publish(result.tables, version) == 1
    _, after = store.load()
    assert after["loans"].count() == n_loans + n and n > 0
    assert after["readers"].count() == lib.readers.count()  # not part of the batch
    # the version before can still be read; a batch that started from it is refused
    assert {k: v.groupBy("status").count().collect() for k, v in store.load(0)[1].items() if k in before} == before
    with pytest.raises(Conflict):
        store.publish(result.tables, 0)
    assert store.publish({"readers": after["readers"].limit(3)}, 1) == 2
    assert store.versions() == [1, 2]
    assert store.load()[1]["loans"].count() == n_loans + n


def _scratch(spark):
    import os
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:")))


def test_scratch_scope_removes_what_it_wrote(spark, lib):
    from shelfspark.operators.reports import report_popular_books
    from shelfspark.session import scratch_scope
    want = sorted(report_popular_books(lib).collect())
    before = _scratch(spark)
    with scratch_scope(spark) as outer:
        with scratch_scope(spark) as inner:
            ranked = inner.keep(report_popular_books(lib), "popular")
            assert len(_scratch(spark) - before) == 3  # rank input, ranges, what is kept
        assert len(_scratch(spark) - before) == 1
        assert sorted(ranked.collect()) == want
        with pytest.raises(RuntimeError, match="stop"), scratch_scope(spark):
            report_popular_books(lib)
            raise RuntimeError("stop")
        assert len(_scratch(spark) - before) == 1
        outer.clear()
    assert _scratch(spark) == before
    report_popular_books(lib)  # outside of scopes tables stay
    assert len(_scratch(spark) - before) == 2


def test_store_transactions(spark, lib, tmp_path):
    import os

    from shelfspark.operators import commands_circulation as WL
    from shelfspark.operators.batch import CommandResult
    from shelfspark.session import materialize
    from shelfspark.sources.fixtures import Library
    from shelfspark.sources.store import Conflict, TableStore
    store, day = TableStore(spark, str(tmp_path / "store"), keep=10), dt.date(1998, 6, 15)
    assert store.publish({n: lib.table(n) for n in ("books", "loans", "reservations")}, -1) == 0
    base = store.load()[1]
    lend_commands, return_commands = materialize(lib.loan_commands, "lend"), materialize(lib.return_commands, "return")
    lend = lambda t: WL.create_loans(Library(spark, tables=t), lend_commands, day)
    back = lambda t: WL.return_loans(Library(spark, tables=t), return_commands, day)
    before = _scratch(spark)
    assert store.transact(lend, outcomes="lend_outcomes") == 1
    assert store.transact(back, outcomes="return_outcomes") == 2
    assert _scratch(spark) == before
    # as the two jobs one after the other on lazy tables
    first = lend(base)
    second = back({**base, **first.tables})
    _, got = store.load()
    for name, want in {"loans": second.tables["loans"], "books": second.tables["books"], "reservations": first.tables["reservations"],
                       "lend_outcomes": first.outcomes, "return_outcomes": second.outcomes}.items():
        assert sorted(map(str, got[name].select(*want.columns).collect())) == sorted(map(str, want.collect())), name

    # another batch is published while a job runs: the job runs anew on its tables
    seen = []

    def slow(tables):
        seen.append(tables["books"].count())
        if len(seen) == 1:
            store.publish({"books": tables["books"].limit(7)}, 2)
        return CommandResult({"books": tables["books"].limit(5)})

    assert store.transact(slow) == 4
    assert seen == [base["books"].count(), 7] and store.load()[1]["books"].count() == 5

    def never(tables):
        store.publish({"readers": base["books"].limit(1)}, store.load()[0])
        return CommandResult({"books": tables["books"].limit(1)})

    folder = f"{tmp_path}/store/tables/books"
    held = set(os.listdir(folder))
    with pytest.raises(Conflict):
        store.transact(never, attempts=1)
    # a refused batch and a failing one leave no tables behind
    with pytest.raises(Exception, match="no"):
        store.transact(lambda t: CommandResult({"books": t["books"].limit(2), "loans": t["loans"].selectExpr("raise_error('no') AS x")}))
    assert set(os.listdir(folder)) <= held
    assert store.load()[1]["books"].count() == 5
