"""Every registered query against its SQL oracle in DuckDB on the small driver tables."""

import datetime as dt
import decimal

import duckdb
import pytest

import __spark_entry__ as E
from settings import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
ORACLE = E.oracle_sql()


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}"
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "popularity_rank" in df.columns


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols = df.columns
    rows = df.collect()
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(cols) == sorted(ocols)
    assert len(rows) == len(orows)
    order = sorted(cols)
    a = sorted(tuple(_norm(r[cols.index(c)]) for c in order) for r in rows)
    b = sorted(tuple(_norm(r[ocols.index(c)]) for c in order) for r in orows)
    assert a == b


def test_every_query_has_callable():
    qs = E.queries()
    assert set(ORACLE) <= set(qs)
    assert len(qs) >= 60
