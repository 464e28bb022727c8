"""Lists come in a total order: rows with equal sort keys are equal."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import catalog, loans, readers, reports, reservations, views
from shelfspark.operators.presentation import LIST_ORDERS, list_order, presented

AS_OF = {"active_loans": dt.date(2001, 8, 15), "loan_history": dt.date(2001, 8, 15), "loanable_reservations": dt.date(1998, 6, 15),
         "loanable_by_reader": dt.date(1998, 6, 15), "report_active_loans": dt.date(2001, 8, 15), "report_overdue_loans": dt.date(2001, 8, 15)}


def _result(lib, name):
    fn = next(getattr(m, name) for m in (catalog, loans, readers, reports, reservations, views) if hasattr(m, name))
    if name.startswith("report_period"):
        return fn(lib, "month", dt.date(1998, 6, 15))
    return fn(lib, AS_OF[name]) if name in AS_OF else fn(lib)


@pytest.mark.parametrize("name", LIST_ORDERS)
def test_equal_keys_are_equal_rows(lib, name):
    df = _result(lib, name)
    keys = [k.lstrip("-") for k in LIST_ORDERS[name]]
    row = F.struct(*df.columns)
    assert df.groupBy(*keys).agg(F.min(row).alias("a"), F.max(row).alias("b")).where("a <> b").count() == 0


def test_presented_newest_first(spark):
    rows = [(1, dt.date(2024, 1, 1), None), (2, None, None), (3, dt.date(2024, 2, 1), dt.date(2024, 3, 1)), (3, dt.date(2024, 2, 1), None)]
    df = spark.createDataFrame(rows, "id long, loan_date date, due_date date")
    assert [(r.id, r.due_date) for r in presented(df, "active_loans").collect()] == [(2, None), (3, dt.date(2024, 3, 1)), (3, None), (1, None)]
    assert len(list_order("active_loans")) == 3
