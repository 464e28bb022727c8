"""Every declared constraint as a distributed check, in two scans a table at most.

Rules come from the DDL metadata in ``sources/schema.py``: NOT NULL, UNIQUE
(including the primary key), FOREIGN KEY, the publication-year CHECK and
VARCHAR lengths. Columns a table does not carry are skipped.

The first scan makes of each row the rules it breaks, its unique keys, the parents
it names and itself as a parent; one aggregate over all of it counts equal keys
and finds names without a parent. Only what breaks a rule is written. The second
scan, of tables with foreign keys, finds the rows that name those parents.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date
from ..sources.schema import FOREIGN_KEYS, SCHEMAS, UNIQUE_KEYS, VARCHAR_LIMITS
from .batch import checkpoint

OUT_COLS = ["table_name", "rule", "column_name", "row_key", "detail"]


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _fact(table: str, rule: str, column: str, key: list[Column], row: Column, detail: Column, parent: bool = False) -> Column:
    return F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), F.array(*key).alias("key"),
                    row.cast("string").alias("row_key"), detail.cast("string").alias("detail"), F.lit(parent).alias("parent"))


def _facts(tables: dict[str, DataFrame], table: str, year: int) -> list[Column]:
    """What a row of ``table`` has to say: broken rules, unique keys, parents it names, the parent it is; NULL where nothing."""
    has, none, own = set(tables[table].columns), F.lit(None), _text("id")
    out = []
    for f in SCHEMAS[table].fields:
        if not f.nullable and f.name in has:
            out.append(F.when(F.col(f.name).isNull(), _fact(table, "not_null", f.name, [own], F.col("id"), none)))
    for (t, c), n in VARCHAR_LIMITS.items():
        if t == table and c in has:
            out.append(F.when(F.length(c) > n, _fact(table, "varchar_length", c, [own], F.col("id"), F.length(c))))
    if table == "books" and "publication_year" in has:
        y = F.col("publication_year")
        out.append(F.when((y < 1000) | (y > year), _fact(table, "check_publication_year", "publication_year", [own], F.col("id"), y)))
    for key in UNIQUE_KEYS.get(table, []):
        if set(key) <= has:  # a row with a NULL in any key column never conflicts
            whole = F.lit(True)
            for k in key:
                whole = whole & F.col(k).isNotNull()
            out.append(F.when(whole, _fact(table, "unique", ",".join(key), [_text(k) for k in key], F.concat_ws("|", *(_text(k) for k in key)), none)))
    for child, c, parent in FOREIGN_KEYS:
        if child in tables and parent in tables and c in tables[child].columns:
            if child == table:
                out.append(F.when(F.col(c).isNotNull(), _fact(child, "foreign_key", c, [_text(c)], none, none)))
            if parent == table:
                out.append(F.when(F.col("id").isNotNull(), _fact(child, "foreign_key", c, [own], none, none, True)))
    return out


def broken(tables: dict[str, DataFrame], as_of: dt.date | str) -> DataFrame:
    """Rows that break a rule by themselves, keys held twice, and names without a parent, from one scan of each table."""
    year, parts = as_date(as_of).year, []
    for t in SCHEMAS:
        if t in tables:
            parts.append(tables[t].select(F.inline(F.array_compact(F.array(*_facts(tables, t, year))))))
    facts = parts[0]
    for p in parts[1:]:
        facts = facts.unionByName(p)
    seen = facts.groupBy("table_name", "rule", "column_name", "key", "row_key", "detail").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("parent"))
    twice, orphan = (F.col("rule") == "unique") & (F.col("n") > 1), (F.col("rule") == "foreign_key") & ~F.col("parent")
    return seen.where(~F.col("rule").isin("unique", "foreign_key") | twice | orphan)


def audit_constraints(tables: dict[str, DataFrame], as_of: dt.date | str) -> DataFrame:
    """Violations ``(table_name, rule, column_name, row_key, detail)`` of all declared constraints."""
    found = checkpoint(broken(tables, as_of), "audit")
    # Equal broken rows (a repeated id) are told each.
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("rule") == "unique", 1).otherwise(F.col("n")).cast("int")))
    out = found.where("rule <> 'foreign_key'").select("*", times).select(
        "table_name", "rule", "column_name", "row_key", F.when(F.col("rule") == "unique", _text("n")).otherwise(F.col("detail")).alias("detail"))
    names = []
    for t in SCHEMAS:
        keys = [c for child, c, parent in FOREIGN_KEYS if child == t and t in tables and parent in tables and c in tables[t].columns]
        if keys:
            named = F.array(*(F.struct(F.lit(c).alias("column_name"), _text(c).alias("detail")) for c in keys))
            names.append(tables[t].select(F.lit(t).alias("table_name"), _text("id").alias("row_key"), F.inline(named)))
    if not names:
        return out
    rows = names[0]
    for x in names[1:]:
        rows = rows.unionByName(x)
    missing = found.where("rule = 'foreign_key'").select("table_name", "column_name", F.element_at("key", 1).alias("detail"))
    orphans = rows.join(missing, ["table_name", "column_name", "detail"], "left_semi").withColumn("rule", F.lit("foreign_key"))
    return out.unionByName(orphans.select(*OUT_COLS))


def audit_sql(table_columns: dict[str, list[str]], as_of: dt.date | str) -> str:
    """The same rules as SQL text over views named like the tables (the oracle of ``audit_constraints``)."""
    y = as_date(as_of).year
    q: list[str] = []

    def sel(t, rule, col, key, detail, where, frm=None):
        q.append(f"SELECT '{t}' AS table_name, '{rule}' AS rule, '{col}' AS column_name, CAST({key} AS VARCHAR) AS row_key, "
                 f"CAST({detail} AS VARCHAR) AS detail FROM {frm or t} WHERE {where}")

    for t, schema in SCHEMAS.items():
        if t not in table_columns:
            continue
        cols = set(table_columns[t])
        for f in schema.fields:
            if not f.nullable and f.name in cols:
                sel(t, "not_null", f.name, "id", "NULL", f"{f.name} IS NULL")
        for key in UNIQUE_KEYS.get(t, []):
            if set(key) <= cols:
                k = ", ".join(key)
                nn = " AND ".join(f"{c} IS NOT NULL" for c in key)
                kexpr = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in key)
                q.append(f"SELECT '{t}' AS table_name, 'unique' AS rule, '{','.join(key)}' AS column_name, "
                         f"{kexpr} AS row_key, CAST(count(*) AS VARCHAR) AS detail FROM {t} WHERE {nn} "
                         f"GROUP BY {k} HAVING count(*) > 1")
        for (k, c), n in VARCHAR_LIMITS.items():
            if k == t and c in cols:
                sel(t, "varchar_length", c, "id", f"length({c})", f"length({c}) > {n}")
        if t == "books" and "publication_year" in cols:
            sel(t, "check_publication_year", "publication_year", "id", "publication_year",
                f"publication_year < 1000 OR publication_year > {y}")
    for child, col, parent in FOREIGN_KEYS:
        if child in table_columns and parent in table_columns and col in table_columns[child]:
            sel(child, "foreign_key", col, "c.id", f"c.{col}",
                f"c.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{col})", f"{child} c")
    return "\nUNION ALL\n".join(q)
