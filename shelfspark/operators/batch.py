"""Shared pieces of the set-based command jobs.

A command batch behaves as if its commands ran one by one in
``(submitted_at, cmd_id)`` order. Jobs return new DataFrames for the changed
tables plus an ``outcomes`` DataFrame; nothing is updated in place (parquet
has no UPDATE), and the caller publishes the new snapshot.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import lit_ntz
from ..functions.ordering import global_rank

CMD_ORDER = ("submitted_at", "cmd_id")


@dataclass
class CommandResult:
    """New table snapshots (only the changed ones) and one outcome row per command."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    outcomes: DataFrame | None = None


def order_key(prefix: str = "") -> Column:
    """Batch order as one comparable struct."""
    return F.struct(*[F.col(prefix + c) for c in CMD_ORDER])


def merge_rows(base: DataFrame, changed: DataFrame, key: str | list[str], now: dt.datetime | Column) -> DataFrame:
    """Replace rows of ``base`` by ``changed`` on ``key`` and stamp ``updated_at`` on them only.

    Columns that ``changed`` does not name keep their value. ``changed`` may
    hold new keys (inserts), whose unnamed columns are NULL; ``updated_at`` is
    added to ``base`` when absent. Both sides hold a key at most once.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if "updated_at" not in base.columns:
        base = base.withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    ch = changed.withColumn("updated_at", now if isinstance(now, Column) else lit_ntz(now))
    named = [c for c in base.columns if c in ch.columns and c not in keys]
    ch = ch.select(*keys, F.lit(True).alias("_changed"), *[F.col(c).cast(base.schema[c].dataType).alias(f"_new_{c}") for c in named])
    both = base.join(ch, keys, "full_outer")
    return both.select(*[F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in named else F.col(c)
                         for c in base.columns])


def new_ids(df: DataFrame, order: list[str], base_table: DataFrame, out: str = "new_id",
            id_col: str = "id") -> DataFrame:
    """Surrogate ids for new rows: ``max(base.id) + position in order`` (order must be unique).

    The position is a distributed rank (no single-partition window); the max
    is a scalar subquery.
    """
    start = base_table.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
    ranked = global_rank(df, order, [F.col(c).asc_nulls_first() for c in order], out="_pos", unique=True,
                         materialize_input=False)
    return ranked.withColumn(out, start + F.col("_pos")).drop("_pos")


def new_ids_together(parts: dict[str, tuple[DataFrame, list[str], DataFrame]], id_col: str = "id") -> dict[str, DataFrame]:
    """Surrogate ids for the new rows of several tables from one rank: ``{name: (keys of the new rows, order, table)}``.

    Gives per name the key columns with ``id`` = ``max(table.id) + position in order``. The keys of all parts are ranked
    together, part by part; a part's first position is one number.
    """
    rows, order = None, []
    for k, (keys, cols, _) in enumerate(parts.values()):
        own = keys.select(F.lit(k).alias("_part_no"), *(F.col(c).alias(f"_{k}_{c}") for c in cols))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
        order += [f"_{k}_{c}" for c in cols]
    every = ["_part_no", *order]
    ranked = checkpoint(global_rank(rows, every, [F.col(c).asc_nulls_first() for c in every], out="_pos", unique=True, materialize_input=False), "new-ids")
    before = {r["_part_no"]: r["first"] - 1 for r in ranked.groupBy("_part_no").agg(F.min("_pos").alias("first")).collect()}  # a row a part
    out = {}
    for k, (name, (_, cols, table)) in enumerate(parts.items()):
        start = table.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long")).scalar()
        own = ranked.where(F.col("_part_no") == k)
        out[name] = own.select(*(F.col(f"_{k}_{c}").alias(c) for c in cols), (start + F.col("_pos") - F.lit(before.get(k, 0))).cast("long").alias("id"))
    return out


def first_per_key(df: DataFrame, key: str | list[str], order: list[str] = list(CMD_ORDER),
                  out: str = "_first") -> DataFrame:
    """Flag the first row per key in batch order, via a partial min aggregate joined back.

    A hot key combines map-side to one row per task; no window streams its group.
    """
    keys = [key] if isinstance(key, str) else list(key)
    firsts = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_min"))
    j = df.join(firsts, keys)
    return j.withColumn(out, F.struct(*order) == F.col("_min")).drop("_min")


def last_per_key(df: DataFrame, key: str | list[str], order: list[str] = list(CMD_ORDER),
                 out: str = "_last") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    lasts = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("_max"))
    return df.join(lasts, keys).withColumn(out, F.struct(*order) == F.col("_max")).drop("_max")


def outcome(ok: Column, reason: Column) -> list[Column]:
    return [ok.alias("ok"), F.when(~ok, reason).alias("reason")]


def first_failure(*checks: tuple[Column, str]) -> Column:
    """Reason of the first failing check (each check is (passes, reason)), NULL when all pass."""
    expr = None
    for passes, reason in reversed(checks):
        expr = F.when(~F.coalesce(passes, F.lit(False)), F.lit(reason)).otherwise(
            expr if expr is not None else F.lit(None).cast("string"))
    return expr


def checkpoint(df: DataFrame, name: str = "round") -> DataFrame:
    """Cut lineage: a written table in the shared checkpoint folder (survives executor loss)."""
    from ..session import materialize
    return materialize(df, name)
