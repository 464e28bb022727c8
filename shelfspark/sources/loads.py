"""Table loads, insert-if-absent and natural-key resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import SCHEMAS


class SchemaMismatch(ValueError):
    """A stored table does not fit its declaration."""


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project a DataFrame onto the declared schema of ``name``: cast, NULL for absent columns that may be NULL.

    An absent NOT NULL column, and a column that is not declared (a misspelt one, say), is an error.
    """
    schema = SCHEMAS[name]
    absent = [f.name for f in schema.fields if not f.nullable and f.name not in df.columns]
    unknown = [c for c in df.columns if c not in schema.fieldNames()]
    if absent or unknown:
        told = [f"lacks the NOT NULL columns {absent}"] if absent else []
        told += [f"has the undeclared columns {unknown}"] if unknown else []
        raise SchemaMismatch(f"table {name} {' and '.join(told)}")
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def load_tables(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Read ``<path>/<table>`` for each circulation table with its declared schema.

    The declaration is the reader's schema, so files that lack a nullable column give NULL there. Columns stored in
    another type than declared are cast.
    """
    out = {}
    for n in names or list(SCHEMAS):
        stored = spark.read.parquet(f"{path}/{n}")
        whole = conform(stored, n)
        types = {f.name: f.dataType for f in stored.schema.fields}
        as_declared = all(types.get(f.name, f.dataType) == f.dataType for f in SCHEMAS[n].fields)
        out[n] = spark.read.schema(SCHEMAS[n]).parquet(f"{path}/{n}") if as_declared else whole
    return out


def insert_if_absent(target: DataFrame, new: DataFrame, key: str | list[str],
                     order: list[str] | None = None) -> DataFrame:
    """``INSERT ... ON CONFLICT (key) DO NOTHING`` for a batch.

    Rows of ``new`` whose key exists in ``target`` are skipped; among new rows
    sharing a key the first in ``order`` is kept (an arbitrary one without
    ``order``). The first-per-key pick is a partial min aggregate, so a hot
    key combines map-side.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if order:
        picked = new.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in new.columns if c not in keys + order]))
                                        .alias("_r"))
        new = picked.select(*keys, "_r.*").select(*new.columns)
    else:
        new = new.dropDuplicates(keys)
    fresh = new.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def resolve_keys(facts: DataFrame, dim: DataFrame, natural: dict[str, str], surrogate: str,
                 out: str) -> DataFrame:
    """S3: look up ``dim.surrogate`` by natural key; a missing parent gives NULL, the row stays.

    ``natural`` maps fact columns to dim columns. The dim side is reduced to
    one row per natural key first, so the lookup cannot fan facts out.
    """
    d = dim.groupBy(*[F.col(v).alias(f"_k_{k}") for k, v in natural.items()]).agg(
        F.min(surrogate).alias(out))
    cond = None
    for k in natural:
        e = F.col(k) == F.col(f"_k_{k}")
        cond = e if cond is None else cond & e
    return facts.join(d, cond, "left").drop(*[f"_k_{k}" for k in natural])
