"""Report and snapshot writers (distributed writes, no driver-side rendering)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_TS = "yyyy-MM-dd'T'HH:mm:ss"
REPORT_TS = "yyyy-MM-dd HH:mm:ss"
DAY = "yyyy-MM-dd"


def _format_temporal(df: DataFrame, ts_fmt: str, date_fmt: str) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_format(f.name, ts_fmt).alias(f.name))
        elif isinstance(f.dataType, T.DateType):
            cols.append(F.date_format(f.name, date_fmt).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def _ordered(df: DataFrame, order: list | None) -> DataFrame:
    """The report's presentation order as a distributed range sort (part files follow it)."""
    return df.orderBy(*order) if order else df


def write_report_json(df: DataFrame, path: str, mode: str = "overwrite", order: list | None = None) -> None:
    """JSON rows; timestamps ISO (``YYYY-MM-DDTHH:MM:SS``), dates ``YYYY-MM-DD``, NULL kept."""
    _format_temporal(_ordered(df, order), ISO_TS, DAY).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_report_csv(df: DataFrame, path: str, header_map: dict[str, str], null_label: str | None = None,
                     mode: str = "overwrite", order: list | None = None) -> None:
    """CSV with renamed header, dates as ``YYYY-MM-DD``; NULL dates as ``null_label`` when given."""
    df = _ordered(df, order)
    out = []
    for src, name in header_map.items():
        f = df.schema[src]
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.date_format(src, DAY)
            if null_label is not None:
                c = F.coalesce(c, F.lit(null_label))
        else:
            c = F.col(src)
        out.append(c.alias(name))
    df.select(*out).write.mode(mode).option("header", True).csv(path)


def write_period_report(df: DataFrame, report_type: str, start: dt.date, end: dt.date, path: str,
                        order: list | None = None) -> None:
    """Period report tagged with type and range, one partition folder per run.

    Datetimes ``YYYY-MM-DD HH:MM:SS``, dates ``YYYY-MM-DD``; an empty result
    still leaves a header-only file. A run writes its own folder anew, so the
    same run twice leaves one copy and other runs stay.
    """
    body = _format_temporal(_ordered(df, order), REPORT_TS, DAY)
    folder = f"{path}/report_type={report_type}/period_start={start.isoformat()}/period_end={end.isoformat()}"
    rows = Observation("period-report")
    body.observe(rows, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(folder)
    if not rows.get["n"]:
        body.limit(0).coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def _text(field: T.StructField) -> Column:
    """A column's value in one fixed text form, NULL as ``\\N``."""
    stamp = isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType))
    c = F.date_format(field.name, REPORT_TS) if stamp else F.col(field.name).cast("string")
    return F.coalesce(c, F.lit("\\N"))


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """One row: table name, row count and an order-insensitive content hash.

    The hash is the sum, over the rows, of the first 32 bits of the MD5 of the
    row's values joined by ``|``, so any engine can recompute it.
    """
    row = F.concat_ws("|", *[_text(f) for f in df.schema.fields])
    h = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("decimal(20,0)")
    return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("decimal(38,0)").cast("string").alias("content_hash"))


def export_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str,
                    stamp: dt.datetime | None = None) -> DataFrame:
    """Write every table under ``<path>/<timestamp>/<table>`` and a manifest written last.

    The manifest (table, rows, content_hash) is computed from the written
    files, so it describes what is on storage; readers trust a snapshot only
    once its manifest exists.
    """
    ts = (stamp or dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    root = f"{path.rstrip('/')}/{ts}"
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        fp = table_fingerprint(spark.read.parquet(f"{root}/{name}"), name)
        manifest = fp if manifest is None else manifest.unionByName(fp)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/_manifest")
    return spark.read.parquet(f"{root}/_manifest")
