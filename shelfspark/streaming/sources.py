"""Streaming sources over the driver's event and part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """``readStream`` over ``<name>*.parquet`` with the schema of the existing file (never inferred per batch)."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{sf_dir}/{name}*.parquet")


def circulation_events(events: DataFrame) -> DataFrame:
    """Same projection as the batch ``circulation_events`` view, usable on a stream."""
    action = (F.when(F.col("event_type") == "click", "reserve").when(F.col("event_type") == "purchase", "borrow")
              .when(F.col("event_type") == "view", "return").when(F.col("event_type") == "error", "cancel")
              .otherwise("register"))
    return events.select("event_id", "ts", (F.col("user_id") + 100000).alias("reader_id"),
                         (F.col("user_id") - F.col("user_id") % 3).alias("book_id"), action.alias("action"))


def utc_event_time(ts_col: str = "ts") -> F.Column:
    """TIMESTAMP (instant) for a wall-clock TIMESTAMP_NTZ read as UTC, independent of the session zone."""
    c = F.col(ts_col)
    return F.make_timestamp_ltz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                                F.date_part(F.lit("SECOND"), c), F.lit("UTC"))
