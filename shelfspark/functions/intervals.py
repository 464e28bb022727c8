"""Interval tests on an equi key plus a date range, without (request, interval) pairs.

A plain equi join on ``book_id`` with a range residual compares every pair
within a book; one hot book would then run through one task. Here intervals are
aggregated by (key, day) first, so a key costs its calendar days, not its rows,
and a sweep in order of days answers the requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A chunk has 2 ** 6 days.
CHUNK_BITS = 6


#: A start day and an id as one number that sorts like the pair, so that aggregates keep it in their hash rows.
_IDS, _DAYS, _FIRST_ID = 1 << 64, 1 << 31, 1 << 63


def _packed(start: Column, number: Column | None) -> Column:
    day = F.unix_date(start) + F.lit(_DAYS).cast("long")
    if number is None:
        return day
    return (day.cast("decimal(10,0)") * F.lit(str(_IDS)).cast("decimal(20,0)") + number.cast("decimal(19,0)") + F.lit(str(_FIRST_ID)).cast("decimal(19,0)")).cast("decimal(38,0)")


def _unpacked(packed: Column, start: str, number: str | None) -> Column:
    if number is None:
        return F.when(packed.isNotNull(), F.struct(F.date_from_unix_date((packed - _DAYS).cast("int")).alias(start)))
    ids = F.lit(str(_IDS)).cast("decimal(20,0)")
    day = F.floor(packed / ids).cast("long")
    rest = packed - (day.cast("decimal(10,0)") * ids).cast("decimal(38,0)") - F.lit(str(_FIRST_ID)).cast("decimal(19,0)")
    return F.when(packed.isNotNull(), F.struct(F.date_from_unix_date((day - _DAYS).cast("int")).alias(start), rest.cast("long").alias(number)))


def earliest_ending_from(requests: DataFrame, intervals: DataFrame, key_q: str, day: str, key_i: str, start: str, end: str,
                         number: str | None, out: str) -> DataFrame:
    """Add ``out``: of the intervals of a request's key that end on ``day`` or later, the one that starts first.

    ``out`` is a struct of ``start`` and the bigint ``number`` (the lowest breaks ties; none: of ``start`` alone), NULL if
    there is none. A closed interval overlaps [day, to] exactly when it ends on ``day`` or later and starts by ``to``, so
    the first starting one tells both whether any overlaps and which is the earliest. One sweep over both sides answers all
    requests: sorted by day, last one first, the answer is the running minimum of the intervals so far. No (request,
    interval) pair is formed. Intervals are combined per (key, end day) first. A key is cut into chunks of days, each
    swept by itself; what later chunks hold comes in as one row at a chunk's head, from a sweep over chunks (a key has as
    many as the calendar).
    """
    best = _packed(F.col(start), F.col(number) if number else None)
    ends = (intervals.where(F.col(key_i).isNotNull() & F.col(start).isNotNull() & F.col(end).isNotNull())
            .groupBy(F.col(key_i).alias("_k"), F.unix_date(end).alias("_day")).agg(F.min(best).alias("_best")))
    kind = ends.schema["_best"].dataType
    chunk = F.shiftright("_day", CHUNK_BITS)
    asked = requests.select(F.col(key_q).alias("_k"), F.unix_date(day).alias("_day"), F.struct(*(F.col(c) for c in requests.columns)).alias("_q"))
    # Chunks that hold intervals, and those that are asked for; what later ones hold.
    chunks = ends.select("_k", chunk.alias("_chunk"), "_best").unionByName(asked.select("_k", chunk.alias("_chunk"), F.lit(None).cast(kind).alias("_best")))
    chunks = chunks.groupBy("_k", "_chunk").agg(F.min("_best").alias("_best"))
    later = F.min("_best").over(Window.partitionBy("_k").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1))
    heads = chunks.select("_k", "_chunk", F.lit(None).cast("int").alias("_day"), later.alias("_best")).where("_best IS NOT NULL")
    # In a chunk: its head, then by day, last one first, intervals before requests.
    rows = heads.withColumn("_order", F.lit(0)) \
        .unionByName(ends.select("_k", chunk.alias("_chunk"), "_day", "_best", F.lit(1).alias("_order"))) \
        .unionByName(asked.select("_k", chunk.alias("_chunk"), "_day", "_q", F.lit(2).alias("_order")), allowMissingColumns=True)
    so_far = Window.partitionBy("_k", "_chunk").orderBy(F.desc_nulls_first("_day"), "_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = rows.withColumn("_found", F.min("_best").over(so_far)).where("_order = 2")
    return swept.select("_q.*", _unpacked(F.when(F.col("_day").isNotNull(), F.col("_found")), start, number).alias(out))


def overlap_groups(intervals: DataFrame, key: str, start: str, end: str, out: str) -> DataFrame:
    """(key, start, out): the number, within its key, of the run of overlapping intervals that those starting on ``start`` are in.

    A run ends where the greatest end so far is before the next start. Intervals are combined per (key, start day)
    first, so the sweep has as many rows a key as the calendar has days, however long the intervals are.
    """
    days = intervals.groupBy(key, start).agg(F.max(end).alias("_to"))
    w = Window.partitionBy(key).orderBy(start)
    days = days.withColumn("_before", F.max("_to").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    begins = (F.col("_before").isNull() | (F.col(start) > F.col("_before"))).cast("long")
    return days.select(key, start, F.sum(begins).over(w).alias(out))


def covered(points: DataFrame, intervals: DataFrame, key_p: str, day: str, key_i: str, start: str, end: str) -> DataFrame:
    """Rows of ``points`` whose ``day`` lies in an interval of the same key: the first starting one that ends no earlier starts by it."""
    out = "_cover"
    found = earliest_ending_from(points, intervals, key_p, day, key_i, start, end, None, out)
    return found.where(F.col(f"{out}.{start}") <= F.col(day)).drop(out)
