"""Global ordering without a single-partition window.

``RANK() OVER (ORDER BY ...)`` and ``COUNT(*) OVER ()`` have no partition key,
so Spark plans them as ``Exchange SinglePartition``: every row goes through
one task. The helpers here compute the same values distributed:

* ``global_rank``: distinct sort keys with their multiplicities are
  range-partitioned; each range partition gets a running sum, plus the sum of
  all lower partitions (one row per partition, a proven-small table). The
  rank table (one row per distinct key) is joined back; AQE turns that join
  into a broadcast when the runtime size is small and splits skewed keys
  otherwise.
* ``page``: offset/limit on a total order, with the total as a scalar
  subquery (an aggregate computed once, not a window).
* ``seek_page``: the page behind the last row seen, by comparing keys; no row
  before it is gathered.
* ``PagedTable``: rows stored by ranges of the order with their counts; any page,
  however deep, reads the ranges it lies in.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path


def global_rank(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank",
                dense: bool = False, partitions: int | None = None, unique: bool = False,
                materialize_input: bool = True) -> DataFrame:
    """Add ``out`` = RANK() (or DENSE_RANK()) over ``order``, computed distributed.

    ``keys`` are the columns that ``order`` reads; rows with equal keys tie.
    With ``unique=True`` the keys are unique per row (rank = row number) and
    the rows themselves are range-partitioned: no key grouping, no join back.
    The result column is BIGINT.
    """
    spark = df.sparkSession
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if materialize_input:
        # The input is read more than once (range sampling, ranking, join back): write it
        # once to the shared folder instead of recomputing its whole lineage each time.
        df = materialize(df, "rank-input")
    rows = df if unique else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    weight = F.lit(1).cast("long") if (dense or unique) else F.col("_n")
    # The partition number is assigned once and written: both branches below (per-partition
    # totals, running sums) must see the same assignment, and a re-run range exchange may
    # sample different bounds when its input arrives in a different order.
    ranged = materialize(rows.repartitionByRange(p, *order).withColumn("_part", F.spark_partition_id())
                         .withColumn("_w", weight), "rank-ranged")
    # Sum of weights in all lower partitions: one row per range partition.
    per_part = ranged.groupBy("_part").agg(F.sum("_w").alias("_pw"))
    offsets = per_part.select(
        "_part",
        F.coalesce(F.sum("_pw").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_before", F.coalesce(F.sum("_w").over(within), F.lit(0)))
    ranked = local.join(F.broadcast(offsets), "_part").withColumn(
        out, (F.lit(1) + F.col("_off") + F.col("_before")).cast("long"))
    if unique:
        return ranked.drop("_part", "_w", "_off", "_before")
    ranks = ranked.select(*keys, out)
    return df.join(ranks, on=[df[k].eqNullSafe(ranks[k]) for k in keys]).drop(*[ranks[k] for k in keys])


def page(df: DataFrame, order: list[Column], page_no: int, per_page: int,
         total_col: str = "total_count", pages_col: str | None = "pages") -> DataFrame:
    """Rows of one page in a total order, with the total row count and page count.

    The total is ``COUNT(*)`` over the filtered rows as a scalar subquery; the
    page is a top-(offset+n) per partition merged on the driver side of the
    limit, so no stage holds more than ``offset + n`` rows per partition.
    """
    if page_no < 1:
        raise ValueError("page numbers start at 1")
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = df.orderBy(*order).offset((page_no - 1) * per_page).limit(per_page)
    rows = rows.withColumn(total_col, total)
    if pages_col:
        rows = rows.withColumn(pages_col, F.ceil(F.col(total_col) / F.lit(per_page)).cast("long"))
    return rows


@dataclass(frozen=True)
class SortKey:
    """One column of a total order."""

    name: str
    descending: bool = False
    nulls_first: bool = False

    def column(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()

    def behind(self, value: Any) -> Column:
        """Whether a row's value stands behind ``value``."""
        c = F.col(self.name)
        if value is None:
            return c.isNotNull() if self.nulls_first else F.lit(False)
        further = c < F.lit(value) if self.descending else c > F.lit(value)
        return F.coalesce(further, F.lit(not self.nulls_first))  # NULL: the row's own value is null


def columns_of(keys: list[SortKey]) -> list[Column]:
    return [k.column() for k in keys]


def seek_page(df: DataFrame, keys: list[SortKey], last: dict[str, Any] | None, per_page: int) -> DataFrame:
    """The ``per_page`` rows behind the row whose key values are ``last`` (none: the first page), in the total order of ``keys``.

    A comparison of keys takes the place of the offset: each task holds one page at most, however deep the page is.
    """
    if last is not None:
        behind, same = F.lit(False), F.lit(True)
        for k in keys:
            behind = behind | (same & k.behind(last[k.name]))
            same = same & F.col(k.name).eqNullSafe(F.lit(last[k.name]))
        df = df.where(behind)
    return df.orderBy(*columns_of(keys)).limit(per_page)


class PagedTable:
    """A result stored by ranges of its total order, for reading any page.

    ``ranges`` lists each range's number of rows, in order. A page reads the ranges it lies in and sorts these alone.
    """

    def __init__(self, df: DataFrame, keys: list[SortKey], ranges: int | None = None, path: str | None = None):
        self.spark, self.keys = df.sparkSession, keys
        self.path = path or scratch_path(self.spark, "pages")
        n = ranges or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(n, *columns_of(keys)).withColumn("_range", F.spark_partition_id()) \
            .write.mode("overwrite").partitionBy("_range").parquet(self.path)
        self.stored = self.spark.read.schema(f"{df._jdf.schema().toDDL()}, _range INT").parquet(self.path)
        counts = self.stored.groupBy("_range").count().collect()  # one row a range
        self.ranges = [(r["_range"], r["count"]) for r in sorted(counts, key=lambda r: r["_range"])]
        self.total = sum(n for _, n in self.ranges)

    def located(self, page_no: int, per_page: int) -> tuple[list[int], int]:
        """(ranges that the page lies in, rows before it in the first of them)."""
        first, found, before, skip = (page_no - 1) * per_page, [], 0, 0
        for r, n in self.ranges:
            if before < first + per_page and before + n > first:
                if not found:
                    skip = first - before
                found.append(r)
            before += n
        return found, skip

    def page(self, page_no: int, per_page: int, total_col: str = "total_count", pages_col: str | None = "pages") -> DataFrame:
        """Rows of one page with the total row count and page count, as ``page`` gives them."""
        if page_no < 1:
            raise ValueError("page numbers start at 1")
        found, skip = self.located(page_no, per_page)
        hit = reduce(lambda a, b: a | b, (F.col("_range") == r for r in found), F.lit(False))
        rows = self.stored.where(hit).drop("_range").orderBy(*columns_of(self.keys)).offset(skip).limit(per_page)
        rows = rows.withColumn(total_col, F.lit(self.total).cast("long"))
        return rows.withColumn(pages_col, F.lit(-(-self.total // per_page)).cast("long")) if pages_col else rows
