"""Rules that run one command after the other, as streams over groups that do not touch each other.

Commands that share a key (a username, an isbn) must be decided in batch order;
those without any common key, direct or through others, need not wait for each
other. Groups are the connected components of the commands' keys. Each
group's rows stream through one task in batch order; what is carried from row to
row is the group's own keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.components import connected_components
from ..session import ship_package
from .batch import checkpoint


def with_groups(rows: DataFrame, left: str, right: str) -> DataFrame:
    """``rows`` with ``_g``: the component of the graph whose edges join a row's ``left`` and ``right`` keys.

    Keys are known by hash; two that share one by chance only make a group larger. A null key joins nothing.
    """
    rows = rows.withColumn("_a", F.xxhash64(F.lit("left"), left)) \
        .withColumn("_b", F.when(F.col(right).isNull(), F.xxhash64(F.lit("left"), left)).otherwise(F.xxhash64(F.lit("right"), right)))
    roots = connected_components(rows.select(F.col("_a").alias("a"), F.col("_b").alias("b")))
    return rows.join(roots, F.col("_a") == F.col("node"), "left").withColumn("_g", F.coalesce("root", "_a")).drop("_a", "_b", "node", "root")


def _sign_ups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group's sign-ups in order those whose username and email are both free."""
    group, names, mails = None, set(), set()
    for b in batches:
        accepted = []
        for i, (g, u, e) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_g", "username", "email")), strict=True)):
            if g != group:
                group, names, mails = g, set(), set()
            if u not in names and e not in mails:
                names.add(u)
                mails.add(e)
                accepted.append(i)
        yield b.select(["cmd_id", "submitted_at"]).take(pa.array(accepted, pa.int64()))


def accept_sign_ups(cmds: DataFrame) -> DataFrame:
    """(cmd_id, submitted_at) of the accepted ones of sign-ups (cmd_id, submitted_at, username, email), as if one by one.

    Of those with the same username and email only the first can be accepted, so it alone goes on; where neither is asked
    for again it is accepted at once.
    """
    ship_package(cmds.sparkSession)
    first = checkpoint(cmds.groupBy("username", "email").agg(F.min(F.struct("submitted_at", "cmd_id")).alias("_o")).select("username", "email", "_o.*"), "sign-ups")
    again = lambda c: first.groupBy(c).count().where("count > 1").select(c)
    shared = checkpoint(first.join(again("username"), "username", "left_semi").unionByName(first.join(again("email"), "email", "left_semi")).distinct(), "sign-ups-shared")
    alone = first.join(shared.select("cmd_id"), "cmd_id", "left_anti").select("cmd_id", "submitted_at")
    ordered = with_groups(shared, "username", "email").repartition("_g").sortWithinPartitions("_g", "submitted_at", "cmd_id")
    return alone.unionByName(ordered.mapInArrow(_sign_ups, T.StructType([first.schema["cmd_id"], first.schema["submitted_at"]])))


def _claims(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each group the held isbns, then its claims in order: whether a claim finds its isbn free. An accepted one frees what its book held."""
    group, holder, held = None, {}, {}
    for b in batches:
        ids, accepted = [], []
        for i, (g, claim, book, isbn) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_g", "_claim", "book_id", "isbn")), strict=True)):
            if g != group:
                group, holder, held = g, {}, {}
            free = not claim or isbn is None or holder.get(isbn, book) == book
            if claim:
                ids.append(i)
                accepted.append(free)
            if free:
                before = held.pop(book, None)
                if before is not None and holder.get(before) == book:
                    del holder[before]
                if isbn is not None:
                    holder[isbn], held[book] = book, isbn
        rows = b.select(["cmd_id"]).take(pa.array(ids, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(accepted, pa.bool_())], names=["cmd_id", "accepted"])


def decide_isbn_claims(stored: DataFrame, claims: DataFrame) -> DataFrame:
    """(cmd_id, accepted) of ``claims`` (cmd_id, o, book_id, isbn): whether each, in the order of ``o``, finds its isbn free.

    ``stored`` (book_id, isbn) is what books hold before. A claim is refused while another book holds the isbn; an accepted
    command frees the isbn its book held. An isbn that only one book holds or claims is never refused, so commands on
    books without any other isbn are accepted at once; the rest is run through by groups of books and isbns.
    """
    ship_package(claims.sparkSession)
    stored = stored.where(F.col("isbn").isNotNull())
    pairs = stored.unionByName(claims.where(F.col("isbn").isNotNull()).select("book_id", "isbn"))
    contended = pairs.groupBy("isbn").agg(F.min("book_id").alias("_first"), F.max("book_id").alias("_last")).where("_first <> _last").select("isbn")
    involved = checkpoint(pairs.join(contended, "isbn", "left_semi").select("book_id").distinct(), "isbn-books")
    rows = stored.select(F.lit(False).alias("_claim"), "book_id", "isbn").unionByName(
        claims.select(F.lit(True).alias("_claim"), "book_id", "isbn", "cmd_id", "o"), allowMissingColumns=True).join(involved, "book_id", "left_semi")
    ordered = with_groups(checkpoint(rows, "isbn-claims"), "book_id", "isbn").repartition("_g").sortWithinPartitions("_g", "_claim", "o")
    decided = ordered.mapInArrow(_claims, T.StructType([claims.schema["cmd_id"], T.StructField("accepted", T.BooleanType())]))
    return decided.unionByName(claims.join(involved, "book_id", "left_anti").select("cmd_id", F.lit(True).alias("accepted")))
