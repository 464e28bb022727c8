"""Get-or-create authors and publishers, add and update books."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date
from ..sources.fixtures import Library
from .batch import CommandResult, checkpoint, first_failure, first_per_key, last_per_key, merge_rows, new_ids, new_ids_together, order_key
from .ordered import decide_isbn_claims


def upsert_names(table: DataFrame, names: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """W1/W2 generic get-or-create on natural key ``cols``.

    Returns (new table, mapping of ``cols`` -> ``id``). New ids follow
    ``max(id)`` in the order of the key columns.
    """
    # Every key column is NOT NULL, so a name with a missing part is neither found nor created.
    wanted = names.select(*cols).dropna(how="any").distinct()
    existing = table.select("id", *cols)
    fresh = new_ids(wanted.join(existing, cols, "left_anti"), cols, table, out="id")
    new_table = table.unionByName(fresh.select("id", *cols), allowMissingColumns=True)
    mapping = existing.join(wanted, cols, "left_semi").unionByName(fresh.select("id", *cols))
    return new_table, mapping


def _missing(table: DataFrame, names: DataFrame, cols: list[str]) -> DataFrame:
    """The names that the table does not hold, once each."""
    return names.select(*cols).dropna(how="any").distinct().join(table.select(*cols), cols, "left_anti")


def upsert_authors(lib: Library, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``names(first_name, last_name)`` -> (authors, mapping to author id)."""
    return upsert_names(lib.authors, names, ["first_name", "last_name"])


def upsert_publishers(lib: Library, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``names(name)`` -> (publishers, mapping to publisher id)."""
    return upsert_names(lib.publishers, names, ["name"])


def _year_ok(as_of: dt.date | str):
    y = as_date(as_of).year
    # A CHECK constraint passes on NULL.
    return F.col("publication_year").isNull() | F.col("publication_year").between(1000, y)


def add_books(lib: Library, cmds: DataFrame, as_of: dt.date | str) -> CommandResult:
    """Insert books as 'available'; reject bad years and duplicate isbns (table or earlier in batch).

    Authors and publishers are created only for accepted books (the reference
    rolls the whole command back on failure).
    """
    taken = lib.books.where(F.col("isbn").isNotNull()).select(F.col("isbn").alias("_ti")).distinct()
    cmds = cmds.drop("book_id")  # only update commands target an existing book
    c = cmds.join(taken, cmds.isbn == taken._ti, "left").withColumn(
        "_pre", first_failure((_year_ok(as_of), "Invalid publication year"),
                              (F.col("_ti").isNull(), "Duplicate isbn"))).drop("_ti")
    valid = first_per_key(c.where(F.col("_pre").isNull() & F.col("isbn").isNotNull()), "isbn")
    c = c.join(valid.select("cmd_id", "_first"), "cmd_id", "left").withColumn(
        "reason", F.coalesce("_pre", F.when(F.col("_first") == F.lit(False), F.lit("Duplicate isbn"))))
    # Every later branch (authors, publishers, ids, outcomes) reads the decisions: write them once.
    c = checkpoint(c, "add-books-decisions")
    acc = c.where(F.col("reason").isNull())
    names = acc.select(F.col("author_first_name").alias("first_name"), F.col("author_last_name").alias("last_name"))
    person = ["first_name", "last_name"]
    new = new_ids_together({"authors": (_missing(lib.authors, names, person), person, lib.authors),
                            "publishers": (_missing(lib.publishers, acc.select(F.col("publisher").alias("name")), ["name"]), ["name"], lib.publishers),
                            "books": (acc, ["submitted_at", "cmd_id"], lib.books)})
    authors = lib.authors.unionByName(new["authors"], allowMissingColumns=True)
    publishers = lib.publishers.unionByName(new["publishers"], allowMissingColumns=True)
    amap, pmap = authors.select("id", *person), publishers.select("id", "name")
    acc = acc.join(new["books"].select("cmd_id", F.col("id").alias("book_id_new")), "cmd_id")
    acc = (acc.join(amap.select(F.col("id").alias("author_id"), F.col("first_name").alias("author_first_name"),
                                F.col("last_name").alias("author_last_name")),
                    ["author_first_name", "author_last_name"], "left")
           .join(pmap.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher")), "publisher", "left"))
    rows = acc.select(F.col("book_id_new").alias("id"), "title", "author_id", "isbn", "publisher_id",
                      "publication_year", "genre", F.lit("available").alias("status"),
                      F.lit(None).cast("string").alias("description"))
    books = lib.books.unionByName(rows, allowMissingColumns=True)
    outcomes = c.join(acc.select("cmd_id", F.col("book_id_new").alias("book_id"), "author_id", "publisher_id"),
                      "cmd_id", "left").select(
        "cmd_id", F.col("reason").isNull().alias("ok"), "reason", "book_id", "author_id", "publisher_id")
    return CommandResult({"books": books, "authors": authors, "publishers": publishers}, outcomes)


def update_books(lib: Library, cmds: DataFrame, as_of: dt.date | str) -> CommandResult:
    """Overwrite title, author, isbn, year, genre, description of existing books, as if one by one in batch order.

    Reasons in order: 'Book not found', 'Invalid publication year',
    'Duplicate isbn' (held by another book at that point of the batch; an
    accepted command frees its book's former isbn). The publisher is untouched.
    When one book gets several accepted commands the last one wins.
    """
    b = lib.books.select(F.col("id").alias("_bid"))
    c = checkpoint(cmds.join(b, cmds.book_id == b._bid, "left")
                   .withColumn("_pre", first_failure((F.col("_bid").isNotNull(), "Book not found"),
                                                     (_year_ok(as_of), "Invalid publication year"))).drop("_bid"), "update-books-checks")
    claims = c.where(F.col("_pre").isNull()).select("cmd_id", order_key().alias("o"), "book_id", "isbn")
    held = lib.books.select(F.col("id").alias("book_id"), "isbn")
    c = c.join(decide_isbn_claims(held, claims), "cmd_id", "left").withColumn(
        "reason", F.coalesce("_pre", F.when(~F.col("accepted"), F.lit("Duplicate isbn")))).drop("accepted")
    c = checkpoint(c, "update-books-decisions")
    acc = c.where(F.col("reason").isNull())
    authors, amap = upsert_authors(lib, acc.select(F.col("author_first_name").alias("first_name"),
                                                   F.col("author_last_name").alias("last_name")))
    win = last_per_key(acc, "book_id").where("_last")
    upd = (win.join(amap.select(F.col("id").alias("author_id"), F.col("first_name").alias("author_first_name"),
                                F.col("last_name").alias("author_last_name")),
                    ["author_first_name", "author_last_name"], "left"))
    changed = upd.select(
        F.col("book_id").alias("id"), "title", "author_id", "isbn", "publication_year", "genre", F.coalesce(F.col("description") if "description" in upd.columns else F.lit(None).cast("string"),
                             F.lit("")).alias("description"))
    books = merge_rows(lib.books, changed, "id", dt.datetime.combine(as_date(as_of), dt.time()))
    outcomes = c.select("cmd_id", F.col("reason").isNull().alias("ok"), "reason")
    return CommandResult({"books": books, "authors": authors}, outcomes)
