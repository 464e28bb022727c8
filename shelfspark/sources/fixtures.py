"""Library tables derived from the driver's TPC-H-ish tables.

The driver ships ``region nation customer supplier part orders lineitem
events ...`` parquet files. The circulation tables (authors, books, readers,
loans, ...) and the command batches are derived from them by fixed rules, so
every query's work grows with the driver tables. Each view is a lazy
DataFrame; nothing is collected.

The rules are fixed values shared with the SQL oracle (``plans/oracle.py``):
the same ids, dates and status vocabularies must come out of both.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ("nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _date_plus(base: Column, days: Column) -> Column:
    return F.date_add(base, days.cast("int"))


class Library:
    """All circulation tables and command batches over one data folder.

    Attribute access builds the view on first use and then returns the same
    DataFrame object, so views that share inputs share plan fragments
    (and Spark can reuse their exchanges within one query).
    """

    def __init__(self, spark: SparkSession, sf_dir: str | None = None,
                 tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        # Stored circulation tables and command batches are used as they are; other names are driver tables.
        given = dict(tables or {})
        self.__dict__.update({n: df for n, df in given.items() if n in STORED_TABLES})
        self._given = {n: df for n, df in given.items() if n not in STORED_TABLES}

    # -- driver tables -----------------------------------------------------
    def raw(self, name: str) -> DataFrame:
        if name not in self._given:
            self._given[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._given[name]

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def override(self, **tables: DataFrame) -> "Library":
        """A library where some circulation tables are replaced (e.g. after a command batch)."""
        lib = Library(self.spark, self.sf_dir, self._given)
        for k in ("authors", "publishers", "users", "readers", "_loan_base", "loans", "reservations",
                  "books", "reader_registration_requests"):
            if k in self.__dict__:
                lib.__dict__[k] = self.__dict__[k]
        lib.__dict__.update(tables)
        return lib

    def materialize_tables(self, path: str, names: list[str] | None = None) -> "Library":
        """Write the circulation tables and command batches once under ``path``; return a
        library that reads them back (the stored-table setup the queries run on in production)."""
        from concurrent.futures import ThreadPoolExecutor

        names = set(names or STORED_TABLES)
        lib = Library(self.spark, self.sf_dir, self._given)
        # Waves by dependency: each later table derives from stored earlier ones. Tables of
        # one wave are independent Spark jobs and run concurrently.
        later = {"loans", "reservations", "books", "loan_commands", "return_commands", "cancel_commands"}
        waves = [["_loan_base"] + sorted(names - later), ["loans", "reservations"],
                 ["books", "loan_commands", "return_commands", "cancel_commands"]]

        def store(n: str):
            df = lib.table(n)
            df.write.mode("overwrite").parquet(f"{path}/{n}")
            return n, self.spark.read.parquet(f"{path}/{n}")

        with ThreadPoolExecutor(max_workers=4) as pool:
            for wave in waves:
                todo = [n for n in wave if n == "_loan_base" or n in names
                        or (n in ("loans", "reservations") and names & later)]
                for n, df in pool.map(store, todo):
                    lib.__dict__[n] = df
        return lib

    # -- circulation tables -------------------------------------------------
    @cached_property
    def authors(self) -> DataFrame:
        s = self.raw("supplier")
        return s.select(F.col("s_suppkey").alias("id"),
                        F.split_part("s_name", F.lit("#"), F.lit(1)).alias("first_name"),
                        F.split_part("s_name", F.lit("#"), F.lit(2)).alias("last_name"))

    @cached_property
    def publishers(self) -> DataFrame:
        n = self.raw("nation")
        return n.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))

    @cached_property
    def users(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return c.select(k.alias("id"), F.col("c_name").alias("username"),
                        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
                        F.when(k % 50 == 0, "worker").otherwise("user").alias("role"),
                        (F.col("c_acctbal") >= 0).alias("is_active"),
                        _date_plus(F.lit("1995-01-01").cast("date"), k * 37 % 2000).alias("created_at"))

    @cached_property
    def readers(self) -> DataFrame:
        c = self.raw("customer")
        k = F.col("c_custkey")
        return (c.where(k % 5 != 4)
                .select((k + 100000).alias("id"), k.alias("user_id"),
                        F.concat(F.lit("R"), (k % 17).cast("string")).alias("first_name"),
                        F.col("c_name").alias("last_name"),
                        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
                        F.col("c_mktsegment").alias("address"),
                        F.lit(None).cast("string").alias("card_number"),
                        F.concat(F.lit("555-"), F.lpad(k.cast("string"), 7, "0")).alias("phone_number"),
                        _date_plus(F.lit("1995-01-01").cast("date"), k * 53 % 2400).alias("registration_date")))

    @cached_property
    def _loan_base(self) -> DataFrame:
        # One loan per (order, line); the test lineitem repeats that pair, so group it.
        # The return flag is a one-character code: max over its code point equals max over
        # the string and keeps the aggregate hash-based (a string max forces a sort aggregate).
        li = (self.raw("lineitem").groupBy("l_orderkey", "l_linenumber")
              .agg(F.min("l_partkey").alias("book_id"), F.min("l_shipdate").alias("loan_date"),
                   F.max(F.ascii("l_returnflag")).alias("flag")))
        o = self.raw("orders").where(F.col("o_custkey") % 5 != 4)
        j = li.join(o, li.l_orderkey == o.o_orderkey)
        lid = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        # Never NULL, so that a filter on it falls apart and the part on the key goes below the aggregate.
        borrowed = F.coalesce(F.col("flag") == ord("N"), F.lit(False)) & F.coalesce(F.col("l_orderkey") % 20 == 0, F.lit(False))
        return j.select(lid.alias("id"), "book_id", (F.col("o_custkey") + 100000).alias("reader_id"),
                        "loan_date", borrowed.alias("_borrowed"), F.col("o_orderdate"))

    @cached_property
    def loans(self) -> DataFrame:
        b = self._loan_base
        return b.select("id", "book_id", "reader_id", "loan_date",
                        F.when(F.col("_borrowed"), F.lit(None).cast("date"))
                        .otherwise(_date_plus(F.to_date("loan_date"), 1 + F.col("id") % 40)).alias("return_date"),
                        F.when(F.col("_borrowed"), "borrowed").otherwise("returned").alias("status"))

    @cached_property
    def reservations(self) -> DataFrame:
        b = self._loan_base
        i = F.col("id")
        status = (F.when(F.col("_borrowed") & (i % 5 != 0), "completed")
                  .when(i % 4 == 0, "pending").when(i % 4 == 1, "cancelled").otherwise("completed"))
        return b.select("id", "book_id", "reader_id", F.col("o_orderdate").alias("created_at"),
                        F.to_date("loan_date").alias("start_date"),
                        _date_plus(F.to_date("loan_date"), 1 + i % 21).alias("end_date"),
                        status.alias("status"))

    @cached_property
    def books(self) -> DataFrame:
        p = self.raw("part")
        k = F.col("p_partkey")
        on_loan = self.loans.where(F.col("status") == "borrowed").select(F.col("book_id").alias("_bid")).distinct()
        j = p.join(on_loan, k == F.col("_bid"), "left")
        return j.select(k.alias("id"), F.col("p_name").alias("title"), (k % 10).alias("author_id"),
                        F.concat(F.lit("978"), F.lpad(k.cast("string"), 10, "0")).alias("isbn"),
                        F.when(F.col("p_size") % 7 == 0, F.lit(None).cast("long"))
                        .otherwise((F.col("p_size") % 25).cast("long")).alias("publisher_id"),
                        (F.lit(1950) + F.col("p_size")).alias("publication_year"),
                        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("p_type")).alias("genre"),
                        F.col("p_brand").alias("description"),
                        F.when(F.col("_bid").isNull(), "available").otherwise("borrowed").alias("status"))

    @cached_property
    def reader_registration_requests(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "signup")
        i = F.col("event_id")
        return e.select(i.alias("id"), "user_id", F.col("ts").alias("created_at"),
                        F.when(i % 3 == 0, "pending").when(i % 3 == 1, "approved").otherwise("rejected").alias("status"),
                        F.when(i % 3 == 0, F.lit(None).cast("timestamp_ntz"))
                        .otherwise(F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("processed_at"),
                        F.when(i % 3 == 2, F.col("props")).otherwise(F.lit(None).cast("string")).alias("rejection_reason"),
                        F.concat(F.lit("F"), F.col("user_id").cast("string")).alias("first_name"),
                        F.concat(F.lit("L"), F.col("user_id").cast("string")).alias("last_name"),
                        F.col("props").alias("address"),
                        F.concat(F.lit("557-"), i.cast("string")).alias("phone_number"))

    # -- command batches ----------------------------------------------------
    @cached_property
    def reservation_commands(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "click")
        i = F.col("event_id")
        d = F.to_date("ts")
        return e.select(i.alias("cmd_id"), F.col("ts").alias("submitted_at"), "user_id",
                        (i % 211).alias("book_id"),
                        _date_plus(d, i % 6 - 1).alias("start_date"),
                        _date_plus(d, i % 6 - 1 + i % 14 - 1).alias("end_date"))

    @cached_property
    def loan_commands(self) -> DataFrame:
        r = self.reservations
        return r.where(F.col("id") % 3 == 0).select(F.col("id").alias("cmd_id"), "book_id", "reader_id",
                                                    F.col("created_at").alias("submitted_at"))

    @staticmethod
    def _repeated(cmds: DataFrame, every: int) -> DataFrame:
        """Some commands come a second time, under another id."""
        again = cmds.where(F.col("cmd_id") % every == 0).withColumn("cmd_id", F.col("cmd_id") + 1_000_000_000_000)
        return cmds.unionByName(again)

    @cached_property
    def return_commands(self) -> DataFrame:
        return self._repeated(self.loans.where(F.col("id") % 7 == 0).select(
            F.col("id").alias("cmd_id"), F.col("loan_date").alias("submitted_at"), F.col("id").alias("loan_id")), 14)

    @cached_property
    def circulation_events(self) -> DataFrame:
        e = self.raw("events")
        action = (F.when(F.col("event_type") == "click", "reserve").when(F.col("event_type") == "purchase", "borrow")
                  .when(F.col("event_type") == "view", "return").when(F.col("event_type") == "error", "cancel")
                  .otherwise("register"))
        return e.select("event_id", "ts", (F.col("user_id") + 100000).alias("reader_id"),
                        (F.col("user_id") - F.col("user_id") % 3).alias("book_id"), action.alias("action"))

    @cached_property
    def book_commands(self) -> DataFrame:
        p = self.raw("part").where(F.col("p_partkey") % 5 == 0)
        k, size = F.col("p_partkey"), F.col("p_size")
        return p.select(
            k.alias("cmd_id"), F.lit("2001-08-15 08:00:00").cast("timestamp_ntz").alias("submitted_at"),
            F.concat("p_name", F.lit(" II")).alias("title"),
            F.when(k % 3 == 0, "New").otherwise("Supplier").alias("author_first_name"),
            F.lpad((k % 12).cast("string"), 9, "0").alias("author_last_name"),
            F.when(k % 4 == 0, F.concat(F.lit("PUBLISHER_"), size.cast("string")))
            .otherwise(F.concat(F.lit("NATION_"), (size % 25).cast("string"))).alias("publisher"),
            F.concat(F.when(k % 11 == 0, "978").otherwise("979"), F.lpad(k.cast("string"), 10, "0")).alias("isbn"),
            F.when(k % 17 == 0, F.lit(999)).otherwise(F.lit(1950) + size).alias("publication_year"),
            F.col("p_type").alias("genre"), (k + size - 25).alias("book_id"))

    @cached_property
    def request_commands(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "view")
        u = F.col("user_id").cast("string")
        return e.select(F.col("event_id").alias("cmd_id"), F.col("ts").alias("submitted_at"), "user_id",
                        F.concat(F.lit("F"), u).alias("first_name"), F.concat(F.lit("L"), u).alias("last_name"),
                        F.col("props").alias("address"), F.concat(F.lit("556-"), u).alias("phone_number"))

    @cached_property
    def decision_commands(self) -> DataFrame:
        e = self.raw("events")
        i = F.col("event_id")
        return e.select(i.alias("cmd_id"), F.col("ts").alias("submitted_at"), (i - i % 2).alias("request_id"),
                        F.col("user_id").alias("processor_id"),
                        F.when(F.col("value") < 20, "approve").otherwise("reject").alias("decision"),
                        F.col("props").alias("reason"))

    @cached_property
    def cancel_commands(self) -> DataFrame:
        return self._repeated(self.reservations.where(F.col("id") % 9 == 0).select(
            F.col("id").alias("cmd_id"), F.col("created_at").alias("submitted_at"), F.col("id").alias("reservation_id")), 18)

    @cached_property
    def role_commands(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "error")
        i = F.col("event_id")
        return e.select(i.alias("cmd_id"), F.col("ts").alias("submitted_at"), "user_id",
                        F.when(i % 3 == 0, "worker").when(i % 3 == 1, "user").otherwise("admin").alias("role"))

    @cached_property
    def delete_commands(self) -> DataFrame:
        e = self.raw("events").where((F.col("event_type") == "click") & (F.col("event_id") % 2 == 0))
        return e.select(F.col("event_id").alias("cmd_id"), F.col("ts").alias("submitted_at"), "user_id")

    @cached_property
    def register_commands(self) -> DataFrame:
        e = self.raw("events").where(F.col("event_type") == "signup")
        i = F.col("event_id")
        email = F.concat(F.when(i % 10 == 0, F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")))
                         .otherwise(F.concat(F.lit("m"), (i % 900).cast("string"))), F.lit("@example.com"))
        return e.select(i.alias("cmd_id"), F.col("ts").alias("submitted_at"),
                        F.when(i % 97 != 0, F.concat(F.lit("new"), (i % 700).cast("string"))).alias("username"), email.alias("email"))

    @cached_property
    def availability_requests(self) -> DataFrame:
        o = self.raw("orders")
        k = F.col("o_orderkey")
        d = F.to_date("o_orderdate")
        return o.select(k.alias("req_id"), F.col("o_orderdate").alias("submitted_at"),
                        F.col("o_custkey").alias("user_id"), (k % 211).alias("book_id"),
                        _date_plus(d, k % 6 - 1).alias("start_date"),
                        _date_plus(d, k % 6 + k % 14 - 2).alias("end_date"))


# -- change streams (fixed rules; usable on a stream) ---------------------------
def loan_changes(events: DataFrame) -> DataFrame:
    """A 'borrow' event inserts a borrowed loan; every third one is returned, every fifth one deleted afterwards."""
    i, reader = F.col("event_id"), F.col("reader_id")
    none = F.lit(None).cast("long")
    row = lambda old, was, new, now: F.struct(old.alias("old_reader_id"), F.lit(was).cast("string").alias("old_status"),
                                              new.alias("new_reader_id"), F.lit(now).cast("string").alias("new_status"))
    gone = F.struct(reader.alias("old_reader_id"), F.when(i % 3 == 0, "returned").otherwise("borrowed").alias("old_status"),
                    none.alias("new_reader_id"), F.lit(None).cast("string").alias("new_status"))
    rows = F.array_compact(F.array(row(none, None, reader, "borrowed"), F.when(i % 3 == 0, row(reader, "borrowed", reader, "returned")),
                                   F.when(i % 5 == 0, gone)))
    return events.where(F.col("action") == "borrow").select(F.inline(rows))


def reader_changes(events: DataFrame) -> DataFrame:
    """A 'register' event rewrites its reader (or inserts it); every seventh one deletes it."""
    i = F.col("event_id")
    s = i.cast("string")
    return events.where(F.col("action") == "register").select(
        F.col("reader_id").alias("id"), "ts", i.alias("change_id"), (i % 7 == 0).alias("deleted"), F.concat(F.lit("S"), s).alias("first_name"),
        F.lit("Changed").alias("last_name"), F.concat(F.lit("s"), s, F.lit("@example.com")).alias("email"), F.concat(F.lit("u"), s).alias("username"))


def book_changes(parts: DataFrame) -> DataFrame:
    """Each part inserts a book; every sixth one changes its genre, every second one is deleted afterwards."""
    k = F.col("p_partkey")
    genre = F.when(k % 13 != 0, F.col("p_type"))
    revised = F.concat(F.lit("REVISED "), F.col("p_brand"))
    none = F.lit(None).cast("string")
    row = lambda inserted, old, new: F.struct(F.lit(inserted).alias("inserted"), old.alias("old_genre"), new.alias("new_genre"))
    rows = F.array_compact(F.array(row(True, none, genre), F.when(k % 6 == 0, row(False, genre, revised)),
                                   F.when(k % 2 == 0, row(False, F.when(k % 6 == 0, revised).otherwise(genre), none))))
    return parts.select(F.inline(rows))


# Columns of the circulation views (fixed; checked against the DataFrames in tests).
FIXTURE_COLUMNS: dict[str, list[str]] = {
    "authors": ["id", "first_name", "last_name"],
    "publishers": ["id", "name"],
    "users": ["id", "username", "email", "role", "is_active", "created_at"],
    "readers": ["id", "user_id", "first_name", "last_name", "email", "address", "card_number", "phone_number",
                "registration_date"],
    "loans": ["id", "book_id", "reader_id", "loan_date", "return_date", "status"],
    "reservations": ["id", "book_id", "reader_id", "created_at", "start_date", "end_date", "status"],
    "books": ["id", "title", "author_id", "isbn", "publisher_id", "publication_year", "genre", "description",
              "status"],
    "reader_registration_requests": ["id", "user_id", "created_at", "status", "processed_at", "rejection_reason",
                                     "first_name", "last_name", "address", "phone_number"],
}
CIRCULATION_TABLES = list(FIXTURE_COLUMNS)
COMMAND_TABLES = ["reservation_commands", "loan_commands", "return_commands", "circulation_events", "book_commands",
                  "request_commands", "decision_commands", "cancel_commands", "role_commands", "delete_commands",
                  "register_commands", "availability_requests"]
STORED_TABLES = CIRCULATION_TABLES + COMMAND_TABLES


def library(spark: SparkSession, sf_dir: str) -> Library:
    return Library(spark, sf_dir)
