"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Setup mirrors the reference, whose queries run on stored tables: the
circulation tables are derived from the driver tables once and written to the
shared checkpoint folder (timed as ``load_library_tables``). The headline
queries then run on the stored tables, each written to the ``noop`` sink
(full execution, no output cost). ``p4_popular_books_with_views`` times the
flagship query from the raw driver tables, view building included, for the
BASELINE comparison. ``value`` is the sum of every timed entry.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "p4_popular_books", "p1_active_loans", "p2_overdue_loans", "p3_reader_activity", "l1_loans_page",
    "l2_reader_loans", "l5_loanable_reservations", "c1_catalog_search", "r7_user_details",
    "v5_check_availability", "v6_conflict_dates", "w3_add_books", "w8_create_reservations", "w11_create_loans",
    "w12_return_loans", "m1_reader_summary", "m5_stream_book_status",
]


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")  # shuffle partitions default to the core count
    from shelfspark.plans.registry import LIB_QUERIES, QUERIES, load_all
    from shelfspark.session import local_session, scratch_path
    from shelfspark.sources.fixtures import Library

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus))),
                          app="shelfspark-bench")
    load_all()
    names = [n for n in HEADLINE if n in LIB_QUERIES]
    only = os.environ.get("BENCH_ONLY")
    if only:
        names = [n for n in names if any(p in n for p in only.split(","))]
    _run(QUERIES["p4_popular_books"](spark, sf_dir))  # warm-up (JVM, codegen)
    times: dict[str, float] = {}
    t0 = time.perf_counter()
    _run(QUERIES["p4_popular_books"](spark, sf_dir))
    times["p4_popular_books_with_views"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    lib = Library(spark, sf_dir).materialize_tables(scratch_path(spark, "library"))
    times["load_library_tables"] = round(time.perf_counter() - t0, 3)
    for n in names:
        t0 = time.perf_counter()
        _run(LIB_QUERIES[n](lib))
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
