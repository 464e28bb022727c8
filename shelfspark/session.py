"""Session helpers.

Library code never creates a session; callers pass one in. These helpers are
for tests, the bench and command-line use, and for reading cluster settings
(checkpoint folder) from whatever session is running.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # M7's and M4's state is kept on disk, not in the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "shelfspark", extra: dict | None = None) -> SparkSession:
    b = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("SHELF_DRIVER_MEMORY", "16g")))
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names.

    ``spark.checkpoint.dir`` is read from the session, else a folder set by
    ``setCheckpointDir`` is used. Only on one machine (a ``local`` master) a
    temporary folder stands in; a cluster that names no shared folder is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d and not fallback and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not d:
        import tempfile
        d = fallback or tempfile.mkdtemp(prefix="shelfspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for written intermediate tables."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.paths.append(path)
    return path


class Scratch:
    """The written intermediate tables of a ``scratch_scope``, innermost first when scopes are nested."""

    def __init__(self, spark: SparkSession, outer: Scratch | None):
        self.spark, self.outer, self.paths = spark, outer, []

    def keep(self, df: DataFrame, name: str = "kept") -> DataFrame:
        """``df`` written to where the end of this scope does not reach (an outer scope's end does), and read back."""
        token = _SCOPE.set(self.outer)
        try:
            return materialize(df, name)
        finally:
            _SCOPE.reset(token)

    def clear(self) -> None:
        from .sources.files import remove
        while self.paths:
            remove(self.spark, self.paths[-1])
            self.paths.pop()


_SCOPE: ContextVar[Scratch | None] = ContextVar("scratch_scope", default=None)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scratch]:
    """Intermediate tables that the library writes in the block are removed at its end, also if it fails.

    What is computed from them must be written inside the block, by a sink or by ``keep``. Streams started in the
    block lose tables and checkpoints for which they were given no place of their own. Threads started in the block
    are not part of it.
    """
    scope = Scratch(spark, _SCOPE.get())
    token = _SCOPE.set(scope)
    try:
        yield scope
    finally:
        _SCOPE.reset(token)
        scope.clear()


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    One computation (a reliable ``checkpoint()`` computes an uncached input
    twice), lineage is cut, and the files survive executor loss.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``shelfspark`` importable in Python workers (``--py-files`` at runtime).

    Python UDF and stateful-processor workers import the package by name; a
    zip of it is added once per SparkContext and distributed by Spark.
    """
    import shutil
    import tempfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="shelfspark-pyfiles-")
    zpath = shutil.make_archive(os.path.join(out, "shelfspark"), "zip", os.path.dirname(pkg), "shelfspark")
    sc.addPyFile(zpath)
    # Executors put added py-files on their path; the driver-side Python runner that
    # initializes stateful processors does not, so point PYTHONPATH at the driver's copy.
    from pyspark import SparkFiles
    local = SparkFiles.get("shelfspark.zip")
    prev = sc.environment.get("PYTHONPATH")
    sc.environment["PYTHONPATH"] = local if not prev else local + os.pathsep + prev
    _SHIPPED.add(key)
