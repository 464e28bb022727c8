"""Run a streaming query over everything available, and tables that micro-batches keep fresh."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..session import scratch_path
from ..sources.files import list_names, publish_text, read_text, remove


def run_available(writer: DataStreamWriter, spark: SparkSession, name: str, checkpoint: str | None = None) -> None:
    """Start with ``availableNow``, wait for the end, surface failures. A given ``checkpoint`` is resumed."""
    q = writer.option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream {name} failed: {q.exception()}")


class KeyedTable:
    """A table of one row per key, kept fresh by micro-batches at a cost that follows their changes.

    ``merge`` turns any number of rows per key into one and must not depend on
    how they are grouped (sums, maxima); it never drops a key, so what a key
    has become is told by its row. An epoch's changes are merged and written as
    a run. Runs are folded together when the older ones are no more than
    ``growth`` times as large as what follows them, so there are about log(rows)
    runs at any time and a row is rewritten about log(rows) times in all. Reading
    merges the runs.

    The list of runs is published as one small file, written last: a reader sees a
    whole version, and an epoch that is published already is not applied again,
    so a job restarted with the same ``base`` and checkpoint goes on from
    storage. Runs and lists that the last two versions do not name are removed.
    """

    def __init__(self, spark: SparkSession, name: str, key: list[str], merge: Callable[[DataFrame], DataFrame],
                 initial: DataFrame | None = None, base: str | None = None, growth: int = 3):
        self.spark, self.key, self.merge, self.growth = spark, key, merge, growth
        self.base = base or scratch_path(spark, name)
        #: (epoch, rows of its changes, rows read to fold them) of the epochs applied by this object.
        self.work: list[tuple[int, int, int]] = []
        if initial is not None and self.published() is None:
            self._publish(-1, [self._write(merge(initial))])

    def published(self) -> dict | None:
        """The newest version: its epoch and runs."""
        names = [n for n in list_names(self.spark, f"{self.base}/published") if n.endswith(".json")]
        return json.loads(read_text(self.spark, f"{self.base}/published/{max(names)}")) if names else None

    def _write(self, rows: DataFrame) -> dict:
        seen = Observation()
        run = f"run-{uuid.uuid4().hex[:12]}"
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.base}/{run}")
        return {"run": run, "rows": int(seen.get["n"])}

    def _publish(self, epoch: int, runs: list[dict], before: dict | None = None) -> None:
        version = before["version"] + 1 if before else 0
        text = json.dumps({"version": version, "epoch": epoch, "runs": runs})
        publish_text(self.spark, f"{self.base}/published/{version:012d}.json", text)
        # The version before may still be read; older ones go.
        named = {r["run"] for r in [*runs, *(before["runs"] if before else [])]}
        for n in list_names(self.spark, self.base):
            if n.startswith("run-") and n not in named:
                remove(self.spark, f"{self.base}/{n}")
        for n in list_names(self.spark, f"{self.base}/published"):
            if n.endswith(".json") and int(n[:12]) < version - 1:
                remove(self.spark, f"{self.base}/published/{n}")

    def apply(self, changes: DataFrame, epoch: int) -> None:
        before = self.published()
        if before and epoch <= before["epoch"]:
            # A replayed epoch: nothing to add, but stateful operators before it commit their state as the rows are read.
            changes.write.format("noop").mode("overwrite").save()
            return
        new = self._write(self.merge(changes))
        runs, folded = [*(before["runs"] if before else []), new], 0
        total, first = new["rows"], len(runs) - 1
        while first and runs[first - 1]["rows"] <= self.growth * total:
            first -= 1
            total += runs[first]["rows"]
        if first < len(runs) - 1:
            folded = total
            runs = [*runs[:first], self._write(self.merge(self._read(runs[first:])))]
        self.work.append((epoch, new["rows"], folded))
        self._publish(epoch, runs, before)

    def _read(self, runs: list[dict]) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.base}/{r['run']}") for r in runs]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def current(self) -> DataFrame | None:
        """The table as of the newest version; None before the first."""
        now = self.published()
        if now is None:
            return None
        rows = self._read(now["runs"])
        return rows if len(now["runs"]) == 1 else self.merge(rows)


def newest(key: str) -> Callable[[DataFrame], DataFrame]:
    """Merge rule: of each key's rows the one with the greatest ``version``."""
    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (key, "version")]
        return rows.groupBy(key).agg(F.max(F.struct("version", *rest)).alias("_r")).select(key, "_r.*")
    return merge
