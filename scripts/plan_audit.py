"""Audit the plans that ran for the registered queries, eager jobs included.

Runs every query on stored tables with broadcast joins switched off, as on data
that is too large for them, and reads the plans from Spark's event log (in a
scratch folder). For each query prints the jobs, shuffles, sort-merge and
broadcast joins, and each ``Exchange SinglePartition`` by the operator it feeds,
so a single-task stage over unbounded data stands out. Global aggregates (one
partial row per task) and top-k/limit merges are bounded and expected.
Usage: python scripts/plan_audit.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import json
import re
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, ".")
from shelfspark.plans.registry import LIB_QUERIES, load_all  # noqa: E402
from shelfspark.session import local_session, scratch_path  # noqa: E402
from shelfspark.sources.fixtures import Library  # noqa: E402


def walk(node: dict, parent: str, found: Counter) -> None:
    name = re.sub(r" \(\d+\)", "", node["nodeName"])
    if name == "Exchange":
        kind = "single" if "SinglePartition" in node["simpleString"] else "shuffles"
        found[kind] += 1
        if kind == "single":
            found[f"  one task: {parent}"] += 1
    elif name in ("SortMergeJoin", "BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct"):
        found[name] += 1
    if not re.match("WholeStageCodegen|InputAdapter|AQEShuffleRead|ShuffleQueryStage|AdaptiveSparkPlan|ResultQueryStage", name):
        parent = name
    for child in node["children"]:
        walk(child, parent, found)


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    pats = sys.argv[2:]
    log = tempfile.mkdtemp(prefix="plan-audit-")
    spark = local_session(8, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{log}", "spark.eventLog.compress": "false",
        "spark.eventLog.rolling.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    load_all()
    lib = Library(spark, sf).materialize_tables(scratch_path(spark, "plan-audit"))
    ran = []
    for name, fn in LIB_QUERIES.items():
        if not pats or any(p in name for p in pats):
            began = time.time()
            fn(lib).write.format("noop").mode("overwrite").save()
            ran.append((name, began * 1000, time.time() * 1000))
    spark.stop()
    plans, starts = {}, {}
    for path in Path(log).iterdir():
        for line in path.open(errors="replace"):
            if '"sparkPlanInfo"' in line:
                e = json.loads(line)
                plans[e["executionId"]] = e["sparkPlanInfo"]  # the last is the one that ran
                starts.setdefault(e["executionId"], e.get("time"))
    for name, began, ended in ran:
        own = [i for i, t in starts.items() if t and began <= t <= ended]
        found: Counter = Counter()
        for i in own:
            walk(plans[i], "result", found)
        print(f"{name:36s} jobs={len(own):3d} shuffles={found['shuffles']:3d} smj={found['SortMergeJoin']:3d} bhj={found['BroadcastHashJoin']:2d} "
              f"nested={found['BroadcastNestedLoopJoin'] + found['CartesianProduct']} single={found['single']} "
              + "; ".join(f"{k.strip()} x{v}" for k, v in sorted(found.items()) if k.startswith("  one task")))


if __name__ == "__main__":
    main()
