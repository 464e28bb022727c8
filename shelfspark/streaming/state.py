"""Keyed state for rules that follow from the order of a key's events.

``OrderedFold`` keeps, for each key, what the rule carries at the watermark and
the events beyond it. A micro-batch merges its events into those by (time, id),
decides them from the carried value on, and returns the new decisions and those
that an earlier arrival has changed. Events that the watermark has passed are folded
into the carried value, by the next rows of the key or by an event-time timer, so a
key's state is bounded by the events of one watermark delay, not by its history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package

#: What a rule carries before a key's first event.
NOTHING = np.iinfo(np.int64).min
DECISIONS = "event_id long, key long, kind int, accepted boolean"
_ROW = np.dtype([("us", "<i8"), ("event_id", "<i8"), ("kind", "<i4"), ("accepted", "<i4")])
_HEAD = np.dtype([("carry", "<i8"), ("timer", "<i8")])
_UNDECIDED, _NO_TIMER = -1, -1


class Alternation:
    """An event is accepted when the one before had another kind; the first compares with kind 0."""

    def decide(self, carry: int, us: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(accepted, value carried behind each event) of events in order."""
        before = np.concatenate(([0 if carry == NOTHING else carry], kind[:-1]))
        return kind != before, kind.astype(np.int64)


class Spacing:
    """An event of kind 1 is accepted unless an accepted one is younger than ``gap_us`` and no event of kind 0 came between."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def decide(self, carry: int, us: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        accepted, after = np.zeros(len(us), bool), np.empty(len(us), np.int64)
        until = carry
        for i, (t, k) in enumerate(zip(us.tolist(), kind.tolist(), strict=True)):
            if k == 0:
                until = NOTHING
            elif t >= until:
                accepted[i], until = True, t + self.gap_us
            after[i] = until
        return accepted, after


class OrderedFold(StatefulProcessor):
    def __init__(self, rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "head binary, events binary")

    def _load(self) -> tuple[int, int, np.ndarray]:
        if not self.state.exists():
            return NOTHING, _NO_TIMER, np.zeros(0, _ROW)
        head, events = self.state.get()
        carry, timer = np.frombuffer(bytes(head), _HEAD)[0].tolist()
        return carry, timer, np.frombuffer(bytes(events), _ROW)

    def _store(self, carry: int, timer: int, events: np.ndarray, after: np.ndarray, timers) -> None:
        """Folds what the watermark has passed into the carried value and keeps the rest, with a timer for its end."""
        watermark = timers.getCurrentWatermarkInMs()
        passed = int(np.searchsorted(events["us"], watermark * 1000, "right"))
        if passed:
            carry, events = int(after[passed - 1]), events[passed:]
        if timer <= watermark:
            timer = _NO_TIMER
        if len(events) and timer == _NO_TIMER:
            timer = int(events["us"][-1]) // 1000 + 1
            self.handle.registerTimer(timer)
        self.state.update((np.array([(carry, timer)], _HEAD).tobytes(), events.tobytes()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        carry, timer, held = self._load()
        fresh = np.zeros(len(new), _ROW)
        for c in ("us", "event_id", "kind"):
            fresh[c] = new[c].to_numpy()
        fresh["accepted"] = _UNDECIDED
        events = np.concatenate([held, fresh])
        events = events[np.lexsort((events["event_id"], events["us"]))]
        accepted, after = self.rule.decide(carry, events["us"], events["kind"])
        told = events["accepted"] != accepted
        events["accepted"] = accepted
        self._store(carry, timer, events, after, timerValues)
        yield pd.DataFrame({"event_id": events["event_id"][told], "key": np.full(int(told.sum()), int(key[0])), "kind": events["kind"][told],
                            "accepted": accepted[told]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        carry, _, events = self._load()
        self._store(carry, _NO_TIMER, events, self.rule.decide(carry, events["us"], events["kind"])[1], timerValues)
        yield from ()

    def close(self) -> None:
        pass


def use_rocksdb(spark) -> None:
    """Keyed state with timers needs the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def decide_in_order(events: DataFrame, rule) -> DataFrame:
    """Stream of decisions (event_id, key, kind, accepted) on a stream of events (key, event_id, kind, event_time with a watermark).

    A decision comes again when an event that arrived later, but not behind the watermark, comes before it and changes it.
    Events without a time take no part.
    """
    ship_package(events.sparkSession)
    use_rocksdb(events.sparkSession)
    none = F.lit(NOTHING)  # events without a key are those of one key
    rows = events.where(F.col("event_time").isNotNull()).select(
        F.coalesce(F.col("key").cast("long"), none).alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("kind").cast("int").alias("kind"),
        F.unix_micros("event_time").alias("us"), "event_time")
    out = rows.groupBy("key").transformWithStateInPandas(OrderedFold(rule), DECISIONS, "Update", "EventTime")
    return out.withColumn("key", F.nullif(F.col("key"), none))
