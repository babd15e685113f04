"""Debounced changes and each file's entities in one keyed state, with timers, a start from a snapshot, and statistics read from its checkpoint."""

from __future__ import annotations

import contextlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .changes import next_state

#: The state store that several state variables and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "path string, ts timestamp, change_type string, events bigint, entities_added bigint, entities_removed bigint, entities_modified bigint"
_OUT = ["path", "ts", "change_type", "events", "entities_added", "entities_removed", "entities_modified"]


def runs_of(rows: list[tuple], gap: int) -> list[list[tuple]]:
    """rows (time, ...) in order, cut where the next is gap or more later."""
    out: list[list[tuple]] = []
    for r in sorted(rows):
        if out and r[0] - out[-1][-1][0] < gap:
            out[-1].append(r)
        else:
            out.append([r])
    return out


class FileState(StatefulProcessor):
    """Of each path: the entities that are known, and the changes whose run hasn't ended.

    A timer stands where the first run ends; when the watermark has passed it,
    the run's last change is given out with what it adds, removes and modifies.
    A change of the snapshot's file starts from its entities. A path that is
    deleted, and has no change waiting, keeps no state.
    """

    def __init__(self, gap_ms: int):
        self.gap = gap_ms * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "entities bigint")
        self.waiting = handle.getValueState("waiting", "changes array<struct<at:bigint,change_type:string,entities:bigint>>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.known.update((int(initialState["entities"].iloc[0]),))

    def _held(self) -> list[tuple]:
        held = self.waiting.get() if self.waiting.exists() else None
        return [tuple(x) for x in held[0]] if held else []

    def _settle(self, key, rows: list[tuple], watermark_ms: int):
        """Gives out the runs that have ended, and sets the timer of the next."""
        done, left = [], []
        for run in runs_of(rows, self.gap):
            (done if run[-1][0] + self.gap <= watermark_ms * 1000 and not left else left).append(run)
        known = self.known.get()[0] if self.known.exists() else None
        out = []
        for run in done:
            at, change, n = run[-1]
            known, counts = next_state(known, change, n)
            out.append((key[0], pd.Timestamp(at, unit="us"), change, len(run), *counts))
        if done:
            self.known.clear() if known is None else self.known.update((known,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.waiting.update(([x for run in left for x in run],))
            # a timer fires when the watermark is past it
            self.handle.registerTimer((left[0][-1][0] + self.gap + 999) // 1000)
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=_OUT)

    def handleInputRows(self, key, rows, timerValues):
        held = self._held()
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            held += list(zip(at.tolist(), frame["change_type"].tolist(), frame["entities"].astype("int64").tolist()))
        yield from self._settle(key, held, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._settle(key, self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()))


def keyed_updates(changes: DataFrame, gap_ms: int = 500, watermark: str = "0 seconds", snapshot: DataFrame | None = None) -> DataFrame:
    """OUT for a stream of changes(path, change_type, ts, entities): one row for each run of a path's changes without such a gap, the last change standing.

    snapshot(path, entities) is what is known at the start; it counts for the
    query's first run alone. Rows behind the watermark are dropped. A null path
    is a path of its own. The session's state store must be PROVIDER.
    """
    start = None if snapshot is None else snapshot.select("path", "entities").groupBy("path")
    rows = changes.select("path", "change_type", "ts", F.coalesce("entities", F.lit(0)).cast("bigint").alias("entities")).withWatermark("ts", watermark)
    return rows.groupBy("path").transformWithStateInPandas(FileState(gap_ms), OUT, "append", "EventTime", initialState=start)


def state_statistics(spark, checkpoint: str, operator: int = 0) -> DataFrame:
    """One row from a checkpoint, whether its query runs or not: files that are known, their entities, files with changes waiting, and these changes."""
    read = lambda name: spark.read.format("statestore").option("path", checkpoint).option("operatorId", operator).option("stateVarName", name).load()
    known = read("known").agg(F.count("*").alias("files"), F.coalesce(F.sum("value.entities"), F.lit(0)).alias("entities"))
    waiting = read("waiting").agg(F.count("*").alias("pending_files"), F.coalesce(F.sum(F.size("value.changes")), F.lit(0)).cast("bigint").alias("pending_changes"))
    return known.crossJoin(waiting)  # one row each


@contextlib.contextmanager
def state_store(spark):
    """The session with PROVIDER, for queries that run to their end inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)
