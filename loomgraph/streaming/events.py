"""Events of a live graph for listeners: a bounded buffer that drops what doesn't fit, and JSON."""

from __future__ import annotations

import json
import queue
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_HELD = 100


class EventBuffer:
    """offer() never waits; dropped counts what found it full."""

    def __init__(self, size: int = MOST_HELD):
        self.queue: queue.Queue = queue.Queue(size)
        self.dropped = 0
        self.listeners: list[Callable[[dict], None]] = []

    def offer(self, kind: str, **data) -> bool:
        event = {"type": kind, "timestamp": time.time(), "data": data}
        for f in self.listeners:
            f(event)
        try:
            self.queue.put_nowait(event)
            return True
        except queue.Full:
            self.dropped += 1
            return False

    def drain(self) -> list[dict]:
        out = []
        while not self.queue.empty():
            out.append(self.queue.get_nowait())
        return out


def to_json(event: dict) -> str:
    return json.dumps(event, sort_keys=True)


def forward(buffer: EventBuffer) -> Callable[[DataFrame, str], None]:
    """For live_update's on_update: one event for each kind of change in a batch, with its number of files."""

    def on_update(batch: DataFrame, version: str) -> None:
        for r in batch.groupBy("change_type").agg(F.count_distinct("path").alias("files")).collect():  # four kinds at most
            buffer.offer(r["change_type"], files=r["files"], version=version)

    return on_update
