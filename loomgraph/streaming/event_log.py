"""Events of a stream in a log that replays don't change, with what subscribers had no room for counted beside them."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .store import _file

EVENT = "batch bigint, sequence bigint, event string, type string"
DROPPED = "batch bigint, type string, dropped bigint"


def numbered(events: DataFrame, *order: str) -> DataFrame:
    """events with sequence, from 1, in the order of the columns, whatever the partitions: places inside range partitions and the sizes of those before, so no task sorts all."""
    parted = events.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.join(F.broadcast(starts), "_part").withColumn("sequence", (F.col("_start") + place).cast("bigint")).drop("_part", "_start")


def deliver(batch: DataFrame, number: int, path: str, order: tuple, room: int | None = None) -> None:
    """Writes a batch of rows with type as events: JSON with (batch, sequence). Of more than room the later ones are counted by type instead.

    The batch's own folders are written anew, so a batch that is done again adds nothing.
    """
    rows = numbered(batch, *order)
    shown = [F.col(c) for c in batch.columns]
    body = F.to_json(F.struct(F.lit(number).cast("bigint").alias("batch"), "sequence", *shown))
    fits = F.lit(True) if room is None else F.col("sequence") <= room
    rows.where(fits).select(F.lit(number).cast("bigint").alias("batch"), "sequence", body.alias("event"), "type").write.mode("overwrite").parquet(f"{path}/events/{number}")
    rows.where(~fits).groupBy("type").agg(F.count("*").alias("dropped")).select(F.lit(number).cast("bigint").alias("batch"), "type", "dropped").write.mode("overwrite").parquet(f"{path}/dropped/{number}")


def log_events(stream: DataFrame, path: str, checkpoint: str, order: tuple, room: int | None = None):
    """A query that writes a stream's rows (type and others) to the log under path, each once."""
    return stream.writeStream.foreachBatch(lambda batch, number: deliver(batch, number, path, order, room)).option("checkpointLocation", checkpoint)


def _all(spark, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).option("recursiveFileLookup", "true").parquet(path)


def events_of(spark, path: str, after: tuple[int, int] = (-1, 0)) -> DataFrame:
    """The log behind a reader's place (batch, sequence), which a reader keeps to go on from."""
    batch, sequence = after
    return _all(spark, f"{path}/events", EVENT).where((F.col("batch") > batch) | (F.col("batch") == batch) & (F.col("sequence") > sequence))


def dropped(spark, path: str) -> DataFrame:
    return _all(spark, f"{path}/dropped", DROPPED)


class QueryEvents(StreamingQueryListener):
    """Starts, progress and ends of the session's streaming queries as small JSON files below a folder, named by run and batch, so that one told twice is one."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _write(self, name: str, **event) -> None:
        fs, p = _file(self.spark, f"{self.path}/{name}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(event | {"written": dt.datetime.now(dt.timezone.utc).isoformat()}).encode()))
        out.close()

    def onQueryStarted(self, event):
        self._write(f"{event.runId}-started", kind="started", run=str(event.runId), id=str(event.id))

    def onQueryProgress(self, event):
        p = event.progress
        self._write(f"{p.runId}-{p.batchId}", kind="progress", run=str(p.runId), id=str(p.id), batch=p.batchId, rows=p.numInputRows)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._write(f"{event.runId}-ended", kind="ended", run=str(event.runId), id=str(event.id), error=event.exception)
