"""File changes as streams: debounce, per-file state, statistics, and a source that watches a folder.

A stream has rows (path, change_type, ts); change_type is Added, Modified,
Deleted or Renamed. The same transformations run on a batch.
"""

from __future__ import annotations

import hashlib
import json
import os
import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..functions.scalars import extension
from ..functions.test_rules import EXTENSIONS, IGNORED

CHANGES = ("Added", "Modified", "Deleted", "Renamed")
DEBOUNCE = "500 milliseconds"
MOST_DEPTH = 10


def relevant(changes: DataFrame, extensions: tuple = EXTENSIONS, patterns: tuple = IGNORED, depth: int = MOST_DEPTH) -> DataFrame:
    """Known change types of known files, by relative path; the extension of a deleted file isn't asked for."""
    from ..sources.ingest import ignored

    p = F.col("path")
    kept = changes.where(F.col("change_type").isin(*CHANGES) & ~ignored(p, patterns) & (F.size(F.split(p, "/")) <= depth))
    return kept.where((F.col("change_type") == "Deleted") | extension(p).isin(*extensions))


def debounce(changes: DataFrame, gap: str = DEBOUNCE, watermark: str | None = None) -> DataFrame:
    """path, change_type, ts, events: one row for each run of changes of a path without such a gap; the last change stands.

    With a watermark a run is given out once it has passed; later rows are
    dropped, as documented for streams. ts must be a timestamp with time zone there.
    """
    if watermark:
        changes = changes.withWatermark("ts", watermark)
    last = F.max_by("change_type", F.struct("ts", "change_type"))
    runs = changes.groupBy("path", F.session_window("ts", gap).alias("w")).agg(last.alias("change_type"), F.max("ts").alias("ts"), F.count("*").alias("events"))
    return runs.select("path", "change_type", "ts", "events")


UPDATE = "path string, ts timestamp, change_type string, entities_added bigint, entities_removed bigint, entities_modified bigint"


def next_state(known: int | None, change: str, entities: int) -> tuple[int | None, tuple[int, int, int]]:
    """(entities of the file now, (added, removed, modified)). A change of an unknown file adds it; an unknown file's deletion does nothing."""
    if change in ("Deleted", "Renamed"):
        return None, (0, known or 0, 0)
    if known is None:
        return entities, (entities, 0, 0)
    return entities, (0, known, entities)


def update_stats(changes: DataFrame) -> DataFrame:
    """Statistics of each change of changes(path, change_type, ts, entities), from a state kept by path. Streaming only."""

    def step(key, frames, state):
        rows = sorted((r for f in frames for r in zip(f["ts"], f["change_type"], f["entities"])), key=lambda r: (r[0], r[1]))
        known = state.get[0] if state.exists else None
        out = []
        for ts, change, n in rows:
            known, (a, r, m) = next_state(known, change, int(n))
            out.append((key[0], ts, change, a, r, m))
        if known is None:
            state.remove() if state.exists else None
        else:
            state.update((known,))
        yield pd.DataFrame(out, columns=["path", "ts", "change_type", "entities_added", "entities_removed", "entities_modified"])

    return changes.groupBy("path").applyInPandasWithState(step, UPDATE, "entities bigint", "append", "NoTimeout")


def update_stats_batch(changes: DataFrame) -> DataFrame:
    """The same for a batch, from windows over each path's changes: what a file holds after a change follows from that change alone."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("ts", "change_type")
    gone = F.col("change_type").isin("Deleted", "Renamed")
    after = F.when(gone, F.lit(None)).otherwise(F.col("entities"))
    x = changes.withColumn("_after", after).withColumn("_before", F.lag("_after").over(w))
    zero = F.lit(0).cast("bigint")
    return x.select(
        "path", "ts", "change_type",
        F.when(gone | F.col("_before").isNotNull(), zero).otherwise(F.col("entities")).cast("bigint").alias("entities_added"),
        F.coalesce("_before", zero).cast("bigint").alias("entities_removed"),
        F.when(gone | F.col("_before").isNull(), zero).otherwise(F.col("entities")).cast("bigint").alias("entities_modified"),
    )


def totals(updates: DataFrame) -> DataFrame:
    """One row: files updated, and the sums."""
    return updates.agg(F.count_distinct("path").alias("files_updated"), *[F.sum(c).alias(c) for c in ("entities_added", "entities_removed", "entities_modified")])


def replace_files(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of old without those of changed files, and the new ones: old rows of deleted and re-read files go."""
    paths = changes.select(F.col("path").alias("file_path")).distinct()
    return old.join(paths, "file_path", "left_anti").unionByName(new.join(changes.where(~F.col("change_type").isin("Deleted", "Renamed")).select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi"))


#: Folders that a stored graph's rows are dealt to by their file's path; an update rewrites those of the changed files.
BUCKETS = 64


def _bucket(path):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def _file(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _manifest(spark, graph_path: str, before: int | None = None) -> tuple[int, dict[str, int]]:
    """(number, bucket: version that has it) of the last update, or of the last before a number."""
    fs, p = _file(spark, graph_path)
    if not fs.exists(p):
        return -1, {}
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    numbers = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
    number = max((n for n in numbers if before is None or n < before), default=-1)
    if number < 0:
        return -1, {}
    f = fs.open(_file(spark, f"{graph_path}/manifest-{number}.json")[1])
    try:
        return number, json.loads(bytes(f.readAllBytes()).decode())
    finally:
        f.close()


def stored_rows(spark, graph_path: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The extracted rows that live_update() keeps, of all buckets or some."""
    from ..sources.ingest import ROW_DDL

    _, held = _manifest(spark, graph_path, before)
    paths = [f"{graph_path}/v{version}/bucket={b}" for b, version in held.items() if version >= 0 and (buckets is None or int(b) in buckets)]
    return spark.read.schema(ROW_DDL).parquet(*paths) if paths else spark.createDataFrame([], ROW_DDL)


def live_update(changes: DataFrame, read_files, graph_path: str, checkpoint: str, on_update=None):
    """A query that keeps extracted rows under graph_path up to date: each batch of changes re-extracts its files and replaces their rows.

    read_files(paths) gives files(path, content). Only the buckets of changed
    paths are read and written, into a folder of the batch's number; a manifest
    says which version of each bucket stands, so a repeated batch overwrites
    its own and a reader sees whole updates. Versions that neither this update
    nor the one before needs are deleted. on_update(batch, graph_path) is called after each.
    """
    from ..sources.folders import staged
    from ..sources.ingest import extract

    def each(batch: DataFrame, number: int):
        spark = batch.sparkSession
        last = staged(batch.groupBy("path").agg(F.max_by("change_type", "ts").alias("change_type")), "changes")
        touched = [r[0] for r in last.select(_bucket(F.col("path"))).distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        fresh = extract(read_files(last.where(~F.col("change_type").isin("Deleted", "Renamed"))))
        rows = staged(replace_files(stored_rows(spark, graph_path, touched, number), fresh, last).withColumn("bucket", _bucket(F.col("file_path"))), "rows")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{graph_path}/v{number}")
        left = {r[0] for r in rows.select("bucket").distinct().collect()}
        _, held = _manifest(spark, graph_path, number)
        now = held | {str(b): number if b in left else -1 for b in touched}
        fs, p = _file(spark, f"{graph_path}/.manifest-{number}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        target = _file(spark, f"{graph_path}/manifest-{number}.json")[1]
        fs.delete(target, False)
        fs.rename(p, target)
        needed = {f"v{x}" for x in [*held.values(), *now.values(), number]}
        for x in fs.listStatus(_file(spark, graph_path)[1]):
            if x.isDirectory() and x.getPath().getName().startswith("v") and x.getPath().getName() not in needed:
                fs.delete(x.getPath(), True)
        if on_update:
            on_update(batch, graph_path)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def initial_changes(files: DataFrame) -> DataFrame:
    """A snapshot as Added changes, to start a state from."""
    return files.select("path", F.lit("Added").alias("change_type"), F.col("modified").alias("ts"))


def one_update(spark, root: str, path: str) -> DataFrame:
    """A change record for one file asked for by hand: Modified, or Deleted where it is missing."""
    there = os.path.exists(os.path.join(root, path))
    return spark.createDataFrame([(path, "Modified" if there else "Deleted")], "path string, change_type string").withColumn("ts", F.current_timestamp())


class _Slice(InputPartition):
    def __init__(self, rows):
        self.rows = rows


class FolderWatchReader(DataSourceStreamReader):
    """Compares the folder's listing with the one of the last offset. The folder is one that the driver sees.

    Option state names a folder that outlives the query: listings are files there, offsets carry their names, and a
    restart goes on from the last.
    """

    def __init__(self, options):
        if not options.get("state"):
            raise ValueError("option state: a folder for listings that outlives the query")
        self.root, self.depth, self.state = options["path"], int(options.get("depth", MOST_DEPTH)), options["state"]

    def _kept(self, listing: str) -> dict:
        name = hashlib.sha256(listing.encode()).hexdigest()[:32]
        full = os.path.join(self.state, name)
        if not os.path.exists(full):
            os.makedirs(self.state, exist_ok=True)
            with open(f"{full}.new", "w") as f:
                f.write(listing)
            os.replace(f"{full}.new", full)
        return {"at": name}

    def _back(self, offset: dict) -> dict:
        with open(os.path.join(self.state, offset["at"])) as f:
            return json.loads(f.read())

    def _listing(self) -> dict:
        out = {}
        for folder, names, files in os.walk(self.root):
            rel = os.path.relpath(folder, self.root)
            if rel != "." and rel.count(os.sep) + 1 >= self.depth:
                names.clear()
            for f in files:
                full = os.path.join(folder, f)
                try:
                    out[os.path.relpath(full, self.root)] = os.stat(full).st_mtime_ns
                except OSError:
                    pass
        return out

    def initialOffset(self) -> dict:
        return self._kept("{}")

    def latestOffset(self) -> dict:
        return self._kept(json.dumps(self._listing(), sort_keys=True))

    def partitions(self, start: dict, end: dict):
        a, b = self._back(start), self._back(end)
        now = time.time_ns()
        rows = [(p, "Added" if p not in a else "Modified", t) for p, t in b.items() if a.get(p) != t] + [(p, "Deleted", now) for p in a if p not in b]
        return [_Slice(rows[i : i + 1000]) for i in range(0, len(rows), 1000)] or [_Slice([])]

    def read(self, partition: _Slice):
        import datetime as dt

        for path, change, ns in partition.rows:
            yield path, change, dt.datetime.fromtimestamp(ns / 1e9, dt.timezone.utc)

    def commit(self, end: dict):
        pass


class FolderWatch(DataSource):
    """spark.dataSource.register(FolderWatch); spark.readStream.format("folder_watch").option("state", folder).load(root)"""

    @classmethod
    def name(cls):
        return "folder_watch"

    def schema(self):
        return "path string, change_type string, ts timestamp"

    def streamReader(self, schema):
        return FolderWatchReader(self.options)
