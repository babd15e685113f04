"""Line deduplication by levelled sorted runs of line hashes. DataFrame operations only.

A line's key is named by two 64-bit hashes. A run is a table of distinct names,
bucketed and sorted by them, with the number of documents that hold the
line so far and the largest id among them. A new batch of documents is reduced
to one row a name and merge-joined with the runs, newest first, which are
neither shuffled nor sorted again: names that no run has are new (the
anti-join), the others continue their count; both become the batch's own run.
So a name's newest row has its totals. When a level has FAN_OUT runs, they are
merged into one of the next level, each name keeping its newest row; names
beside the runs are log-many, as in any levelled store.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, drop_path, drop_stage, read_text, shared_dir, stage, text_col, write_text

#: Runs of a level before they are merged into one of the next.
FAN_OUT = 2
#: Batches that dedup() makes of one table: enough for three levels.
BATCHES = 4
#: A line's key has so many characters, and its documents are so many, before it goes.
LEAST_CHARS, LEAST_DOCS = 40, 5
#: The runs' columns besides those of their names.
NAME = ("h1", "h2")
RUN = "h1 bigint, h2 bigint, n_docs bigint, last_id {kind}"
#: Names with more than one part in so many of all (name, document) pairs are hot: there are no more of them than this.
HOT_PARTS = 10_000

UPPER, LOWER, BLANK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; an empty text is one empty line."""
    return F.split(text, "\n")


def key_of(line: Column) -> Column:
    """A line without white space at its ends, A to Z in lower case."""
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(BLANK))


def names(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def occurrences(docs: DataFrame, *columns: Column, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(columns, h1, h2, last_id): a row for each distinct key of a document of docs(doc_id, text), n_docs being 1."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), key_of), lambda k: F.char_length(k) >= least_chars))
    out = docs.select(*columns, "doc_id", F.explode(keys).alias("key"))
    return out.select(*[c for c in out.columns if c not in ("doc_id", "key")], *names(F.col("key")), F.lit(1).cast("long").alias("n_docs"), F.col("doc_id").alias("last_id"))


def summed(rows: DataFrame, *by: str) -> DataFrame:
    """One row a name; tasks add up before anything is shuffled."""
    return rows.groupBy(*by, *NAME).agg(F.sum("n_docs").alias("n_docs"), F.max("last_id").alias("last_id"))


class Runs:
    """A family of runs in the shared folder. What it holds is in its manifest, written last, so a batch is in whole or not at all."""

    def __init__(self, spark: SparkSession, path: str | None = None, id_type: str = "bigint", buckets: int | None = None, fan_out: int = FAN_OUT):
        """Opens the family at path, or makes one. id_type, buckets and fan_out count for new ones."""
        self.spark, self.path = spark, (path or shared_dir(spark, "lines")).rstrip("/")
        kept = read_text(spark, f"{self.path}/manifest.json")
        fresh = {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "fan_out": fan_out, "id_type": id_type, "levels": [], "batches": []}
        self.state = json.loads(kept) if kept else fresh

    def _table(self, run: str) -> DataFrame:
        """A run as a bucketed table; the catalogue of another session doesn't know it yet."""
        name = f"lines_{run}"
        if not self.spark.catalog.tableExists(name):
            columns = RUN.format(kind=self.state["id_type"])
            self.spark.sql(f"create table {name} ({columns}) using parquet clustered by (h1, h2) sorted by (h1, h2) into {self.state['buckets']} buckets location '{self.path}/{run}'")
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        """All runs, the newest first."""
        return [self._table(r) for level in self.state["levels"] for r in reversed(level)]

    def _write(self, rows: DataFrame, aligned: bool) -> str:
        """aligned: rows are in as many partitions, by name, as there are buckets, so that a task writes one file."""
        run = uuid.uuid4().hex[:12]
        if not aligned:
            rows = rows.repartition(self.state["buckets"], *NAME)
        rows.write.bucketBy(self.state["buckets"], *NAME).sortBy(*NAME).option("path", f"{self.path}/{run}").option("compression", "zstd").saveAsTable(f"lines_{run}")
        return run

    def _drop(self, run: str) -> None:
        self.spark.sql(f"drop table if exists lines_{run}")
        drop_path(self.spark, f"{self.path}/{run}")

    def merged(self, batch: DataFrame) -> DataFrame:
        """The batch's names with their totals and is_new: no run has the name. batch is summed()."""
        out = batch.withColumn("seen", F.lit(0).cast("long")).withColumn("seen_id", F.lit(None).cast(self.state["id_type"]))
        for run in self.runs():
            # a newer run's row is the larger, so the largest is the newest
            r = run.select(*NAME, F.col("n_docs").alias("_n"), F.col("last_id").alias("_last")).hint("merge")
            out = out.join(r, list(NAME), "left").select(*NAME, "n_docs", "last_id", F.greatest("seen", "_n").alias("seen"), F.greatest("seen_id", "_last").alias("seen_id"))
        return out.select(*NAME, (F.col("n_docs") + F.col("seen")).alias("n_docs"), F.greatest("last_id", "seen_id").alias("last_id"), (F.col("seen") == 0).alias("is_new"))

    def add(self, batch: DataFrame, tag: str) -> None:
        """Adds a batch, summed() by name, as a run, and merges full levels. A tag that is there already adds nothing, so a batch may be given again."""
        if tag in self.state["batches"]:
            return
        old = []
        levels = [list(x) for x in self.state["levels"]] or [[]]
        levels[0].append(self._write(self.merged(batch).drop("is_new"), bool(self.runs())))
        at = 0
        while len(levels[at]) >= self.state["fan_out"]:
            newest = self._newest([self._table(r) for r in levels[at]])
            old += levels[at]
            levels[at] = []
            if at + 1 == len(levels):
                levels.append([])
            at += 1
            levels[at].append(self._write(newest, False))
        self.state |= {"levels": levels, "batches": [*self.state["batches"], tag]}
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))
        for r in old:
            self._drop(r)

    @staticmethod
    def _newest(runs: list[DataFrame]) -> DataFrame:
        """Every name of the runs with its newest, which is its largest, row: merge joins of tables bucketed alike."""
        out = runs[0]
        for r in runs[1:]:
            r = r.select(*NAME, F.col("n_docs").alias("_n"), F.col("last_id").alias("_last")).hint("merge")
            out = out.join(r, list(NAME), "full").select(*NAME, F.greatest("n_docs", "_n").alias("n_docs"), F.greatest("last_id", "_last").alias("last_id"))
        return out

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, last_id): every name once."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], RUN.format(kind=self.state["id_type"]))
        return self._newest(runs)

    def close(self, keep: bool = False) -> None:
        """Forgets the tables, and deletes the files unless they are to be opened again."""
        for r in [r for level in self.state["levels"] for r in level]:
            self.spark.sql(f"drop table if exists lines_{r}")
        if not keep:
            drop_path(self.spark, self.path)


def _id(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_col().alias("text"))


def add_documents(runs: Runs, docs: DataFrame, tag: str, id_col: str = "doc_id") -> None:
    """Adds one batch of new documents to a family; edge cases are those of dedup()."""
    runs.add(summed(occurrences(_id(docs, id_col))), tag)


def unseen_lines(runs: Runs, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(h1, h2, n_docs, last_id) of docs' distinct lines that no document of the family holds; lines under LEAST_CHARS don't count."""
    return runs.merged(summed(occurrences(_id(docs, id_col)))).where("is_new").drop("is_new")


def without_repeats(docs: DataFrame, totals: DataFrame, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", least_chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: docs without the lines whose name has least_docs documents in totals, except in the largest of these.

    Names with a large part of all pairs are few and broadcast; the others,
    none of them hot, are joined by shuffle unless all are few.
    """
    rows = _id(docs, id_col).withColumn("_t", F.xxhash64("text"))
    hot = stage(totals.where(F.col("n_docs") >= least_docs), "repeated")
    at = rows.select("doc_id", "_t", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    at = at.select("doc_id", "_t", "pos", key_of(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars).select("doc_id", "_t", "pos", *names(F.col("key")))
    counted = hot.agg(F.count("*").alias("n"), F.sum("n_docs").alias("pairs")).first()
    if counted["n"] * 40 <= MOST_BROADCAST:
        gone = at.join(F.broadcast(hot), list(NAME))
    else:
        often = F.col("n_docs") > counted["pairs"] // HOT_PARTS
        few = F.broadcast(hot.where(often))  # under HOT_PARTS rows
        gone = at.join(few, list(NAME)).unionByName(at.join(few.select(*NAME), list(NAME), "left_anti").join(hot.where(~often), list(NAME)))
    gone = gone.where(~F.col("doc_id").eqNullSafe(F.col("last_id"))).groupBy("doc_id", "_t").agg(F.collect_set("pos").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_d"), F.col("_t").alias("_u"), "gone")
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_u")), "left")
    lines = lines_of(F.col("text"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    out = out.select("doc_id", text.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))
    return out


def dedup(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """doc_id, text (what stays), n_lines, n_dropped for each row of docs.

    Lines whose keys have LEAST_CHARS characters and LEAST_DOCS documents stay
    only in the largest id that holds them. The table is read once for its
    names, dealt to batches that join the family one after another, and once
    more for the lines to drop.

    A row is a document: rows of one id count each, rows of the largest id all
    keep the line. A null id is below all ids; a null or empty text is one empty
    line; repeated lines of a document count once and go together; long texts
    are split whole; an empty table gives no rows; other columns of docs,
    whatever they are called, are not read.
    """
    spark = docs.sparkSession
    rows = _id(docs, id_col)
    deal = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    found = summed(occurrences(rows, deal), "batch")
    at = shared_dir(spark, "names")
    found.write.partitionBy("batch").parquet(at)
    found = spark.read.schema(found.select(*NAME, "n_docs", "last_id", "batch").schema).parquet(at)
    runs = Runs(spark, path, docs.schema[id_col].dataType.simpleString())
    for k in range(batches):
        runs.add(found.where(F.col("batch") == k).drop("batch"), str(k))
    out = without_repeats(docs, runs.totals(), id_col=id_col)
    drop_path(spark, at)
    runs.close(keep=path is not None)
    return out
