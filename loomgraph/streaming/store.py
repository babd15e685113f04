"""Tables in the shared folder that are replaced bucket by bucket, all of them by one manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _file(spark, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


class BucketStore:
    """The tables as they stood before update `number`, and what the update puts in their place.

    A row's bucket is a hash of its table's key columns. An update writes the
    buckets that it changes into folders of its number; commit() writes the
    manifest, which says for each table and bucket whose version stands. Readers
    see whole updates; an update that is done again, by the same number, begins
    from what stood before it and overwrites its own files. Versions that
    neither the last manifest nor the one before names are deleted.
    """

    def __init__(self, spark, path: str, number: int, buckets: int = 64):
        self.spark, self.path, self.number = spark, path.rstrip("/"), number
        self.at, kept = self._last(number)
        self.buckets = kept.get("buckets", buckets)
        self.before: dict[str, dict[str, int]] = kept.get("tables", {})
        self.now = {t: dict(v) for t, v in self.before.items()}
        #: Rows of which buckets were asked for, by table.
        self.asked: dict[str, set[int]] = {}

    def _last(self, below: int) -> tuple[int, dict]:
        fs, p = _file(self.spark, self.path)
        if not fs.exists(p):
            return -1, {}
        names = [x.getPath().getName() for x in fs.listStatus(p)]
        number = max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json") and int(n[9:-5]) < below), default=-1)
        if number < 0:
            return -1, {}
        f = fs.open(_file(self.spark, f"{self.path}/manifest-{number}.json")[1])
        try:
            return number, json.loads(bytes(f.readAllBytes()).decode())
        finally:
            f.close()

    def bucket(self, *key: str | Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, *key: str | Column) -> list[int]:
        """The buckets of some rows: as many numbers as there are buckets at most."""
        return [r[0] for r in rows.select(self.bucket(*key)).distinct().collect()]

    def read(self, table: str, ddl: str, buckets: list[int] | None = None) -> DataFrame:
        held = self.now.get(table, {})
        some = [b for b, v in held.items() if v >= 0 and (buckets is None or int(b) in buckets)]
        self.asked.setdefault(table, set()).update(map(int, some))
        paths = [f"{self.path}/v{held[b]}/{table}/bucket={b}" for b in some]
        return self.spark.read.schema(ddl).parquet(*paths) if paths else self.spark.createDataFrame([], ddl)

    def put(self, table: str, rows: DataFrame, touched: list[int], *key: str) -> None:
        """rows stand for the touched buckets of a table from now on. Without key columns rows have the column bucket and are dealt by it already."""
        if not touched:
            return
        at = f"{self.path}/v{self.number}/{table}"
        dealt = rows.withColumn("bucket", self.bucket(*key)).repartition("bucket") if key else rows
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(at)
        fs, p = _file(self.spark, at)
        left = {x.getPath().getName()[7:] for x in fs.listStatus(p) if x.getPath().getName().startswith("bucket=")}
        self.now.setdefault(table, {}).update({str(b): self.number if str(b) in left else -1 for b in touched})

    def commit(self) -> None:
        fs, p = _file(self.spark, f"{self.path}/.manifest-{self.number}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "tables": self.now}).encode()))
        out.close()
        target = _file(self.spark, f"{self.path}/manifest-{self.number}.json")[1]
        fs.delete(target, False)
        fs.rename(p, target)
        needed = {self.number} | {v for tables in (self.before, self.now) for held in tables.values() for v in held.values()}
        for x in fs.listStatus(_file(self.spark, self.path)[1]):
            name = x.getPath().getName()
            if x.isDirectory() and name.startswith("v") and int(name[1:]) not in needed:
                fs.delete(x.getPath(), True)
            elif name.startswith("manifest-") and int(name[9:-5]) < self.at:
                fs.delete(x.getPath(), False)


def latest(spark, path: str) -> BucketStore:
    """The store as the last update left it, for reading."""
    return BucketStore(spark, path, 1 << 62)
