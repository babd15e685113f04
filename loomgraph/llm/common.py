"""Helpers shared by the training-data operators: tables, shared folders, stage files."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; the session is set for large rows."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Whole texts are large rows: batches that go to Python hold at most so many rows, and bytes, as long as the session asks for no fewer."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        digits = re.sub(r"\D", "", now or "")
        if not digits or int(digits) <= 0 or int(digits) > most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def large_batches(spark: SparkSession, rows: int = 20_000):
    """Steps over narrow rows that run inside take so many rows a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def release() -> None:
    """The same after the driver's garbage is collected."""
    gc.collect()
    trim()


def tidy(run):
    """A task's function over batches that gives its worker's memory back at the end: workers live on and stand side by side."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        trim()

    return tidied


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as they were needed: sums of letters times powers hash all runs of an array at once."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            one = lambda x: np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64)))
            self.up, self.down = one(self.BASE), one(pow(self.BASE, -1, 1 << 64))
        return self.up, self.down


def text_col(name: str = "text"):
    """The column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. On one machine, where it is unset, a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    kept = getattr(spark.sparkContext, "_loom_root", None)
    if kept is None:
        kept = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.sparkContext._loom_root = kept
        spark.sparkContext.setCheckpointDir(kept)
    return kept


def shared_dir(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, tag: str, codec: str = "zstd", **options) -> DataFrame:
    """Writes df to the shared folder, with the writer's options, and reads it back: lineage ends here, and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.options(compression=codec, **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a stage folder through Hadoop's file system API."""
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the shared folder, in place of the one that is there."""
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """The file's text, or None if there is no file."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    f = fs.open(p)
    try:
        return bytes(f.readAllBytes()).decode()
    finally:
        f.close()


def clean_up(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of steps whose results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_stage(df: DataFrame) -> None:
    if path := getattr(df, "_loom_path", None):
        drop_path(df.sparkSession, path)


#: Keys of a semi-join are broadcast up to this many bytes; beyond it both sides are shuffled.
MOST_BROADCAST = 8 << 20


def narrow(rows: DataFrame, keys: DataFrame, on, bytes_each: int = 16) -> DataFrame:
    """The rows that keys (distinct, few columns of fixed width, cheap to count) name; on is as for join()."""
    small = keys.count() * bytes_each <= MOST_BROADCAST
    return rows.join(F.broadcast(keys) if small else keys, on, "left_semi")


def arrow_fs(uri: str):
    """(file system, path inside it) for reading and writing files from tasks."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def rows_of(staged: DataFrame) -> Iterator[dict]:
    """The rows of a stage in the driver's Python, file by file; its JVM, which would hold them several times over, doesn't see them."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = arrow_fs(staged._loom_path)
    for f in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda f: f.path):
        if f.base_name.endswith(".parquet"):
            with store.open_input_file(f.path) as file:
                yield from pq.ParquetFile(file).read(use_threads=False).to_pylist()
