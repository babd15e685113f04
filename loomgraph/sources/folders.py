"""Where checkpoints and staged tables go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_root(spark) -> str:
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


def shared_dir(spark, tag: str) -> str:
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: made once, however often it is used."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes the folders of staged frames that nothing will read again."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def replaced(df: DataFrame, tag: str, *old: DataFrame) -> DataFrame:
    """df staged, whereupon old, which it was made of, is deleted.

    Rounds that build on each other use it in place of checkpoint(), which keeps the estimate of a frame's size: joins
    multiply estimates, so over many rounds these become numbers of millions of digits in the driver. A staged
    frame's size is that of its files.
    """
    new = staged(df, tag)
    dropped(*old)
    return new
