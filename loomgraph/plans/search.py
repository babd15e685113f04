"""Text search and listings over files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED_FOLDERS = ("node_modules", ".git")


def search_lines(files: DataFrame, pattern: str, key: str = "path", regex: bool = False, glob: str | None = None, most: int | None = 100) -> DataFrame:
    """(key, line_number, line) of the lines that hold the pattern, whatever their case; lines trimmed, numbers from 1.

    Lines are cut out only of files that can match. With most, the first so
    many by key and number, and `total`, how many there are.
    """
    rx = "(?i)" + (pattern if regex else re.escape(pattern))
    if glob:
        files = files.where(F.col(key).rlike(glob_to_regex(glob)))
    lines = files.where(F.col("content").rlike(rx)).select(key, F.posexplode(F.split("content", "\n")).alias("pos", "line"))
    hits = lines.where(F.col("line").rlike(rx)).select(key, (F.col("pos") + 1).alias("line_number"), F.trim("line").alias("line"))
    if most is None:
        return hits
    top = hits.orderBy(key, "line_number").limit(most)
    return top.crossJoin(hits.agg(F.count("*").alias("total"))) if most else top  # one row


def glob_to_regex(glob: str) -> str:
    """* and ? within a folder, ** across folders; matched against the path's end."""
    out = re.escape(glob).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"(^|/){out}$"


def read_file(files: DataFrame, path: str, encoding: str = "utf8") -> DataFrame:
    """(path, content, size, modified, error) of one file of files(path, content, length, modified); a missing one gives its error.

    base64 gives the bytes of the content so encoded. The path is compared at the scan.
    """
    if encoding not in ("utf8", "base64"):
        raise ValueError("encoding is utf8 or base64")
    content = F.col("content") if encoding == "utf8" else F.base64(F.encode("content", "UTF-8"))
    one = files.where(F.col("path") == path).select(F.lit(path).alias("path"), content.alias("content"), F.col("length").alias("size"), "modified")
    asked = files.sparkSession.createDataFrame([(path,)], "path string")
    error = F.when(F.col("size").isNull(), F.concat(F.lit("no such file: "), "path"))
    return asked.join(one, "path", "left").withColumn("error", error)


def list_files(files: DataFrame, folder: str = "", recursive: bool = True, skip: tuple = SKIPPED_FOLDERS) -> DataFrame:
    """(name, path, type) below a folder of files(path); folders themselves only where not recursive."""
    prefix = folder.rstrip("/") + "/" if folder.strip("/.") else ""
    rest = F.substr("path", F.lit(len(prefix) + 1))
    inside = files.where(F.startswith("path", F.lit(prefix))).withColumn("rest", rest)
    for s in skip:
        inside = inside.where(~F.col("path").rlike(rf"(^|/){re.escape(s)}(/|$)"))
    if recursive:
        return inside.select(F.substring_index("path", "/", -1).alias("name"), "path", F.lit("file").alias("type"))
    first = F.substring_index("rest", "/", 1)
    kind = F.when(F.contains("rest", F.lit("/")), "directory").otherwise("file")
    return inside.select(first.alias("name"), F.concat(F.lit(prefix), first).alias("path"), kind.alias("type")).distinct()
