"""Source trees as a batch data source: tasks list folders, ignored ones are never entered, and content is read for what passes.

The driver lists folders only until there are enough for the tasks; each task
walks its folders by Arrow's file systems, so a tree may be in any store that
these read. Filters on extension and length are taken by the source.
"""

from __future__ import annotations

import fnmatch
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..functions import test_rules as T

SCHEMA = "path string, extension string, length bigint, modified timestamp"
#: Folders that the driver lists, at most, to find as many for the tasks.
MOST_LISTED, FOLDERS = 200, 64
#: Folders deeper than that aren't entered, so links in a circle end.
MOST_DEPTH = 64


def file_system(uri: str):
    """(Arrow file system, path inside it)."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def passes_over(relative: str, patterns) -> bool:
    """A pattern is part of the relative path, or a glob of its last name; of a folder, the part says so for all that is below."""
    last = relative.rstrip("/").rsplit("/", 1)[-1]
    return any(p in relative for p in patterns) or not relative.endswith("/") and any(fnmatch.fnmatchcase(last, p) for p in patterns)


def entries(at, base: str, relative: str, patterns) -> tuple[list, list[str]]:
    """(files, folders) right below a folder of the tree, ignored ones left out. A folder that can't be read is empty."""
    from pyarrow import fs

    try:
        found = at.get_file_info(fs.FileSelector(f"{base}/{relative}".rstrip("/"), recursive=False, allow_not_found=True))
    except OSError:
        return [], []
    files, folders = [], []
    for x in found:
        name = relative + x.base_name
        if x.type == fs.FileType.Directory:
            if not passes_over(f"{name}/", patterns) and name.count("/") < MOST_DEPTH:
                folders.append(f"{name}/")
        elif x.type == fs.FileType.File and not passes_over(name, patterns):
            files.append((name, x.size or 0, x.mtime))
    return files, folders


class _Folders(InputPartition):
    def __init__(self, walked: list[str], alone: list[str]):
        self.walked, self.alone = walked, alone


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].rstrip("/")
        self.patterns = tuple(x for x in options.get("ignored", "\n".join(T.IGNORED)).split("\n") if x)
        self.extensions = set(options["extensions"].split(",")) if options.get("extensions") else None
        self.least, self.most = None, int(options["mostbytes"]) if options.get("mostbytes") else None

    def partitions(self):
        """Folders to walk, and those of which only the files are wanted, since their folders are walked by others."""
        at, base = file_system(self.root)
        open_, alone = [""], []
        while open_ and len(open_) < FOLDERS and len(alone) < MOST_LISTED:
            folder = open_.pop(0)
            alone.append(folder)
            open_ += entries(at, base, folder, self.patterns)[1]
        n = max(1, min(FOLDERS, len(open_) + len(alone)))
        return [_Folders(open_[k::n], alone[k::n]) for k in range(n)]

    def read(self, partition: _Folders):
        at, base = file_system(self.root)
        waiting = [(x, True) for x in reversed(partition.walked)] + [(x, False) for x in partition.alone]
        while waiting:
            folder, deeper = waiting.pop()
            files, folders = entries(at, base, folder, self.patterns)
            for name, length, modified in files:
                last = name.rsplit("/", 1)[-1]
                extension = last[last.rfind(".") :] if "." in last else ""
                if (self.extensions is None or extension in self.extensions) and (self.most is None or length <= self.most) and (self.least is None or length >= self.least):
                    yield name, extension, length, modified
            if deeper:
                waiting += [(x, True) for x in folders]


class PushedTreeReader(TreeReader):
    """The same for sessions whose spark.sql.python.filterPushdown.enabled is true; in others Spark refuses a reader that takes filters."""

    def pushFilters(self, filters):
        """Takes equality of the extension and bounds of the length; the rest stays with Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if column == "extension" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.extensions = wanted if self.extensions is None else self.extensions & wanted
            elif column == "length" and isinstance(f, (LessThan, LessThanOrEqual)):
                most = f.value - isinstance(f, LessThan)
                self.most = most if self.most is None else min(self.most, most)
            elif column == "length" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                least = f.value + isinstance(f, GreaterThan)
                self.least = least if self.least is None else max(self.least, least)
            else:
                yield f


class SourceTree(DataSource):
    """spark.dataSource.register(SourceTree); spark.read.format("source_tree").load(root): SCHEMA, one row a file, by relative path.

    Options: ignored, patterns by line; extensions, with commas; mostbytes; pushdown, true for filters of the query.
    """

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushedTreeReader if self.options.get("pushdown") == "true" else TreeReader)(self.options)


def listing(spark: SparkSession, root: str, patterns: tuple = T.IGNORED, extensions: tuple = (), most_bytes: int | None = None, pushdown: bool = False) -> DataFrame:
    """SCHEMA of the files below root that no pattern ignores, also empty ones and those whose names begin with _ or a dot.

    extensions and most_bytes say what is wanted, in any session. With pushdown
    the source takes such filters from the query: where the plan runs, the
    setting spark.sql.python.filterPushdown.enabled must be true then.
    """
    spark.dataSource.register(SourceTree)
    read = spark.read.format("source_tree").option("ignored", "\n".join(patterns)).option("pushdown", str(pushdown).lower())
    read = read.option("extensions", ",".join(extensions)) if extensions else read
    read = read.option("mostbytes", str(most_bytes)) if most_bytes is not None else read
    return read.load(root)


def with_content(files: DataFrame, root: str) -> DataFrame:
    """files(path, ...) with content binary: files are dealt to tasks by a hash of their path, whatever folder they are in. One that is gone, or can't be read, has null."""
    columns = files.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches):
        import pyarrow as pa

        at, base = file_system(root)
        for b in batches:
            # a file at a time, so that a batch's memory is that of one file
            for i, path in enumerate(b.column("path").to_pylist()):
                try:
                    with at.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                        content = f.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([*(b.slice(i, 1).column(c) for c in columns), pa.array([content], pa.binary())], [*columns, "content"])

    return files.repartition(F.xxhash64("path")).mapInArrow(run, f"{kinds}, content binary")


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Writes files(path, content) below root by tasks: (path, length) of what was written. The result must be acted on; a task that is done again writes the same."""

    def run(batches):
        import pyarrow as pa

        at, base = file_system(root)
        for b in batches:
            paths, sizes = b.column("path").to_pylist(), []
            for path, content in zip(paths, b.column("content").to_pylist()):
                data = (content or "").encode() if not isinstance(content, bytes) else content
                full = f"{base.rstrip('/')}/{path}"
                at.create_dir(full.rsplit("/", 1)[0], recursive=True)
                with at.open_output_stream(full) as f:
                    f.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "length"])

    return files.select("path", "content").mapInArrow(run, "path string, length bigint")
