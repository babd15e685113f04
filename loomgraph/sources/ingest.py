"""From source trees to graphs: scan, extraction, resolution."""

from __future__ import annotations

import fnmatch
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import test_rules as T
from ..functions.scalars import basename, dirname, language
from ..graph import BuiltGraph, Graph
from ..operators import resolve as R
from ..schema import EDGE_DDL, NODE_DDL, RAW_EDGE_DDL, conform
from . import linking as L
from .derive import indirect_covers, satisfied_classes
from .folders import shared_dir, staged
from .tree import listing, with_content


def ignored(path, patterns: tuple = T.IGNORED):
    """A pattern is part of the relative path, or a glob of its last name. The root's own folders don't count."""
    out = F.lit(False)
    for p in patterns:
        out = out | F.contains(path, F.lit(p)) | basename(path).rlike(fnmatch.translate(p).replace(r"\Z", "$").replace(r"\z", "$"))
    return out


def scan(spark: SparkSession, root: str, patterns: tuple = T.IGNORED, most_bytes: int = T.MOST_BYTES) -> DataFrame:
    """files(path, content, language, length, modified) of the known extensions below root; content is null for what isn't UTF-8.

    Tasks list the folders and enter no ignored one; extension and size are asked of the listing, and a file's content is
    read only if it passes.
    """
    files = listing(spark, root, patterns, T.EXTENSIONS, most_bytes)
    read = with_content(files, root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return read.select("path", text.alias("content"), language(F.col("path")).alias("language"), "length", "modified")


ROW_DDL = _OUT = f"tag string, {NODE_DDL}, type string, src_id string, dst_ref string, confidence_score double, coverage_type string, error string"
_NAMES = [x.strip().split(" ")[0] for x in re.sub(r"map<string,string>", "map", _OUT).split(",")]


def _extract_one(path: str, content: str | None, own=None) -> list[dict]:
    from . import go_code, python_code, ts_code

    ext = path.rsplit(".", 1)[-1].lower()
    f = own or {"py": python_code.extract, "go": go_code.extract}.get(ext, ts_code.extract)
    try:
        if content is None:
            raise ValueError("not UTF-8 text")
        return f(path, content)
    except (SyntaxError, ValueError, RecursionError, IndexError, MemoryError) as e:
        return [{"tag": "error", "id": path, "file_path": path, "error": f"{type(e).__name__}: {e}"[:500]}]


#: Rows that go back to the JVM together.
ROWS_AT_ONCE = 2000


def _asked(rows: list[dict], labels, types) -> list[dict]:
    """The nodes of the labels, the edges of the types, the nodes at their ends, and errors."""
    kept = [r for r in rows if r["tag"] == "edge" and r["type"] in types]
    ends = {r[k] for r in kept for k in ("src_id", "dst_ref")}
    return kept + [r for r in rows if r["tag"] == "error" or r["tag"] == "node" and (r["label"] in labels or r["id"] in ends)]


def extract(files: DataFrame, labels: tuple | None = None, types: tuple | None = None) -> DataFrame:
    """Tagged rows (node, edge or error) of files(path, content). A file that can't be read gives one error row.

    With labels or types only the nodes and edges of these leave Python, and the nodes of its file at an edge's ends. A
    task holds the rows of one file and of one slice that goes back, however many files come to it together.
    """

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(kinds)

        def made(rows):
            values = {f.name: [r.get(f.name) for r in rows] for f in schema}
            values["props"] = [list((x or {}).items()) for x in values["props"]]
            return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) for f in schema], schema=schema)

        for b in batches:
            rows = []
            for path, content in zip(b.column("path"), b.column("content")):
                found = _extract_one(path.as_py(), content.as_py())
                rows += found if labels is None and types is None else _asked(found, labels or (), types or ())
                while len(rows) >= ROWS_AT_ONCE:
                    yield made(rows[:ROWS_AT_ONCE])
                    rows = rows[ROWS_AT_ONCE:]
            if rows:
                yield made(rows)

    kinds = StructType.fromDDL(_OUT)
    return files.select("path", "content").mapInArrow(run, _OUT)


def imports_of(nodes: DataFrame) -> DataFrame:
    """(src_id, dst_id): the files of the tree that a file's imports name, found by equal paths.

    Python: the module's path, or a name in it, below the importing file's folder or the nearest folder around it; dots
    go up. TypeScript: relative paths with the known extensions or as a folder's index. Go: all files of the folder that
    the longest end of the import's path names. Imports of what isn't in the tree give nothing.
    """
    files = nodes.where("label = 'File'").select(F.col("id").alias("dst_id"), "language", dirname(F.col("file_path")).alias("folder"))
    i = nodes.where("label = 'Import'").select(F.col("file_path").alias("src_id"), "language", F.col("props")["path"].alias("module"), F.col("props")["names"].alias("names"), dirname(F.col("file_path")).alias("folder"))
    i = i.where("module is not null").withColumn("folder", F.when(F.col("folder") == ".", "").otherwise(F.coalesce("folder", F.lit(""))))
    parts = F.filter(F.split("folder", "/"), lambda x: x != "")
    depth = F.size("parts")
    up = lambda k: F.array_join(F.slice("parts", F.lit(1), F.greatest(k, F.lit(0))), "/")
    below = lambda base, rest: F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))

    def first(asked: DataFrame) -> DataFrame:
        """Of each import's candidates (rank, path), the first that is a file."""
        found = asked.join(files.select(F.col("dst_id").alias("path"), "dst_id"), "path")
        return found.groupBy("src_id", "module", "name").agg(F.min(F.struct("rank", "dst_id")).alias("f")).select("src_id", F.col("f.dst_id").alias("dst_id"))

    py = i.where("language = 'python'").withColumn("parts", parts).withColumn("dots", F.length(F.regexp_extract("module", r"^\.*", 0)))
    py = py.withColumn("inner", F.replace(F.substr("module", F.col("dots") + 1), F.lit("."), F.lit("/")))
    py = py.withColumn("name", F.explode_outer(F.split("names", ",")))
    bases = F.when(F.col("dots") > 0, F.array(up(depth - F.col("dots") + 1))).otherwise(F.transform(F.sequence(depth, F.lit(0)), up))
    py = py.select("src_id", "module", F.coalesce("name", F.lit("")).alias("name"), "inner", F.posexplode(bases).alias("near", "base"))
    own = F.when(F.col("inner") == "", F.col("name")).otherwise(F.concat_ws("/", "inner", "name"))
    forms = F.array(F.when(F.col("name") != "", F.concat(own, F.lit(".py"))), F.when(F.col("inner") != "", F.concat("inner", F.lit(".py"))), F.when(F.col("name") != "", F.concat(own, F.lit("/__init__.py"))), F.concat_ws("/", F.nullif("inner", F.lit("")), F.lit("__init__.py")))
    py = py.select("src_id", "module", "name", "near", "base", F.posexplode(forms).alias("k", "form")).where("form is not null")
    py = py.select("src_id", "module", "name", (F.col("near") * 4 + F.col("k")).alias("rank"), below(F.col("base"), F.col("form")).alias("path"))

    ts = i.where("language in ('typescript', 'javascript')").select(F.col("src_id").alias("file_path"), "module")
    ts = L.modules(ts, files.select(F.col("dst_id").alias("file_path"))).select(F.col("file_path").alias("src_id"), F.col("to").alias("dst_id"))

    go = i.where("language = 'go'").withColumn("parts", F.split("module", "/"))
    go = go.select("src_id", "module", F.posexplode(F.transform(F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice("parts", k, depth), "/"))).alias("rank", "folder"))
    go = go.join(files.where("language = 'go'").select("folder", "dst_id"), "folder")
    nearest = go.groupBy("src_id", "module").agg(F.min("rank").alias("rank"))
    go = go.join(nearest, ["src_id", "module", "rank"]).select("src_id", "dst_id")
    return first(py).unionByName(ts).unionByName(go).where("src_id <> dst_id").distinct()


def once(rows: DataFrame) -> DataFrame:
    """rows with each node's and each edge's id once. Only ids are counted; whole rows are sorted only where some id is repeated."""
    rows = rows.where("tag in ('node', 'edge')")
    repeated = staged(rows.groupBy("tag", "id").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    if repeated.isEmpty():
        return rows
    same = repeated.select(F.col("tag").alias("_tag"), F.col("id").alias("_id"))
    on = (F.col("tag") == F.col("_tag")) & F.col("id").eqNullSafe(F.col("_id"))
    return rows.join(same, on, "left_anti").unionByName(rows.join(same, on, "left_semi").dropDuplicates(["tag", "id"]))


def graph_of(rows: DataFrame) -> tuple[Graph, DataFrame, DataFrame]:
    """(graph, rejected edges, errors) of extracted rows: names resolved, also through imports and re-exports; containment, imports, API calls to endpoints, interface satisfaction and indirect coverage derived.

    Nodes and edges are written once, so what is asked of the graph doesn't resolve it again. Interface satisfaction is
    held by classes and expanded where it is asked for.
    """
    given = once(rows)
    nodes = given.where("tag = 'node'").select(*[x for x in _NAMES if x in {c.split(" ")[0] for c in re.sub(r"map<string,string>", "map", NODE_DDL).split(", ")}])
    nodes = staged(conform(nodes, NODE_DDL), "nodes")
    raw = conform(given.where("tag = 'edge'"), RAW_EDGE_DDL)
    held = nodes.where("label <> 'File'").select("id", "label", "file_path")
    in_file = conform(held, EDGE_DDL, id=F.concat(F.lit("f:"), "id"), type=F.lit("Contains"), src_id=F.col("file_path"), dst_id=F.col("id"), src_label=F.lit("File"), dst_label=F.col("label"))
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("label").alias("src_label"))
    in_parent = nodes.where("parent_id is not null").select("id", "label", "parent_id", "file_path").join(parents, "parent_id")
    in_parent = conform(in_parent, EDGE_DDL, id=F.concat(F.lit("p:"), "id"), type=F.lit("Contains"), src_id=F.col("parent_id"), dst_id=F.col("id"), src_label=F.col("src_label"), dst_label=F.col("label"))
    linked = staged(L.placed(L.re_exports(raw, nodes), nodes), "references")
    importing = nodes.where("label = 'Import' and language in ('typescript', 'javascript') and name like '.%'")
    resolved, rejected = R.resolve(linked, nodes, bound=None if importing.isEmpty() else L.bindings(nodes, raw), unique=True)
    resolved, rejected = L.turned(resolved), rejected.where("not optional").drop("optional")
    imported = conform(imports_of(nodes), EDGE_DDL, id=F.concat(F.lit("m:"), "src_id", F.lit(":"), "dst_id"), type=F.lit("IMPORTS"), src_label=F.lit("File"), dst_label=F.lit("File"), file_path=F.col("src_id"))
    edges = staged(conform(resolved, EDGE_DDL).unionByName(in_file).unionByName(in_parent).unionByName(imported), "edges")
    asked = L.endpoint_calls(nodes, edges)
    asked = conform(asked, EDGE_DDL, id=F.concat_ws(":", F.lit("e"), "src_id", "dst_id", "method"), type=F.lit("CALLS_API"), dst_label=F.lit("Endpoint"), props=F.create_map(F.lit("api_endpoint"), F.col("url"), F.lit("http_method"), F.col("method")))
    own = nodes.where("label = 'Method' and receiver_type is not null and language = 'go'")
    structs = nodes.where("label = 'Struct'").select(F.col("name").alias("receiver_type"), F.col("id").alias("struct"))
    interfaces = nodes.where("label = 'Interface' and language = 'go'").select(F.col("id").alias("parent_id"), F.col("id").alias("interface"))
    classes = satisfied_classes(own.where("parent_id is null").join(structs, "receiver_type").select("struct", F.col("name").alias("method")), own.join(interfaces, "parent_id").select("interface", F.col("name").alias("method")))
    tests, calls = edges.where("type = 'TESTS'"), edges.where("type = 'CALLS'")
    labels = nodes.select(F.col("id").alias("dst_id"), F.col("label").alias("dst_label"))
    sources = nodes.select(F.col("id").alias("src_id"), F.col("label").alias("src_label"))
    through = indirect_covers(tests, calls).join(labels, "dst_id").join(sources, "src_id")
    through = conform(through, EDGE_DDL, id=F.concat(F.lit("c:"), "src_id", F.lit(":"), "dst_id"), type=F.lit("COVERS"), coverage_type=F.lit("indirect"))
    return BuiltGraph(nodes, edges.unionByName(staged(through.unionByName(asked), "edges")), classes), rejected, rows.where("tag = 'error'").select("file_path", "error")


def build_graph(spark: SparkSession, root: str, to: str | None = None) -> tuple[Graph, DataFrame, DataFrame]:
    """Scans, extracts once (the rows are written to the shared folder, or to `to`), resolves."""
    path = to or shared_dir(spark, "extracted")
    extract(scan(spark, root)).write.mode("overwrite").parquet(path)
    return graph_of(spark.read.parquet(path))


def contained(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(child, parent) of spans inside spans of the same file; columns id, file_path, start_byte, end_byte.

    A file's spans are swept in the order of their beginnings: a child is
    compared with the parents that have begun and not ended, which are as many
    as it has around it, and not with all of its file.
    """
    some = lambda df, k: df.where("id is not null and file_path is not null and start_byte <= end_byte").select("id", "file_path", "start_byte", "end_byte", F.lit(k).alias("inner"))

    def sweep(spans: pd.DataFrame) -> pd.DataFrame:
        # parents before children of one beginning, the longer first
        spans = spans.sort_values(["start_byte", "inner", "end_byte"], ascending=[True, True, False])
        open_, out = [], []
        for ident, a, b, inner in zip(spans["id"], spans["start_byte"].tolist(), spans["end_byte"].tolist(), spans["inner"].tolist()):
            open_ = [x for x in open_ if x[0] >= a]
            if inner:
                out += [(ident, p) for end, p in open_ if end >= b and p != ident]
            else:
                open_.append((b, ident))
        return pd.DataFrame(out, columns=["child", "parent"])

    return some(parents, 0).unionByName(some(children, 1)).groupBy("file_path").applyInPandas(sweep, "child string, parent string")


def clone(url: str, to: str) -> str:
    """A shallow clone by the installed git, on the driver."""
    import subprocess

    subprocess.run(["git", "clone", "--depth", "1", "--", url, to], check=True, timeout=600)
    return to
