"""The extractors as a table function of SQL, to which users add languages of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..schema import NODE_DDL, RAW_EDGE_DDL, _columns
from .ingest import ROW_DDL, _extract_one

#: What the function gives, by its option what: nodes, edges, errors, or all as tagged rows.
SHAPES = {"nodes": ("node", NODE_DDL), "edges": ("edge", RAW_EDGE_DDL), "errors": ("error", "file_path string, error string"), "rows": (None, ROW_DDL)}
#: The types of these shapes; a function is analysed where no session is, so Spark's parser isn't there.
TYPES = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "boolean": BooleanType(), "double": DoubleType(), "array<string>": ArrayType(StringType()), "map<string,string>": MapType(StringType(), StringType())}
FLAGS = {"is_test", "is_test_file", "is_exported"}


def shape(what: str) -> StructType:
    if what not in SHAPES:
        raise ValueError(f"what is one of {', '.join(SHAPES)}")
    out = StructType()
    for name, kind in _columns(SHAPES[what][1]):
        out.add(name, TYPES[kind.replace(";", ",")])
    return out


def rows_of(path: str, content: str | None, what: str, languages: dict[str, Callable]) -> list[dict]:
    """The rows of one file. A null path has none; a file of no known language has none; one that can't be read gives one error row."""
    from ..functions.test_rules import EXTENSIONS

    if path is None:
        return []
    extension = path[path.rfind(".") :].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension not in languages and extension not in EXTENSIONS:
        return []
    tag = SHAPES[what][0]
    rows = _extract_one(path, content, languages.get(extension))
    return [r for r in rows if tag is None or r["tag"] == tag]


def table_function(languages: dict[str, Callable] | None = None):
    """A UDTF of (path, content, what); languages: extension, with its dot, to a function (path, content) that gives rows as Rows collects them."""
    known = dict(languages or {})

    class ExtractCode:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument, what: AnalyzeArgument | None = None) -> AnalyzeResult:
            if what is not None and not what.isConstantExpression:
                raise ValueError("what must be a constant")
            return AnalyzeResult(shape("rows" if what is None or what.value is None else what.value))

        def eval(self, path: str, content: str, what: str = "rows"):
            names = shape(what or "rows").fieldNames()
            for r in rows_of(path, content, what or "rows", known):
                yield tuple(r.get(n, (r.get("props") or {}) if n == "props" else False if n in FLAGS and r["tag"] == "node" else None) for n in names)

    return udtf(ExtractCode)


def register(spark: SparkSession, name: str = "extract_code", languages: dict[str, Callable] | None = None) -> None:
    """After it, select t.* from files f, lateral extract_code(f.path, f.content, what => 'nodes') t"""
    spark.udtf.register(name, table_function(languages))
