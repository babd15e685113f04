"""The graph's labels, its edge schema, and the canonical columns of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: the property graph's schema
LABELS = (
    "File", "Function", "Class", "Method", "Variable", "Import", "Interface", "Struct", "Type", "Enum", "Property", "Export",
    "Decorator", "Generic", "Component", "Service", "Hook", "Namespace", "Module",
    "Endpoint", "Model", "Middleware", "Controller", "Route", "JSXElement", "APICall", "Prop",
    "TestFunction", "TestCase", "TestSuite", "Assertion", "Mock", "Fixture",
)
TEST_LABELS = ("TestFunction", "TestCase", "TestSuite", "Assertion", "Mock", "Fixture")

_CODE = ("Function", "Method")
_TESTS = ("TestFunction", "TestCase")
#: type: (allowed (sources, targets), properties)
EDGE_TYPES = {
    "Contains": (((("File",), ("Function", "Class", "Method", "Struct", "Interface", "Import", "Variable", "TestFunction", "TestCase", "TestSuite", "Assertion", "Mock", "Fixture")),), ()),
    "CALLS": (((_CODE, _CODE), (_TESTS, _CODE)), ()),
    "IMPORTS": (((("File",), ("File",)),), ()),
    "INHERITS": (((("Class",), ("Class",)),), ()),
    "EMBEDS": (((("Struct",), ("Struct",)),), ("source_id", "target_id")),
    "IMPLEMENTS": (((("Struct",), ("Interface",)),), ("source_id", "target_id")),
    "DEFINES": (((("Struct", "Interface"), ("Method",)),), ()),
    "USES": (((_CODE, ("Struct", "Interface")),), ()),
    "TESTS": (((_TESTS, (*_CODE, "Class")),), ("confidence_score",)),
    "COVERS": (((_TESTS, _CODE),), ("coverage_type",)),
    "MOCKS": ((((*_TESTS, "Mock"), _CODE),), ("mock_type",)),
    "SETUP_FOR": (((("TestFunction",), ("TestCase",)), (("Fixture",), _TESTS)), ()),
    "TEARDOWN_FOR": (((("TestFunction",), ("TestCase",)),), ()),
    "ASSERTS": (((_TESTS, ("Assertion",)),), ("assertion_type",)),
    "VERIFIES": (((_TESTS, _CODE),), ("verification_type",)),
    "SPIES": (((_TESTS, _CODE),), ("spy_type",)),
    "STUBS": (((_TESTS, _CODE),), ("stub_type",)),
    "FIXTURES": (((_TESTS, ("Fixture",)),), ("fixture_type",)),
    "RUNS_TEST": (((("TestSuite",), _TESTS),), ()),
    "GROUPS_TESTS": (((("TestSuite",), _TESTS),), ("group_type",)),
    "SKIPS": (((("TestFunction",), ("TestFunction",)), (("TestCase",), ("TestCase",))), ("skip_condition",)),
    "DEPENDS": (((("TestFunction",), ("TestFunction",)), (("TestCase",), ("TestCase",)), (_TESTS, ("Fixture",))), ("dependency_type",)),
    "RE_EXPORTS": (((("File",), ("File",)), (("Function",), ("Function",)), (("Class",), ("Class",))), ("export_name", "export_alias")),
    "DECORATES": (((("Function",), ("Class", "Method", "Function")),), ("decorator_name", "decorator_params")),
    "CONSTRAINS": (((("Interface",), ("Class", "Function")),), ("constraint_type",)),
    "DYNAMIC_IMPORT": (((_CODE, ("File",)),), ("import_type",)),
    "HAS_PROPS": (((("Class", "Interface"), ("Variable",)),), ("prop_type", "is_required")),
    "RENDERS_JSX": (((_CODE, ("Class",)),), ("jsx_type",)),
    "INJECTS": (((("Class",), ("Class",)), (("Function",), ("Variable",))), ("injection_type",)),
    "CONSUMES_SERVICE": (((("Class", "Function"), ("Class",)),), ("service_type",)),
    "HANDLES_ROUTE": (((_CODE, ("Variable",)),), ("route_path", "http_method")),
    "CALLS_API": (((_CODE, ("Function",)),), ("api_endpoint", "http_method")),
    "EXPOSES_ENDPOINT": (((_CODE, ("Variable",)),), ("endpoint_path", "endpoint_type")),
    "USES_MIDDLEWARE": (((("Function", "Class"), ("Function",)),), ("middleware_type",)),
}
#: Labels that a name may resolve to, by edge type, in order of preference; types not named take any label.
EXPECTED = {
    "CALLS": ("Function", "Method", "TestFunction"),
    "USES": ("Struct", "Interface", "Class"),
    "EMBEDS": ("Struct", "Interface", "Class"),
    "IMPLEMENTS": ("Struct", "Interface", "Class"),
    "INHERITS": ("Class", "Interface", "Struct"),
    "TESTS": ("Function", "Method", "Class"),
    "COVERS": ("Function", "Method", "Class"),
    "MOCKS": ("Function", "Method", "Class"),
    "SPIES": ("Function", "Method", "Class"),
    "STUBS": ("Function", "Method", "Class"),
    "VERIFIES": ("Function", "Method", "Class"),
}
# ---- end of fixed values

#: Pairs that the fixed ones leave out though the relation is documented between these kinds of entities: what a scanner
#: finds for them is an element, a property, an endpoint or a decorator's mark with a node of its own, or a file for code
#: outside of functions. type: allowed (sources, targets).
ADDED_PAIRS = {
    "DECORATES": (("Decorator",), ("Class", "Method", "Function")),
    "HAS_PROPS": (("Interface",), ("Property", "Prop")),
    "RENDERS_JSX": (_CODE, ("JSXElement", "Function")),
    "EXPOSES_ENDPOINT": ((*_CODE, "File"), ("Endpoint",)),
    "HANDLES_ROUTE": ((*_CODE, "Class"), ("Endpoint", "Route")),
    "USES_MIDDLEWARE": ((*_CODE, "Class", "File", "Endpoint"), ("Middleware", "Function")),
    "CALLS_API": ((*_CODE, *_TESTS), ("APICall", "Endpoint")),
    "INJECTS": (("Class",), ("Interface",)),
    "CONSUMES_SERVICE": (("Method",), ("Class",)),
}
#: Labels that a name may resolve to for these types, in order of preference, besides EXPECTED.
ADDED_EXPECTED = {"RENDERS_JSX": ("Function", "Class"), "TESTS_COMPONENT": ("Function", "Class"), "USES_MIDDLEWARE": ("Function", "Method"), "DECORATES": ("Function",), "INJECTS": ("Class", "Interface"), "CONSUMES_SERVICE": ("Class",), "DECORATED_BY": ("Function",), "EXPOSED_BY": ("Function", "Method")}

NODE_DDL = (
    "id string, label string, name string, file_path string, signature string, body string, doc_string string, start_byte bigint, end_byte bigint, line_number int, "
    "language string, is_test boolean, is_test_file boolean, receiver_type string, type_definition string, test_type string, test_target string, test_framework string, "
    "assertion_count bigint, test_count bigint, decorators array<string>, is_exported boolean, complexity int, parent_id string, props map<string,string>"
)
EDGE_DDL = (
    "id string, type string, src_id string, dst_id string, src_label string, dst_label string, confidence_score double, coverage_type string, "
    "file_path string, start_byte bigint, end_byte bigint, props map<string,string>"
)
RAW_EDGE_DDL = "id string, type string, src_id string, dst_ref string, confidence_score double, coverage_type string, file_path string, start_byte bigint, end_byte bigint, props map<string,string>"


def _columns(ddl: str) -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ", 1)) for x in ddl.replace("map<string,string>", "map<string;string>").split(",")]


def conform(df: DataFrame, ddl: str, **values: Column) -> DataFrame:
    """df as rows of a canonical table: values by column name; a column neither given nor in df is null, flags are false."""
    out = []
    for name, kind in _columns(ddl):
        kind = kind.replace(";", ",")
        if name in values:
            c = values[name]
        elif name in df.columns:
            c = F.col(name)
        else:
            c = F.lit(False if kind == "boolean" else None)
        out.append(c.cast(kind).alias(name))
    return df.select(*out)


def connections(kind: str) -> list[tuple[str, str]]:
    """The allowed (source, target) labels of an edge type."""
    return [(s, d) for sources, targets in EDGE_TYPES[kind][0] for s in sources for d in targets]


def edge_schema(spark: SparkSession) -> DataFrame:
    """(type, src_label, dst_label, props): one row for each allowed pair; bounded by the fixed schema above."""
    return spark.createDataFrame([(t, s, d, list(EDGE_TYPES[t][1])) for t in EDGE_TYPES for s, d in connections(t)], "type string, src_label string, dst_label string, props array<string>")


def allowed_pairs(spark: SparkSession) -> DataFrame:
    """(type, src_label, dst_label): the fixed pairs and the added ones; bounded by the tables above."""
    added = {(t, s, d) for t, (sources, targets) in ADDED_PAIRS.items() for s in sources for d in targets}
    pairs = sorted(added | {(t, s, d) for t in EDGE_TYPES for s, d in connections(t)})
    # as values in SQL: rows of Python objects would start a Python worker beside each task's own
    return spark.sql("select * from values " + ", ".join(map(str, pairs)) + " as v(type, src_label, dst_label)")


def label_ranks(spark: SparkSession) -> DataFrame:
    """(type, label, label_rank) for the edge types that expect labels."""
    return spark.createDataFrame([(t, x, i) for t, xs in EXPECTED.items() for i, x in enumerate(xs)], "type string, label string, label_rank int")
