"""Exported names, bindings and modules against what the language says."""

import pytest

from loomgraph.schema import NODE_DDL, RAW_EDGE_DDL, conform
from loomgraph.sources import ingest, linking
from loomgraph.sources.folders import staged

FILES = {
    "lib/a.ts": "export function one() { return 1; }\nfunction hidden() { return 2; }\nexport { hidden as shown };\nexport default class Main { run() { return 3; } }\n",
    "lib/b.ts": "export * from './a';\nexport function one() { return 4; }\n",
    "lib/c.ts": "export * from './d';\nexport { shown as again, default as Base } from './a';\n",
    "lib/d.ts": "export * from './c';\nexport * as ns from './a';\nexport const two = () => { return 5; };\n",
    "lib/index.ts": "export * from './b';\nexport { one as first } from './a';\nexport { gone } from './nowhere';\n",
    "use.ts": "import { one, first, again as more } from './lib';\nimport Main from './lib/a';\nimport * as all from './lib/c';\nimport { one as other } from 'package';\n"
    "export function use() { one(); first(); all.two(); all.again(); all.none(); other(); Main(); }\n",
}


@pytest.fixture(scope="module")
def read(spark):
    rows = staged(ingest.extract(spark.createDataFrame(list(FILES.items()), "path string, content string")), "rows")
    return conform(rows.where("tag = 'node'"), NODE_DDL), conform(rows.where("tag = 'edge'"), RAW_EDGE_DDL)


def test_exported_names(spark, read):
    nodes, raw = read
    place = {r.id: (r.file_path, r.name) for r in nodes.collect()}
    got = {}
    for r in linking.exported(nodes, raw).collect():
        assert (r.file_path, r.name) not in got
        got[r.file_path, r.name] = place[r.id]
    a = {"one": ("lib/a.ts", "one"), "shown": ("lib/a.ts", "hidden"), "default": ("lib/a.ts", "Main"), "Main": ("lib/a.ts", "Main")}
    of = lambda path: {n: x for (p, n), x in got.items() if p == path}
    assert of("lib/a.ts") == a
    # its own name before the star's; a star gives no default
    assert of("lib/b.ts") == {"one": ("lib/b.ts", "one"), "shown": a["shown"], "Main": a["Main"]}
    ring = {"again": a["shown"], "Base": a["default"], "two": ("lib/d.ts", "two")}
    assert of("lib/c.ts") == ring and of("lib/d.ts") == ring
    assert of("lib/index.ts") == {"one": ("lib/b.ts", "one"), "shown": a["shown"], "Main": a["Main"], "first": a["one"]}


def test_bindings(spark, read):
    nodes, raw = read
    place = {r.id: (r.file_path, r.name) for r in nodes.collect()}
    got = {r.ref: place[r.id] for r in linking.bindings(nodes, raw).where("file_path = 'use.ts'").collect()}
    assert got == {"one": ("lib/b.ts", "one"), "first": ("lib/a.ts", "one"), "all.two": ("lib/d.ts", "two"), "all.again": ("lib/a.ts", "hidden"), "Main": ("lib/a.ts", "Main")}


def test_modules(spark):
    files = spark.createDataFrame([("x/a.ts",), ("x/index.tsx",), ("b.js",)], "file_path string")
    asked = spark.createDataFrame([("x/y/z.ts", "../a"), ("x/a.ts", "."), ("q.ts", "./x"), ("x/a.ts", "../b"), ("q.ts", "./b.js"), ("q.ts", "react"), ("q.ts", "./none"), ("q.ts", None)], "file_path string, module string")
    got = {(r.file_path, r.module): r.to for r in linking.modules(asked, files).collect()}
    assert got == {("x/y/z.ts", "../a"): "x/a.ts", ("x/a.ts", "."): "x/index.tsx", ("q.ts", "./x"): "x/index.tsx", ("x/a.ts", "../b"): "b.js", ("q.ts", "./b.js"): "b.js"}


def test_relations_of_the_built_graph_are_not_rejected(spark):
    text = "import { Ext } from 'ext';\n@Mark()\nexport class C {}\napp.use(helmet());\napp.get('/x/:id', ensure, (q, r) => 1);\nfunction v() { return <Ext a=\"1\"/>; }\nfunction f() { return axios.get('/none'); }\ninterface P { a: string }\n"
    rows = staged(ingest.extract(spark.createDataFrame([("s.tsx", text)], "path string, content string")), "rows")
    g, rejected, errors = ingest.graph_of(rows)
    kinds = ("DECORATES", "USES_MIDDLEWARE", "EXPOSES_ENDPOINT", "RENDERS_JSX", "CALLS_API", "HAS_PROPS")
    found = {(r.type, r.src_label, r.dst_label) for r in g.rel(*kinds).collect()}
    assert found == {
        ("DECORATES", "Decorator", "Class"), ("USES_MIDDLEWARE", "File", "Middleware"), ("USES_MIDDLEWARE", "Endpoint", "Middleware"), ("EXPOSES_ENDPOINT", "File", "Endpoint"),
        ("RENDERS_JSX", "Function", "JSXElement"), ("CALLS_API", "Function", "APICall"), ("HAS_PROPS", "Interface", "Property"),
    }
    assert not {r.type for r in rejected.collect()} & set(kinds) and errors.count() == 0
