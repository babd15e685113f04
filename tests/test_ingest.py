"""Extraction from small source trees written for these tests."""

import pytest

from loomgraph.sources import go_code, ingest, python_code, ts_code

PY = '''"""Shapes."""
import math
from os import path as p, sep

LIMIT: int = 3
a, b = 1, 2


class Shape(Base):
    """A shape."""

    def area(self) -> float:
        return self.scale(1)

    @staticmethod
    def scale(x):
        if x:
            return helper(x)


def helper(x, *, y=2):
    """Helps."""

    def inner():
        return math.sqrt(x)

    return inner()
'''
PY_TEST = '''import pytest
from shapes import helper


@pytest.fixture
def box():
    return 1


def test_helper():
    assert helper(2) == 2
    with pytest.raises(ValueError):
        helper(None)


class TestShape:
    def test_integration_area(self):
        self.assertEqual(area(), 1)
'''
GO = '''package store

import (
	"fmt"
	log "example.com/log"
)

// Saver saves.
type Saver interface {
	Save(x int) error
	Close() error
}

type Base struct{ N int }

type Disk struct {
	Base
	path, name string `json:"p"`
}

type Old = Disk

// Save writes "func fake() {" nowhere.
func (d *Disk) Save(x int) error {
	// func hidden() { }
	return write(d.path, x)
}

func (d *Disk) Close() error { return nil }

func write[T int | ~string](p string, x T) error {
	jobs := make(chan T, 10)
	go worker(jobs)
	jobs <- x
	if p == "" && true {
		fmt.Println("}")
	}
	return nil
}

func worker(jobs <-chan int) {
	for {
		select {
		case j := <-jobs:
			_ = j
		}
	}
}
'''
GO_TEST = '''package store

import "testing"

func TestWrite(t *testing.T) {
	t.Parallel()
	if write("a", 1) != nil {
		t.Fatal("no")
	}
}

func BenchmarkSave(b *testing.B) {}
func helperInTest() {}
'''
TS = '''import React, { useState } from 'react';
import type { User } from "./types";
export { helper } from './util';

export interface CardProps { title: string; size?: number }
interface Wide<T extends object> extends CardProps, Other {}
type Maybe<T> = T extends null ? never : T;
export enum Color { Red, Green }

@Injectable()
export class UserService extends BaseService implements Loader<User>, Saver {
  constructor(private http: HttpClient) {}
  async load(id: string): Promise<User> {
    const r = await fetch('/api/users');
    return this.parse(r);
  }
  parse(r) { return r; }
}

export function Card({ title }: CardProps) {
  const [open, setOpen] = useState(false);
  return <Panel title={title} wide><Button /></Panel>;
}
export const useThing = async (x: number) => { return Card(x); };
app.get('/users', listUsers);
app.use(cors());
'''
TS_TEST = '''import { helper } from '../util';
describe('util', () => {
  beforeEach(() => { setup(); });
  describe('inner', () => {
    it('should return one', async () => {
      const spy = jest.spyOn(api, 'get');
      expect(helper(1)).not.toBe(2);
    });
    it.skip('api call', () => { expect(other()).toEqual(1); expect(1).toBe(1); });
  });
  it.each([1, 2])('renders %s', () => { render(<Card a="1" />); });
});
'''


def nodes(rows, *labels):
    return {(r["label"], r["name"]): r for r in rows if r["tag"] == "node" and (not labels or r["label"] in labels)}


def edges(rows, kind):
    names = {r["id"]: r["name"] for r in rows if r["tag"] == "node"}
    return {(names.get(r["src_id"], r["src_id"]), names.get(r["dst_ref"], r["dst_ref"])) for r in rows if r["tag"] == "edge" and r["type"] == kind}


def test_python():
    rows = python_code.extract("lib/shapes.py", PY)
    n = nodes(rows)
    assert set(n) == {("File", "shapes.py"), ("Import", "math"), ("Import", "os"), ("Variable", "LIMIT"), ("Variable", "a"), ("Variable", "b"), ("Class", "Shape"), ("Method", "area"), ("Method", "scale"), ("Function", "helper"), ("Function", "inner")}
    f = n["Function", "helper"]
    assert (f["signature"], f["doc_string"], f["line_number"]) == ("(x, *, y=2)", "Helps.", 21)
    assert PY[f["start_byte"] : f["end_byte"]] == f["body"] and f["body"].endswith("return inner()")
    assert n["Method", "area"]["props"]["return_type"] == "float" and n["Method", "scale"]["decorators"] == ["@staticmethod"]
    assert n["Variable", "LIMIT"]["type_definition"] == "int" and n["Import", "os"]["props"]["alias"] == "p"
    assert edges(rows, "CALLS") == {("area", "Shape.scale"), ("scale", "helper"), ("helper", "inner"), ("inner", "math.sqrt")}
    assert edges(rows, "INHERITS") == {("Shape", "Base")}


def test_python_tests():
    rows = python_code.extract("tests/test_shapes.py", PY_TEST)
    n = nodes(rows, "TestFunction", "Function")
    t = n["TestFunction", "test_helper"]
    assert (t["test_framework"], t["test_type"], t["test_target"], t["assertion_count"], t["is_test"]) == ("pytest", "unit", "helper", 2, True)
    assert n["TestFunction", "test_integration_area"]["test_type"] == "integration"
    assert ("Function", "box") in n
    assert edges(rows, "TESTS") == {("test_helper", "helper"), ("test_integration_area", "area")}


def test_go():
    rows = go_code.extract("store/disk.go", GO)
    n = nodes(rows, "File", "Function", "Method", "Struct", "Interface", "Class", "Import", "Property", "Generic")
    assert {k for k in n if k[0] in ("Function", "Method", "Struct", "Interface", "Class", "Import")} == {
        ("Function", "write"), ("Function", "worker"), ("Method", "Save"), ("Method", "Close"), ("Struct", "Base"), ("Struct", "Disk"), ("Interface", "Saver"), ("Class", "Old"), ("Import", "fmt"), ("Import", "example.com/log"),
    }
    assert n["File", "disk.go"]["props"]["package"] == "store"
    save = [r for r in rows if r.get("name") == "Save" and r["tag"] == "node"]
    assert {(r["receiver_type"], r.get("parent_id") is None) for r in save} == {("Disk", True), ("Saver", False)}
    assert n["Import", "example.com/log"]["props"]["alias"] == "log" and n["Generic", "T"]["props"]["union"] == "True"
    assert edges(rows, "EMBEDS") == {("Disk", "Base")}
    calls = edges(rows, "CALLS")
    assert {("Save", "write"), ("write", "worker"), ("write", "fmt.Println")} <= calls and not any(b == "hidden" for _, b in calls)
    assert {r["name"] for r in rows if r.get("props", {}).get("kind") == "channel" and r["label"] == "Variable"} == {"jobs"}
    assert n["Function", "write"]["complexity"] == 3


def test_go_tests():
    rows = go_code.extract("store/disk_test.go", GO_TEST)
    n = nodes(rows)
    t = n["TestFunction", "TestWrite"]
    assert (t["test_type"], t["test_target"], t["assertion_count"], t["props"]["parallel"]) == ("unit", "Write", 1, "true")
    assert n["TestFunction", "BenchmarkSave"]["test_type"] == "benchmark" and ("Function", "helperInTest") in n
    assert edges(rows, "TESTS") == {("TestWrite", "write")}


def test_typescript():
    rows = ts_code.extract("web/card.tsx", TS)
    n = nodes(rows)
    have = {k for k in n if k[0] in ("Function", "Method", "Class", "Interface", "Type", "Enum", "Import", "Component", "Hook", "Service", "Endpoint", "Middleware", "APICall", "Prop", "JSXElement", "Export")}
    assert have == {
        ("Function", "Card"), ("Function", "useThing"), ("Method", "constructor"), ("Method", "load"), ("Method", "parse"), ("Class", "UserService"), ("Interface", "CardProps"), ("Interface", "Wide"), ("Type", "Maybe"), ("Enum", "Color"),
        ("Import", "react"), ("Import", "./types"), ("Component", "Card"), ("Hook", "useThing"), ("Service", "UserService"), ("Endpoint", "/users"), ("Middleware", "cors"), ("APICall", "fetch"), ("Prop", "title"), ("Prop", "size"),
        ("JSXElement", "Panel"), ("JSXElement", "Button"), ("Export", "./util"),
    }
    assert n["Import", "./types"]["props"]["type_only"] == "True" and n["Import", "react"]["props"]["names"] == "useState" and n["Import", "react"]["props"]["default"] == "React"
    assert edges(rows, "INHERITS") == {("UserService", "BaseService"), ("Wide", "CardProps"), ("Wide", "Other")}
    assert edges(rows, "IMPLEMENTS") == {("UserService", "Loader"), ("UserService", "Saver")}
    assert edges(rows, "RENDERS_JSX") == {("Card", "Panel"), ("Card", "Button")}
    assert {("load", "fetch"), ("load", "parse"), ("useThing", "Card"), ("Card", "useState")} <= edges(rows, "CALLS")
    assert edges(rows, "INJECTS") == {("UserService", "HttpClient")} and ("load", "/api/users") in edges(rows, "CALLS_API")
    assert n["Method", "load"]["props"]["async"] == "True" and n["Class", "UserService"]["decorators"] == ["@Injectable"]
    assert n["Type", "Maybe"]["props"]["conditional"] == "True"


def test_typescript_frameworks():
    rows = ts_code.extract("web/app.ts", "const Box = defineComponent({});\nconst C = createContext(null);\nconst routes = [{ path: 'home', component: HomePage }];\nconst q = gql`query Users { id }`;\nexport namespace Shapes { }\ndeclare module 'm' { }\n")
    n = nodes(rows)
    assert n["Component", "Box"]["props"]["framework"] == "vue" and ("Hook", "createContext") in n and n["Route", "home"]["props"]["component"] == "HomePage"
    assert n["APICall", "Users"]["props"]["library"] == "graphql" and ("Namespace", "Shapes") in n and n["Module", "m"]["props"]["ambient"] == "True"


def test_typescript_tests():
    rows = ts_code.extract("web/util.test.ts", TS_TEST)
    n = nodes(rows)
    assert {k for k in n if k[0] in ("TestSuite", "TestCase", "Fixture")} == {("TestSuite", "util"), ("TestSuite", "inner"), ("TestCase", "should return one"), ("TestCase", "api call"), ("TestCase", "renders %s"), ("Fixture", "beforeEach")}
    assert n["TestSuite", "util"]["test_count"] == 3 and n["TestCase", "api call"]["assertion_count"] == 2
    assert n["TestCase", "api call"]["props"]["skip"] == "True" and n["TestCase", "should return one"]["props"]["async"] == "True"
    assert edges(rows, "RUNS_TEST") == {("inner", "should return one"), ("inner", "api call"), ("util", "renders %s")} and edges(rows, "GROUPS_TESTS") == {("util", "inner")}
    assert ("should return one", "helper") in edges(rows, "TESTS") and edges(rows, "TESTS_COMPONENT") == {("renders %s", "Card")}
    assert edges(rows, "MOCKS") == {("should return one", "get")} or edges(rows, "MOCKS") == {("should return one", "api")}
    a = [r for r in rows if r.get("label") == "Assertion"]
    assert {(r["name"], r["props"].get("negated")) for r in a} == {("toBe", "True"), ("toEqual", None), ("toBe", None)}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in {"lib/shapes.py": PY, "tests/test_shapes.py": PY_TEST, "store/disk.go": GO, "store/disk_test.go": GO_TEST, "web/card.tsx": TS, "web/util.test.ts": TS_TEST, "node_modules/x.js": "function x() {}", "lib/broken.py": "def (", "notes.txt": "x"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "lib/bytes.py").write_bytes(b"\xff\xfe\x00")
    return ingest.build_graph(spark, str(root))


def test_build_graph(spark, built):
    g, rejected, errors = built
    assert {r.file_path for r in errors.collect()} == {"lib/broken.py", "lib/bytes.py"}
    assert g.nodes.count() == g.nodes.select("id").distinct().count()
    names = {r.id: r.name for r in g.nodes.collect()}
    pairs = lambda t, **w: {(names[r.src_id], names[r.dst_id]) for r in g.rel(t).collect() if all(r[k] == v for k, v in w.items())}
    assert {("area", "scale"), ("scale", "helper"), ("Save", "write"), ("write", "worker"), ("useThing", "Card")} <= pairs("CALLS")
    assert ("TestWrite", "write") in pairs("TESTS") and ("test_helper", "helper") in pairs("TESTS")
    assert pairs("IMPLEMENTS") == {("Disk", "Saver")} and pairs("EMBEDS") == {("Disk", "Base")}
    assert ("TestWrite", "worker") in pairs("COVERS", coverage_type="indirect")
    assert {("shapes.py", "Shape"), ("Shape", "area"), ("disk.go", "Save")} <= pairs("Contains")
    reasons = {r.reason for r in rejected.select("reason").distinct().collect()}
    assert reasons <= {"failed to resolve target", "schema violation", "failed to resolve source"}


def test_graph_at_rest_and_views(spark, built, tmp_path):
    g = built[0]
    g.write(str(tmp_path / "g"))
    back = type(g).read(spark, str(tmp_path / "g"))
    assert back.nodes.count() == g.nodes.count()
    assert back.edges.select("type", "src_id", "dst_id").distinct().count() == back.edges.count()
    back.create_views("t_")
    assert spark.sql("select count(*) from t_Function").first()[0] == g.scan("Function").count()


def test_containment(spark):
    c = spark.createDataFrame([("a", "f", 5, 9), ("b", "f", 0, 20), ("c", "g", 5, 9)], "id string, file_path string, start_byte int, end_byte int")
    assert {tuple(r) for r in ingest.contained(c, c).collect()} == {("a", "b")}


def test_imports_are_found_by_path(spark, tmp_path):
    tree = {
        "app/main.py": "import app.util\nfrom . import helper\nfrom .sub import thing, other\nimport os\nfrom lib import deep\n", "app/util.py": "", "app/helper.py": "", "app/sub/__init__.py": "", "app/sub/thing.py": "", "lib/__init__.py": "", "app/lib/deep.py": "",
        "web/a.ts": "import x from './b';\nimport { y } from '../shared';\nimport z from 'react';\n", "web/b.tsx": "", "shared/index.js": "", "go/main.go": 'package main\nimport (\n\t"fmt"\n\t"example.com/proj/go/store"\n)\n', "go/store/a.go": "package store\n", "go/store/b.go": "package store\n",
    }
    for path, content in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content or "\n")
    g, _, _ = ingest.build_graph(spark, str(tmp_path))
    got = {(r.src_id, r.dst_id) for r in g.rel("IMPORTS").collect()}
    assert got == {
        ("app/main.py", "app/util.py"), ("app/main.py", "app/helper.py"), ("app/main.py", "app/sub/thing.py"), ("app/main.py", "app/sub/__init__.py"), ("app/main.py", "app/lib/deep.py"),
        ("web/a.ts", "web/b.tsx"), ("web/a.ts", "shared/index.js"), ("go/main.go", "go/store/a.go"), ("go/main.go", "go/store/b.go"),
    }


def test_innermost_spans():
    import random

    from loomgraph.sources.collect import Spans

    rnd = random.Random(4)
    spans, rows = Spans(), []

    def nest(a, z, depth):
        if z - a > 3 and depth < 7:
            rows.append((a, z, f"{a}:{z}:{depth}"))
            m = rnd.randint(a + 1, z - 1)
            nest(a + 1, m, depth + 1)
            nest(m, z - 1, depth + 1)

    nest(0, 4000, 0)
    rnd.shuffle(rows)
    for k, r in enumerate(rows):
        spans.add(*r)
        at = rnd.randrange(4100)
        around = [x for x in rows[: k + 1] if x[0] <= at < x[1]]
        assert spans.innermost(at) == (min(around, key=lambda x: x[1] - x[0])[2] if around else None)


def test_bytes_of_other_alphabets():
    text = "a = 'é日🙂'\ndef f():\n    pass\n"
    f = next(r for r in python_code.extract("x.py", text) if r.get("name") == "f")
    assert text.encode()[f["start_byte"] : f["end_byte"]].decode() == "def f():\n    pass"


def test_long_parent_chains_and_circles(spark):
    from loomgraph.operators import resolve

    rows = [(f"n{i}", f"x{i}", f"n{i - 1}" if i else None, "d/f.py") for i in range(41)]
    nodes = spark.createDataFrame(rows, "id string, name string, parent_id string, file_path string")
    got = {r.id: r.qualified for r in resolve.qualified_names(nodes).collect()}
    assert got["n40"] == "d." + ".".join(f"x{i}" for i in range(41)) and got["n0"] == "d.x0"
    with pytest.raises(ValueError, match="own parents"):
        resolve.qualified_names(spark.createDataFrame([("a", "a", "b", "f"), ("b", "b", "a", "f")], nodes.schema)).collect()


TS_SERVER = """
import express from 'express';
const app = express();
export function listUsers(req, res) { return res.json(1); }
export function requireLogin(req, res, next) { next(); }
function setup() {
  app.use(requireLogin);
  app.get('/users', requireLogin, listUsers);
  app.post('/users', requireLogin, (req, res) => res.json(2));
}
export class UserService {
  load() { return fetch('/users', { method: 'POST' }); }
  plain() { return 1; }
}
export class Page {
  constructor(private users: UserService) {}
  render() { return new AuditAPI(); }
}
export function Card({ title }: CardProps) { return <Box/>; }
const routes = [{ path: 'home', component: Page }];
"""


def test_routes_middleware_and_services():
    rows = ts_code.extract("server.tsx", TS_SERVER)
    name = {r["id"]: r["name"] for r in rows if r["tag"] == "node"}
    edges = {(r["type"], name.get(r["src_id"]), name.get(r["dst_ref"], r["dst_ref"])) for r in rows if r["tag"] == "edge"}
    assert {e for e in edges if e[0] in ("HANDLES_ROUTE", "USES_MIDDLEWARE", "CONSUMES_SERVICE", "EXPOSES_ENDPOINT")} == {
        ("HANDLES_ROUTE", "listUsers", "/users"), ("EXPOSES_ENDPOINT", "listUsers", "/users"), ("EXPOSES_ENDPOINT", "server.tsx", "/users"), ("HANDLES_ROUTE", "Page", "home"), ("USES_MIDDLEWARE", "/users", "requireLogin"), ("USES_MIDDLEWARE", "setup", "requireLogin"),
        ("CONSUMES_SERVICE", "Page", "UserService"), ("CONSUMES_SERVICE", "render", "AuditAPI"),
    }
    assert ("USES", "Card", "CardProps") in edges
    service = next(r for r in rows if r.get("label") == "Service")
    assert service["props"]["api_methods"] == "load"
    assert next(r for r in rows if r.get("label") == "APICall")["props"]["method"] == "POST"


def test_go_methods_and_instances():
    rows = go_code.extract("s.go", "package s\n\ntype Box[T any] struct{ v T }\n\nfunc (b *Box[T]) Get() T { return b.v }\n\ntype Getter interface {\n\tGet() int\n}\n\nfunc Make() {\n\tb := Box[int]{v: 1}\n\tc := Pair[string, *Box]()\n\t_ = xs[i]\n}\n")
    name = {r["id"]: r["name"] for r in rows if r["tag"] == "node"}
    edges = [(r["type"], name.get(r["src_id"]), name.get(r["dst_ref"], r["dst_ref"]), r["props"].get("type_arguments")) for r in rows if r["tag"] == "edge"]
    assert {e[:3] for e in edges if e[0] == "DEFINES"} == {("DEFINES", "Box", "Get"), ("DEFINES", "Getter", "Get")}
    assert {e for e in edges if e[3]} == {("USES", "Make", "Box", "int"), ("USES", "Make", "Pair", "string, *Box")}
