"""The extractors and what is built on them, over source trees made from the supplier table.

Each supplier n gives one file of each kind; {h}, {r} and {c} are n modulo 7, 3
and 4. The SQL states what a reader finds in such a file, line by line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.patterns import hop, pairs
from ..sources import ingest
from . import crosslang, introspect
from .binding import load
from .registry import query

FILES = {
    "py": ("src/py/m{r}/mod{n}.py", '''import os
from pkg.util import helper{h} as h

LIMIT_{n}: int = {n}


class Base{n}(Root{r}):
    """Doc {n}."""

    def area(self, x) -> float:
        return self.scale(x) + h({n})

    @staticmethod
    def scale(y):
        if y and y > {n}:
            return y
        return 0


async def run_{n}(a, *, b=2):
    """Runs {n}."""
    return compute_{c}(a)


@app.route('/py/{n}', methods=['PUT', 'POST'])
def put_{n}():
    return requests.get('http://go.example/go/{n}?x=1')
'''),
    "py_test": ("tests/py/test_mod{n}.py", '''import pytest
from unittest import mock
from mod{n} import run_{n}


@pytest.mark.parametrize("v", [1])
def test_run_{n}():
    assert run_{n}(1) == 2
    with pytest.raises(ValueError):
        compute_{c}(None)


class TestBase{n}:
    def test_integration_area(self):
        self.assertEqual(area({n}), 1)
'''),
    "go": ("src/go/s{r}/disk{n}.go", '''package store{r}

import (
	"fmt"
	u "example.com/lib{c}"
)

// Saver{n} saves.
type Saver{n} interface {
	Save(x int) error
	Close() error
}

type Base{n} struct{ N int }

type Disk{n} struct {
	Base{n}
	path, name string
}

// Save stores.
func (d *Disk{n}) Save(x int) error {
	return write{n}(d.path, x)
}

func (d *Disk{n}) Close() error { return nil }

func write{n}[T int | ~string](p string, x T) error {
	jobs := make(chan T, {n})
	go worker{n}(jobs)
	jobs <- x
	if p == "" && true {
		fmt.Println(p)
	}
	b := Box[int]{}
	return u.Check(b)
}

func worker{n}(jobs <-chan int) {
	for {
		select {
		case j := <-jobs:
			_ = j
		}
	}
}

func Routes{n}(r Router) {
	r.GET("/go/{n}", list)
	http.Post("http://ts.example/ts/{n}", "text/plain", nil)
}
'''),
    "go_pool": ("src/go/s{r}/pool{n}.go", '''package pool{r}

func feed{n}(in chan int, out chan int) {
	go left{n}(in)
	go right{n}(in)
	in <- {n}
	v := <-out
	extra <- v
}

func left{n}(in chan int) {
	x := <-in
	out <- x
}

func right{n}(in chan int) {
	y := <-in
	out <- y
}
'''),
    "go_test": ("src/go/s{r}/disk{n}_test.go", '''package store{r}

import "testing"

func TestWrite{n}(t *testing.T) {
	t.Parallel()
	if write{n}("a", 1) != nil {
		t.Fatal("no")
	}
}

func BenchmarkSave{n}(b *testing.B) { work{c}() }

func helper{n}() {}
'''),
    "ts": ("src/web/card{n}.tsx", '''import React, { useState } from 'react';
import type { User{c} } from './types{c}';
export { helper{c} } from './util{c}';

export interface Card{n}Props {
  title: string;
  size?: number;
}

export type Key{n} = keyof User{c};
export enum Mode{n} { A, B }

@Injectable()
export class User{n}Service extends Root{r} implements Store{c} {
  constructor(private api: Api{c}Service) {}
  async load(id: number): Promise<string> {
    return fetch('/py/{n}', { method: 'PUT' });
  }
  plain() { return 1; }
}

export function Card{n}({ title }: Card{n}Props) {
  return <Box title={title}/>;
}

export const useCard{n} = (x: number) => { return useState(x); };

const total{n}: number = {n};

function guard{n}(req, res, next) { next(); }
function list{n}(req, res) { return lookup{c}(req); }
app.get('/ts/{n}', guard{n}, list{n});
'''),
    "ts_test": ("src/web/card{n}.test.tsx", '''import { load{n} } from './card{n}';

describe('unit of {n}', () => {
  beforeEach(() => { reset{c}(); });
  it('should return {n}', () => {
    const f = jest.fn();
    expect(load{n}(1)).toBe(2);
    expect(f).not.toHaveBeenCalled();
  });
  it.skip('renders the flow {n}', () => {
    render(<Card{n}/>);
  });
});
'''),
    "ts_shown": ("src/web/shown{n}.tsx", '''import { helper{c} } from './util{c}';

export interface Shown{n}Props {
  label: string;
}

export function Shown{n}(p: Shown{n}Props) {
  return <b>{helper{c}(p.label)}</b>;
}
'''),
    "ts_deep": ("src/app/deep{n}.ts", '''function compute{n}() { return {n}; }
export default function standard{n}() { return 0; }
export { compute{n} as helper{n} };
'''),
    "ts_base": ("src/app/base{n}.tsx", '''export * from './ring{n}';
export function Log{n}(target) { return target; }
export class Api{n}Service { ping() { return 1; } }
export function Panel{n}(p) { return <div/>; }
export function auth{n}(req, res, next) { next(); }
export function late{n}(req, res) { return 1; }
'''),
    "ts_ring": ("src/app/ring{n}.ts", '''export * from './base{n}';
export const ringed{n} = (x) => { return x; };
'''),
    "ts_barrel": ("src/app/barrel{n}/index.ts", '''export { helper{n} as assist{n}, default as usual{n} } from '../deep{n}';
export * from '../base{n}';
'''),
    "ts_index": ("src/app/index{n}.ts", '''import { assist{n} as inner{n} } from './barrel{n}';
export { inner{n} as aid{n} };
export { usual{n} } from './barrel{n}';
'''),
    "ts_main": ("src/app/main{n}.tsx", '''import { aid{n} as go{n} } from './index{n}';
import { Log{n}, Api{n}Service, Panel{n}, auth{n}, ringed{n}, late{n} } from './barrel{n}';
import * as all{n} from './index{n}';

export interface Main{n}Props {
  title: string;
  size?: number;
}

@Log{n}()
export class Main{n}Controller {
  constructor(private api: Api{n}Service) {}
  run() { return go{n}() + all{n}.usual{n}(); }
  view() { return <Panel{n} title="x"/>; }
  call() { return fetch('https://host/v1/app/{n}/items?x=1'); }
}

function items{n}(req, res) { return ringed{n}(1); }
app.use(auth{n});
app.get('/app/{n}/items', auth{n}, items{n});
app.post('/app/{n}/late', late{n});
app.delete('/app/{n}/inline', (req, res) => { res.end(); });
'''),
    "py_chain": ("src/py/chain{n}.py", '''def one_{n}():
    return two_{n}()


def two_{n}():
    return three_{n}()


def three_{n}():
    return four_{n}()


def four_{n}():
    return five_{n}()


def five_{n}():
    return 5
'''),
    "py_chain_test": ("tests/py/test_chain{n}.py", '''def test_one_{n}():
    assert one_{n}() == 5


def test_three_{n}():
    assert three_{n}() + five_{n}() == 10
'''),
}
LANGUAGES = {"py": "python", "go": "go", "ts": "typescript"}
NUMBERS = {"{n}": lambda n: n, "{h}": lambda n: n % 7, "{r}": lambda n: n % 3, "{c}": lambda n: n % 4}


def dealt(spark, d, table: str, key: str) -> DataFrame:
    """n: a table's keys, dealt to as many tasks as a shuffle has. A table of keys is small and read by a task or two, and the tree made from it is large."""
    return load(spark, d, table).select(F.col(key).alias("n")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "n")


def filled(text: str) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), x[1](F.col("n")).cast("string")), [x for x in NUMBERS.items() if x[0] in text], F.lit(text))


def sources(spark, d, *kinds: str) -> DataFrame:
    """files(path, content, language) of the kinds."""
    made = [F.struct(filled(FILES[k][0]).alias("path"), filled(FILES[k][1]).alias("content"), F.lit(LANGUAGES[k.split("_")[0]]).alias("language")) for k in kinds]
    return dealt(spark, d, "supplier", "s_suppkey").select(F.explode(F.array(*made)).alias("f")).select("f.*")


def extracted(spark, d, *kinds: str, labels: tuple | None = None, types: tuple | None = None) -> DataFrame:
    return ingest.extract(sources(spark, d, *kinds), labels, types)


def found(kind: str, columns: str, rows: list[tuple]) -> str:
    """SQL: for each supplier the file's path and the rows, with the numbers put in; a column's kind follows its name."""
    names = [c.split(":") for c in columns.split()]
    fill = lambda x: f"replace(replace(replace(replace({x}, '{{n}}', n::varchar), '{{h}}', (n % 7)::varchar), '{{r}}', (n % 3)::varchar), '{{c}}', (n % 4)::varchar)"
    text = lambda v: "null" if v is None else "'" + str(v).replace("'", "''") + "'"
    shown = ", ".join(f"({fill('v.' + c[0] + '::varchar')})::{c[1] if len(c) > 1 else 'varchar'} as {c[0]}" for c in names)
    path = fill(text(FILES[kind][0]))
    values = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)
    return f"select {path} as file_path, {shown} from (select s_suppkey as n from supplier) s, (values {values}) v({', '.join(c[0] for c in names)})"


def register(name: str, kinds: str, columns: str, pick, *expected: tuple[str, list[tuple]]):
    """A query that extracts the kinds of files and picks the columns; its SQL unites what is found in each kind."""
    sql = " union all ".join(found(kind, columns, rows) for kind, rows in expected)

    @query(name, ", one as (select 1) " + sql)
    def run(spark, d):
        rows = extracted(spark, d, *kinds.split(), labels=getattr(pick, "labels", None), types=getattr(pick, "types", None))
        return pick(rows).select("file_path", *[c.split(":")[0] for c in columns.split()])


def of(pick, labels: tuple = (), types: tuple = ()):
    """pick, with what it asks of the extraction: nodes of the labels, edges of the types with the nodes at their ends."""
    pick.labels, pick.types = labels, types
    return pick


def nodes(*labels: str, **columns):
    """Nodes of the labels; columns that aren't the node's own come from its properties or an expression."""
    return of(lambda rows: rows.where(F.col("tag") == "node").where(F.col("label").isin(*labels)).withColumns({k: F.expr(v) for k, v in columns.items()}), labels)


def with_ends(rows: DataFrame, **ends: str) -> DataFrame:
    """rows with the name of each edge's ends in columns, null where no node of the file has the id. A file's rows meet in one task, so they are extracted once and nothing is broadcast."""
    out = rows.repartition("file_path")
    for name, end in ends.items():
        at = Window.partitionBy("file_path", F.when(F.col("tag") == "edge", F.col(end)).otherwise(F.col("id")))
        out = out.withColumn(name, F.max(F.when(F.col("tag") == "node", F.struct("name"))).over(at)["name"])
    return out


def edges(*types: str, where: str = "true", target: bool = False, **columns):
    """Edges of the types with their source's name, and with their target's where it is a node of the file, else the reference."""

    def pick(rows):
        e = with_ends(rows, source="src_id", **({"target": "dst_ref"} if target else {}))
        e = e.where((F.col("tag") == "edge") & F.col("type").isin(*types) & F.col("source").isNotNull()).where(where)
        return e.withColumns({k: F.expr(v) for k, v in columns.items()} | ({"target": F.coalesce("target", "dst_ref")} if target else {}))

    return of(pick, types=types)


register("ex01_python_functions", "py", "label name signature receiver_type doc_string complexity:int line_number:int is_async returns",
    nodes("Method", "Function", is_async="props['async']", returns="props['return_type']"), ("py", [
        ("Method", "area", "(self, x)", "Base{n}", None, 1, 10, None, "float"), ("Method", "scale", "(y)", "Base{n}", None, 3, 13, None, None),
        ("Function", "run_{n}", "(a, *, b=2)", None, "Runs {n}.", 1, 20, "True", None), ("Function", "put_{n}", "()", None, None, 1, 25, None, None),
    ]))
register("ex02_python_classes", "py py_test", "name signature doc_string line_number:int bases", nodes("Class", bases="props['bases']"),
    ("py", [("Base{n}", "(Root{r})", "Doc {n}.", 7, "Root{r}")]), ("py_test", [("TestBase{n}", "", None, 13, None)]))
register("ex03_python_imports", "py py_test", "name alias names line_number:int", nodes("Import", alias="props['alias']", names="props['names']"),
    ("py", [("os", None, None, 1), ("pkg.util", "h", "helper{h}", 2)]), ("py_test", [("pytest", None, None, 1), ("unittest", None, "mock", 2), ("mod{n}", None, "run_{n}", 3)]))
register("ex04_python_variables", "py", "name type_definition value is_exported:boolean", nodes("Variable", value="props['value']"), ("py", [("LIMIT_{n}", "int", "{n}", "true")]))
register("ex05_python_calls", "py py_test", "source dst_ref", edges("CALLS"),
    ("py", [("area", "Base{n}.scale"), ("area", "h"), ("run_{n}", "compute_{c}"), ("put_{n}", "app.route"), ("put_{n}", "requests.get")]),
    ("py_test", [("test_run_{n}", "pytest.mark.parametrize"), ("test_run_{n}", "run_{n}"), ("test_run_{n}", "pytest.raises"), ("test_run_{n}", "compute_{c}"), ("test_integration_area", "TestBase{n}.assertEqual"), ("test_integration_area", "area")]))
register("ex06_python_bases", "py py_test", "source dst_ref", edges("INHERITS"), ("py", [("Base{n}", "Root{r}")]))
register("ex07_go_functions", "go", "label name signature doc_string complexity:int is_exported:boolean", of(lambda rows: nodes("Method", "Function")(rows).where("props['abstract'] is null"), ("Method", "Function")), ("go", [
    ("Method", "Save", "(d *Disk{n}) Save(x int) error", "Save stores.", 1, "true"), ("Method", "Close", "(d *Disk{n}) Close() error", "", 1, "true"), ("Function", "write{n}", "write{n}[T int | ~string](p string, x T) error", "", 3, "false"),
    ("Function", "worker{n}", "worker{n}(jobs <-chan int)", "", 4, "false"), ("Function", "Routes{n}", "Routes{n}(r Router)", "", 1, "true"),
]))
register("ex08_go_types", "go", "label name type_definition is_exported:boolean", of(lambda rows: nodes("Struct", "Interface", "Property")(rows).withColumn("type_definition", F.regexp_replace("type_definition", r"\s+", " ")), ("Struct", "Interface", "Property")), ("go", [
    ("Interface", "Saver{n}", "interface { Save(x int) error Close() error }", "true"), ("Struct", "Base{n}", "struct{ N int }", "true"), ("Property", "N", "int", "true"),
    ("Struct", "Disk{n}", "struct { Base{n} path, name string }", "true"), ("Property", "path", "string", "false"), ("Property", "name", "string", "false"),
]))
register("ex09_go_imports", "go go_test", "name alias signature", nodes("Import", alias="props['alias']"),
    ("go", [("fmt", None, '"fmt"'), ("example.com/lib{c}", "u", 'u "example.com/lib{c}"')]), ("go_test", [("testing", None, '"testing"')]))
register("ex10_go_calls", "go go_test", "source dst_ref", edges("CALLS"),
    ("go", [("Save", "write{n}"), ("write{n}", "make"), ("write{n}", "worker{n}"), ("write{n}", "fmt.Println"), ("write{n}", "u.Check"), ("Routes{n}", "r.GET"), ("Routes{n}", "http.Post")]),
    ("go_test", [("TestWrite{n}", "t.Parallel"), ("TestWrite{n}", "write{n}"), ("TestWrite{n}", "t.Fatal"), ("BenchmarkSave{n}", "work{c}")]))
register("ex11_go_receivers", "go", "name receiver_type pointer", of(lambda rows: nodes("Method", pointer="props['pointer_receiver']")(rows).where("props['receiver'] is not null"), ("Method",)), ("go", [("Save", "Disk{n}", "True"), ("Close", "Disk{n}", "True")]))
register("ex12_go_embeds", "go", "source dst_ref", edges("EMBEDS"), ("go", [("Disk{n}", "Base{n}")]))
register("ex14_go_channels", "go", "label name element buffer direction", of(lambda rows: nodes("Variable", "Type", element="props['element']", buffer="props['buffer']", direction="props['direction']")(rows).where("props['kind'] = 'channel'"), ("Variable", "Type")),
    ("go", [("Variable", "jobs", "T", "{n}", None), ("Type", "chan int", "int", None, "receive")]))
register("ex15_go_channel_operations", "go", "source dst_ref operation", edges("USES", where="props['usage'] in ('send', 'receive', 'select')", operation="props['usage']"),
    ("go", [("write{n}", "jobs", "send"), ("worker{n}", "jobs", "receive"), ("worker{n}", "select", "select")]))
register("ex16_goroutines", "go", "source dst_ref", edges("USES", where="props['usage'] = 'concurrency'"), ("go", [("write{n}", "worker{n}")]))
register("ex17_go_generics", "go", "name type_definition united approximate", nodes("Generic", united="props['union']", approximate="props['approximate']"), ("go", [("T", "int | ~string", "True", "True")]))
register("ex17_go_instances", "go", "source dst_ref arguments", edges("USES", where="props['usage'] = 'instantiation'", arguments="props['type_arguments']"), ("go", [("write{n}", "Box", "int")]))
register("ex18_go_packages", "go go_test", "name package", nodes("File", package="props['package']"), ("go", [("disk{n}.go", "store{r}")]), ("go_test", [("disk{n}_test.go", "store{r}")]))


register("ex19_concurrency_patterns", "go_pool", "name evidence", of(lambda rows: nodes("Type", evidence="props['evidence']")(rows).where("props['kind'] = 'concurrency_pattern'"), ("Type",)),
    ("go_pool", [("worker_pool", "in"), ("pipeline", "in,out"), ("fan_out_fan_in", "2")]))


register("ex20_go_defines", "go", "source target", edges("DEFINES", target=True), ("go", [("Saver{n}", "Save"), ("Saver{n}", "Close"), ("Disk{n}", "Save"), ("Disk{n}", "Close")]))
register("ex21_ts_declarations", "ts", "label name is_exported:boolean line_number:int", nodes("Class", "Method", "Function", "Interface", "Type", "Enum"), ("ts", [
    ("Interface", "Card{n}Props", "true", 5), ("Type", "Key{n}", "true", 10), ("Enum", "Mode{n}", "true", 11), ("Class", "User{n}Service", "true", 14), ("Method", "constructor", "false", 15), ("Method", "load", "false", 16),
    ("Method", "plain", "false", 19), ("Function", "Card{n}", "true", 22), ("Function", "useCard{n}", "true", 26), ("Function", "guard{n}", "false", 30), ("Function", "list{n}", "false", 31),
]))
register("ex22_ts_imports", "ts ts_test", "name kind names type_only", nodes("Import", kind="props['kind']", names="props['names']", type_only="props['type_only']"),
    ("ts", [("react", "default", "useState", None), ("./types{c}", "named", "User{c}", "True")]), ("ts_test", [("./card{n}", "named", "load{n}", None)]))
register("ex23_ts_exports", "ts", "name re_export", nodes("Export", re_export="props['re_export']"), ("ts", [("./util{c}", "True")]))
register("ex24_ts_variables", "ts ts_test", "name type_definition value kind", nodes("Variable", value="props['value']", kind="props['kind']"), ("ts", [("total{n}", "number", "{n}", "const")]), ("ts_test", [("f", None, "jest.fn()", "const")]))
register("ex25_ts_heritage", "ts", "type source dst_ref", edges("INHERITS", "IMPLEMENTS"), ("ts", [("INHERITS", "User{n}Service", "Root{r}"), ("IMPLEMENTS", "User{n}Service", "Store{c}")]))
register("ex26_ts_calls", "ts", "source dst_ref", edges("CALLS"), ("ts", [("load", "fetch"), ("useCard{n}", "useState"), ("guard{n}", "next"), ("list{n}", "lookup{c}")]))
register("ex27_ts_decorators", "ts", "source dst_ref name", edges("DECORATES", name="props['decorator_name']"), ("ts", [("User{n}Service", "Injectable", "@Injectable")]))
register("ex30_ts_components", "ts", "label name framework", nodes("Component", "Hook", "Decorator", framework="props['framework']"), ("ts", [("Component", "Card{n}", "react"), ("Hook", "useCard{n}", None), ("Decorator", "Injectable", None)]))
register("ex31_ts_jsx", "ts", "source dst_ref", edges("RENDERS_JSX"), ("ts", [("Card{n}", "Box")]))
register("ex32_ts_api_calls", "ts", "source dst_ref method", edges("CALLS_API", method="props['http_method']"), ("ts", [("load", "/py/{n}", "PUT")]))


register("ex33_ts_routes", "ts", "type source target", edges("EXPOSES_ENDPOINT", "HANDLES_ROUTE", "USES_MIDDLEWARE", target=True), ("ts", [("EXPOSES_ENDPOINT", "list{n}", "/ts/{n}"), ("HANDLES_ROUTE", "list{n}", "/ts/{n}"), ("USES_MIDDLEWARE", "/ts/{n}", "guard{n}")]))
register("ex34_ts_services", "ts", "name api_service api_methods", nodes("Service", api_service="props['api_service']", api_methods="props['api_methods']"), ("ts", [("User{n}Service", "True", "load")]))
register("ex36_ts_uses", "ts", "type source dst_ref", edges("INJECTS", "CONSUMES_SERVICE", "HAS_PROPS", "USES"), ("ts", [
    ("INJECTS", "User{n}Service", "Api{c}Service"), ("CONSUMES_SERVICE", "User{n}Service", "Api{c}Service"), ("HAS_PROPS", "Card{n}Props", "title"), ("HAS_PROPS", "Card{n}Props", "size"), ("USES", "Card{n}", "Card{n}Props"),
]))
register("td01_go_tests", "go go_test", "name test_framework test_type test_target assertion_count:bigint parallel", nodes("TestFunction", parallel="props['parallel']"),
    ("go_test", [("TestWrite{n}", "testing", "unit", "Write{n}", 1, "true"), ("BenchmarkSave{n}", "testing", "benchmark", "", 0, None)]))
register("td07_python_tests", "py py_test", "name test_framework test_type test_target assertion_count:bigint parameterized", nodes("TestFunction", parameterized="props['parameterized']"),
    ("py_test", [("test_run_{n}", "pytest", "unit", "run_{n}", 2, "true"), ("test_integration_area", "pytest", "integration", "integration_area", 1, None)]))
register("td13_test_edges", "py py_test go go_test", "type source dst_ref confidence_score:double coverage_type", edges("TESTS", "COVERS"),
    ("py_test", [(t, s, r, 0.8 if t == "TESTS" else None, None if t == "TESTS" else "direct") for t in ("TESTS", "COVERS") for s, r in (("test_run_{n}", "run_{n}"), ("test_run_{n}", "compute_{c}"), ("test_integration_area", "area"))]),
    ("go_test", [(t, s, r, 0.8 if t == "TESTS" else None, None if t == "TESTS" else "direct") for t in ("TESTS", "COVERS") for s, r in (("TestWrite{n}", "write{n}"), ("BenchmarkSave{n}", "work{c}"))]))
register("td16_ts_suites", "ts ts_test", "label name test_framework test_type assertion_count:bigint test_count:bigint skipped", nodes("TestSuite", "TestCase", skipped="props['skip']"), ("ts_test", [
    ("TestSuite", "unit of {n}", "jest", "unit", None, 2, None), ("TestCase", "should return {n}", "jest", "unit", 2, None, None), ("TestCase", "renders the flow {n}", "jest", "component", 0, None, "True"),
]))
register("td17_ts_assertions", "ts_test", "label name kind expected", nodes("Assertion", "Mock", "Fixture", kind="coalesce(props['assertion_type'], props['mock_type'], props['fixture_type'])", expected="props['expected_value']"), ("ts_test", [
    ("Assertion", "toBe", "expect", "2"), ("Assertion", "toHaveBeenCalled", "expect", ""), ("Mock", "jest.fn", "function", None), ("Fixture", "beforeEach", "setup", None),
]))


register("td19_ts_test_edges", "ts_test", "type source target", edges("RUNS_TEST", "GROUPS_TESTS", "ASSERTS", "TESTS_COMPONENT", "TESTS", target=True), ("ts_test", [
    ("RUNS_TEST", "unit of {n}", "should return {n}"), ("RUNS_TEST", "unit of {n}", "renders the flow {n}"), ("ASSERTS", "should return {n}", "toBe"), ("ASSERTS", "should return {n}", "toHaveBeenCalled"),
    ("TESTS", "should return {n}", "load{n}"), ("TESTS", "renders the flow {n}", "render"), ("TESTS_COMPONENT", "renders the flow {n}", "Card{n}"),
]))

_ENDS = found("py", "method path language", [("PUT", "/py/{n}", "python"), ("POST", "/py/{n}", "python")]) + " union all " + found("go", "method path language", [("GET", "/go/{n}", "go")]) + " union all " + found("ts", "method path language", [("GET", "/ts/{n}", "typescript")])
_CALLS = found("py", "method target language", [("GET", "http://go.example/go/{n}?x=1", "python")]) + " union all " + found("go", "method target language", [("POST", "http://ts.example/ts/{n}", "go")]) + " union all " + found("ts", "method target language", [("PUT", "/py/{n}", "typescript")])


@query("f19_endpoints", ", one as (select 1) " + _ENDS)
def f19_endpoints(spark, d):
    return crosslang.endpoints(sources(spark, d, "py", "go", "ts")).withColumnRenamed("file", "file_path")


@query("f19_api_calls", ", one as (select 1) " + _CALLS)
def f19_api_calls(spark, d):
    return crosslang.api_calls(sources(spark, d, "py", "go", "ts")).withColumnRenamed("file", "file_path")


@query("q21_cross_language_links", f", ends as ({_ENDS}), asked as ({_CALLS}) select a.file_path as caller, a.method, a.target, e.file_path as endpoint_file, e.method as endpoint_method from asked a join ends e on a.language <> e.language and contains(regexp_replace(regexp_replace(a.target, '^http://[^/]*', ''), '[?].*$', ''), e.path)")
def q21_links(spark, d):
    files = sources(spark, d, "py", "go", "ts")
    return crosslang.match_paths(crosslang.api_calls(files), crosslang.endpoints(files)).select(F.col("file").alias("caller"), "method", "target", "endpoint_file", "endpoint_method")


@query("q21_analyze_project", "select 4 * count(*) as endpoints, 3 * count(*) as api_calls, 4 * (select count(*) from supplier a join supplier b on starts_with(a.s_suppkey::varchar, b.s_suppkey::varchar)) as links, 4 * count(*) as called_endpoints, 100.0::double as coverage_percentage from supplier")
def q21(spark, d):
    return crosslang.analyze_project(sources(spark, d, "py", "go", "ts"))


def built(spark, d, *kinds):
    from ..sources.folders import staged

    return ingest.graph_of(staged(extracted(spark, d, *kinds), "extracted"))


@query("j03_resolved_tests", f""", one as (select 1)
select type, source, target, cross_file from (
  {found("py_test", "type source target cross_file:boolean", [(t, "test_run_{n}", "run_{n}", "true") for t in ("TESTS", "COVERS", "CALLS")])}
  union all {found("go_test", "type source target cross_file:boolean", [(t, "TestWrite{n}", "write{n}", "true") for t in ("TESTS", "COVERS", "CALLS")])}
  union all {found("go", "type source target cross_file:boolean", [("CALLS", "Save", "write{n}", "false"), ("CALLS", "write{n}", "worker{n}", "false")])}
  union all {found("py", "type source target cross_file:boolean", [("CALLS", "area", "scale", "false")])})
union all select t, 'test_integration_area', 'area', true from supplier, (values ('TESTS'), ('COVERS'), ('CALLS')) v(t)""")
def j03(spark, d):
    """Resolution of extracted references: tests to what they test in other files, calls inside a file, self's methods by their class."""
    g, _, _ = built(spark, d, "py", "py_test", "go", "go_test")
    end = lambda x: g.nodes.select(F.col("id").alias(f"{x}_id"), F.col("name").alias({"src": "source", "dst": "target"}[x]), F.col("file_path").alias(f"{x}_file"))
    e = g.rel("TESTS", "COVERS", "CALLS").where("coverage_type is null or coverage_type = 'direct'").select("type", "src_id", "dst_id").join(end("src"), "src_id").join(end("dst"), "dst_id")
    return e.select("type", "source", "target", (F.col("src_file") != F.col("dst_file")).alias("cross_file"))


APP = ("ts_deep", "ts_base", "ts_ring", "ts_barrel", "ts_index", "ts_main")
#: Relations of TypeScript whose ends are properties, elements, endpoints, marks or files.
RELATIONS = ("RE_EXPORTS", "DECORATES", "HAS_PROPS", "RENDERS_JSX", "EXPOSES_ENDPOINT", "HANDLES_ROUTE", "USES_MIDDLEWARE", "CALLS_API", "INJECTS", "CONSUMES_SERVICE")
_APP = [
    ("RE_EXPORTS", "File", "base{n}.tsx", "File", "ring{n}.ts"), ("RE_EXPORTS", "File", "ring{n}.ts", "File", "base{n}.tsx"), ("RE_EXPORTS", "File", "index.ts", "File", "deep{n}.ts"), ("RE_EXPORTS", "File", "index.ts", "File", "base{n}.tsx"), ("RE_EXPORTS", "File", "index{n}.ts", "File", "index.ts"),
    ("DECORATES", "Decorator", "Log{n}", "Class", "Main{n}Controller"), ("DECORATES", "Function", "Log{n}", "Class", "Main{n}Controller"),
    ("HAS_PROPS", "Interface", "Main{n}Props", "Prop", "title"), ("HAS_PROPS", "Interface", "Main{n}Props", "Prop", "size"),
    ("RENDERS_JSX", "Method", "view", "JSXElement", "Panel{n}"), ("RENDERS_JSX", "Method", "view", "Function", "Panel{n}"),
    ("EXPOSES_ENDPOINT", "Function", "items{n}", "Endpoint", "/app/{n}/items"), ("HANDLES_ROUTE", "Function", "items{n}", "Endpoint", "/app/{n}/items"),
    ("EXPOSES_ENDPOINT", "File", "main{n}.tsx", "Endpoint", "/app/{n}/late"), ("EXPOSES_ENDPOINT", "Function", "late{n}", "Endpoint", "/app/{n}/late"), ("HANDLES_ROUTE", "Function", "late{n}", "Endpoint", "/app/{n}/late"),
    ("EXPOSES_ENDPOINT", "File", "main{n}.tsx", "Endpoint", "/app/{n}/inline"),
    ("USES_MIDDLEWARE", "File", "main{n}.tsx", "Middleware", "auth{n}"), ("USES_MIDDLEWARE", "File", "main{n}.tsx", "Function", "auth{n}"),
    ("USES_MIDDLEWARE", "Endpoint", "/app/{n}/items", "Middleware", "auth{n}"), ("USES_MIDDLEWARE", "Endpoint", "/app/{n}/items", "Function", "auth{n}"),
    ("CALLS_API", "Method", "call", "APICall", "fetch"), ("CALLS_API", "Method", "call", "Endpoint", "/app/{n}/items"),
    ("INJECTS", "Class", "Main{n}Controller", "Class", "Api{n}Service"), ("CONSUMES_SERVICE", "Class", "Main{n}Controller", "Class", "Api{n}Service"),
]


def _named(g, *types: str) -> DataFrame:
    """Edges of the types with their ends' labels, names and files."""
    end = lambda x, k: g.nodes.select(F.col("id").alias(f"{x}_id"), F.col("name").alias(k), F.col("file_path").alias(f"{k}_file"))
    return g.rel(*types).join(end("src", "source"), "src_id").join(end("dst", "target"), "dst_id")


@query("ex_relations_in_graph", f", one as (select 1) select type, src_label, source, dst_label, target from ({found('ts_main', 'type src_label source dst_label target', _APP)})")
def relations(spark, d):
    """What is read from TypeScript files stands in the resolved graph: each relation with both ends."""
    g, _, _ = built(spark, d, *APP)
    return _named(g, *RELATIONS).select("type", "src_label", "source", "dst_label", "target")


@query("ex_relations_rejected", ", one as (select 1) select type, 0::bigint as rejected from (values " + ", ".join(f"('{t}')" for t in RELATIONS) + ") v(type)")
def relations_rejected(spark, d):
    """Edges of these relations that resolution or the schema turned away: none."""
    _, rejected, _ = built(spark, d, *APP)
    kinds = spark.createDataFrame([(t,) for t in RELATIONS], "type string")
    return kinds.join(rejected.groupBy("type").agg(F.count("*").alias("n")), "type", "left").select("type", F.coalesce("n", F.lit(0)).cast("bigint").alias("rejected"))


@query("ex23_calls_through_barrels", f", one as (select 1) select source, target, target_file from ({found('ts_main', 'source target target_file', [('run', 'compute{n}', 'src/app/deep{n}.ts'), ('run', 'standard{n}', 'src/app/deep{n}.ts'), ('items{n}', 'ringed{n}', 'src/app/ring{n}.ts')])})")
def through_barrels(spark, d):
    """Calls by imported names: through two files that export again under new names, a default, a namespace, stars and a circle of them."""
    g, _, _ = built(spark, d, *APP)
    return _named(g, "CALLS").where("source_file <> target_file").select("source", "target", "target_file")


@query("q07b_built_indirect", f", one as (select 1) select source, target from ({found('py_chain_test', 'source target', [('test_one_{n}', 'two_{n}'), ('test_one_{n}', 'three_{n}'), ('test_one_{n}', 'four_{n}'), ('test_three_{n}', 'four_{n}')])})")
def built_indirect(spark, d):
    """A built graph's indirect coverage goes over three calls; what a test names itself isn't indirect."""
    g, _, _ = built(spark, d, "py_chain", "py_chain_test")
    return _named(g, "COVERS").where("coverage_type = 'indirect'").select("source", "target")


@query("ex03_import_edges", f", one as (select 1) select file_path, target from ({found('ts_test', 'target', [('src/web/card{n}.tsx',)])})")
def import_edges(spark, d):
    g, _, _ = built(spark, d, "ts", "ts_test")
    return g.rel("IMPORTS").select(F.col("src_id").alias("file_path"), F.col("dst_id").alias("target"))


@query("d36_importing_files", f", one as (select 1) select distinct file_path from ({found('go', 'name', [('fmt',), ('example.com/lib{c}',)])}) x where name = 'example.com/lib2'")
def importing_files(spark, d, module: str = "example.com/lib2"):
    """The files that import a module."""
    g, _, _ = built(spark, d, "go", "go_test", "py")
    return g.scan("Import").where(F.col("name") == module).select("file_path").distinct().orderBy("file_path")


@query("d36_methods_of_struct", f", one as (select 1) select name, signature, file_path from ({found('go', 'struct name signature', [('Disk{n}', 'Save', '(d *Disk{n}) Save(x int) error'), ('Disk{n}', 'Close', '(d *Disk{n}) Close() error')])}) x where struct = 'Disk1'")
def methods_of_struct(spark, d, name: str = "Disk1"):
    g, _, _ = built(spark, d, "go", "go_test")
    x = hop(g, "s", "m", ("DEFINES",), ("Struct",), ("Method",), columns=("id", "name", "signature", "file_path")).where(F.col("s_name") == name)
    return x.select(F.col("m_name").alias("name"), F.col("m_signature").alias("signature"), F.col("m_file_path").alias("file_path")).orderBy("name")


@query("d37_component_props", f""", one as (select 1) select file_path, component, props, tests, case when tests > 0 then 'covered' else 'uncovered' end as status
from ({found('ts', 'component props:bigint tests:bigint', [('Card{n}', '2', '1')])} union all {found('ts_shown', 'component props:bigint tests:bigint', [('Shown{n}', '1', '0')])}) x""")
def component_props(spark, d):
    """Components with their props and tests: a component's props are those of the interface in its file that has its name before Props."""
    g, _, _ = built(spark, d, "ts", "ts_test", "ts_shown")
    props = pairs(g, ("HAS_PROPS",), ("Interface",)).groupBy(F.col("src_id").alias("id")).agg(F.count("*").alias("props"))
    stated = g.scan("Interface").where("name like '%Props'").select("id", "file_path", F.regexp_replace("name", "Props$", "").alias("component")).join(props, "id").drop("id")
    parts = g.scan("Function", "Class").where("file_path like '%.tsx'").select(F.col("id").alias("dst_id"), "file_path", F.col("name").alias("component"))
    tests = pairs(g, ("TESTS", "TESTS_COMPONENT"), ("TestFunction", "TestCase")).groupBy("dst_id").agg(F.count("*").alias("tests"))
    x = parts.join(stated, ["file_path", "component"]).join(tests, "dst_id", "left").withColumn("tests", F.coalesce("tests", F.lit(0)))
    return x.select("file_path", "component", "props", "tests", F.when(F.col("tests") > 0, "covered").otherwise("uncovered").alias("status"))


@query("ex35_members_by_interval", f", one as (select 1) {found('py', 'class name', [('Base{n}', 'area'), ('Base{n}', 'scale')])} union all {found('py_test', 'class name', [('TestBase{n}', 'test_integration_area')])}")
def members(spark, d):
    """Containment by spans alone: functions inside classes."""
    from ..sources.folders import staged

    kinds = ("Function", "Method", "TestFunction", "Class")
    rows = extracted(spark, d, "py", "py_test", labels=kinds).where("tag = 'node'").select("id", "label", "name", "file_path", "start_byte", "end_byte")
    rows = staged(rows, "members")  # asked for four times
    inside = ingest.contained(rows.where("label <> 'Class'"), rows.where("label = 'Class'"))
    name = lambda c, k: rows.select(F.col("id").alias(c), F.col("name").alias(k), *(["file_path"] if c == "child" else []))
    return inside.join(name("child", "name"), "child").join(name("parent", "class"), "parent").select("file_path", "class", "name")


@query("sk02_graph_at_rest", """, per as (select * from (values ('File', 4), ('Class', 2), ('Method', 6), ('Function', 6), ('TestFunction', 4), ('Import', 8), ('Variable', 2), ('Struct', 2), ('Interface', 1), ('Property', 3), ('Generic', 1), ('Type', 1)) v(label, k))
select label, k * (select count(*) from supplier) as n from per""")
def at_rest(spark, d):
    """Nodes and edges written to partition folders and read back."""
    from ..graph import Graph
    from ..sources.folders import shared_dir

    g, _, _ = built(spark, d, "py", "py_test", "go", "go_test")
    g.write(path := shared_dir(spark, "graph"))
    return Graph.read(spark, path).nodes.groupBy("label").agg(F.count("*").alias("n"))


@query("sc01_scanned_files", """, f as (select n_nationkey as n, lower(replace(n_name, ' ', '_')) as name from nation)
select 'src/' || name || '.py' as path, 'python' as language, length('N = ' || n || chr(10))::bigint as length from f
union all select 'src/_' || name || '.ts', 'typescript', length('export const n = ' || n || ';' || chr(10))::bigint from f where n % 2 = 0
union all select 'pkg' || n || '/__init__.py', 'python', 0 from f where n % 5 = 0""")
def scanned(spark, d):
    """A tree of small files in the shared folder, scanned: names with an underscore and files of no bytes are found; ignored folders, other kinds and large files are not."""
    from ..sources.folders import shared_dir

    root = shared_dir(spark, "tree")
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def put(path, content):
        out = at.create(fs.Path(f"{root}/{path}"), True)
        out.write(bytearray(content.encode()))
        out.close()

    for n, name in load(spark, d, "nation").select("n_nationkey", F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))).collect():  # 25 rows
        put(f"src/{name}.py", f"N = {n}\n")
        put(f"node_modules/{name}.py", "N = 0\n")
        put(f"src/{name}.txt", "no code\n")
        if n % 2 == 0:
            put(f"src/_{name}.ts", f"export const n = {n};\n")
        if n % 5 == 0:
            put(f"pkg{n}/__init__.py", "")
            put(f"src/large{n}.py", "#" * 2000)
    return ingest.scan(spark, root, most_bytes=1000).select("path", "language", "length")


#: Statements of which a file has those whose bit is set in its number, so files differ in kind: (text, rows of label and name).
VARIED = {
    "py": (("src/vary/p{n}.py", ""), [
        ("import a.b as c{n}\nfrom . import (d{n},\n    e{n})\n\n", [("Import", "a.b"), ("Import", ".")]),
        ("@decor(1)\n@other\nasync def f{n}(x, /, y=1, *z, **k) -> 'T':\n    async with x as q:\n        return await g(q)\n\n", [("Function", "f{n}")]),
        ("class A{n}(B[int], metaclass=M):\n    x: int = 1\n\n    class In{n}:\n        def m{n}(self):\n            return [lambda v: v for v in self]\n\n", [("Class", "A{n}"), ("Class", "In{n}"), ("Method", "m{n}")]),
        ("def gen{n}():\n    def inner{n}():\n        yield from ()\n    return inner{n}\n\n", [("Function", "gen{n}"), ("Function", "inner{n}")]),
        ("TEXT{n} = \"\"\"def no{n}(): pass\nclass No: pass\n\"\"\"\n\n", [("Variable", "TEXT{n}")]),
        ("if True:\n    def when{n}(): return 1\nelse:\n    def other{n}(): return 2\n\n", [("Function", "when{n}"), ("Function", "other{n}")]),
    ]),
    "go": (("src/vary/g{n}.go", "package vary\n\n"), [
        ("type (\n\tPair{n}[K comparable, V any] struct {\n\t\tKey K\n\t}\n\tNum{n} int\n)\n\n", [("Struct", "Pair{n}"), ("Generic", "K"), ("Generic", "V"), ("Type", "Num{n}")]),
        ("type Shape{n} interface {\n\tArea() float64\n}\n\n", [("Interface", "Shape{n}"), ("Method", "Area")]),
        ("func (p Box{n}) Get() (int, error) { return 0, nil }\n\n", [("Method", "Get")]),
        ("func Map{n}[T any](xs []T, f func(T) T) []T {\n\tgo func() { f(xs[0]) }()\n\treturn xs\n}\n\n", [("Function", "Map{n}"), ("Generic", "T")]),
        ("// func Not{n}() {}\nvar s{n} = `func Nor{n}() {}`\n\n", []),
    ]),
    "ts": (("src/vary/t{n}.ts", ""), [
        ("declare module 'lib{n}' {\n  const z: number;\n}\n\n", [("Module", "lib{n}")]),
        ("export namespace Space{n} {\n  export const inner = 1;\n}\n\n", [("Namespace", "Space{n}")]),
        ("export type Maybe{n}<T> = T extends string ? T : never;\n\n", [("Type", "Maybe{n}")]),
        ("type Keys{n} = { [K in keyof Base]?: Base[K] };\n\n", [("Type", "Keys{n}")]),
        ("export abstract class Repo{n}<T extends Item> {\n  private async find{n}(id: string): Promise<T> { return this.get(id); }\n}\n\n", [("Class", "Repo{n}"), ("Method", "find{n}"), ("Generic", "T")]),
        ("const text{n} = 'function no{n}() {}'; // class No{n} {}\n\n", []),
        ("export default async function main{n}() { await import('./lazy{n}'); }\n\n", [("Function", "main{n}")]),
        ("declare enum Level{n} { Low = 1, High }\n\n", [("Enum", "Level{n}")]),
    ]),
}
_VARIED_LABELS = ("Import", "Function", "Class", "Method", "Struct", "Interface", "Type", "Module", "Namespace", "Enum", "Generic")


def varied(spark, d, *kinds: str) -> DataFrame:
    """files(path, content) of VARIED, of the kinds or all, for each part's number."""
    one = lambda path, head, parts: F.struct(filled(path).alias("path"), F.concat(F.lit(head), *[F.when(F.col("n").bitwiseAND(1 << k) > 0, filled(text)).otherwise("") for k, (text, _) in enumerate(parts)]).alias("content"))
    made = [one(path, head, parts) for (path, head), parts in (VARIED[k] for k in kinds or VARIED)]
    return dealt(spark, d, "part", "p_partkey").select(F.explode(F.array(*made)).alias("f")).select("f.*")


_VARIED_SQL = " union all ".join(
    f"select replace('{path}', '{{n}}', p_partkey::varchar) as file_path, '{label}' as label, replace('{name}', '{{n}}', p_partkey::varchar) as name from part where p_partkey & {1 << k} > 0"
    for (path, _), parts in VARIED.values()
    for k, (_, rows) in enumerate(parts)
    for label, name in rows
    if label in _VARIED_LABELS
)


@query("ex_varied_constructs", f", one as (select 1) {_VARIED_SQL}")
def varied_constructs(spark, d):
    """What each file's own set of statements declares, in three languages; text that only looks like a declaration declares nothing."""
    return ingest.extract(varied(spark, d), _VARIED_LABELS).where(F.col("label").isin(*_VARIED_LABELS)).select("file_path", "label", "name")


_BITS = "from part where p_partkey & {0} > 0"


@query("ex28_ts_namespaces", f""", one as (select 1)
select 'src/vary/t' || p_partkey || '.ts' as file_path, 'Module' as label, 'lib' || p_partkey as name, true as ambient, false as is_exported {_BITS.format(1)}
union all select 'src/vary/t' || p_partkey || '.ts', 'Namespace', 'Space' || p_partkey, false, true {_BITS.format(2)}""")
def ts_namespaces(spark, d):
    rows = ingest.extract(varied(spark, d, "ts"), ("Module", "Namespace")).where("label in ('Module', 'Namespace')")
    return rows.select("file_path", "label", "name", (F.coalesce(F.col("props")["ambient"], F.lit("")) == "True").alias("ambient"), "is_exported")


@query("ex29_ts_generics", f""", one as (select 1)
select 'src/vary/t' || p_partkey || '.ts' as file_path, 'conditional type' as what, 'Maybe' || p_partkey as name, 'never' as detail {_BITS.format(4)}
union all select 'src/vary/t' || p_partkey || '.ts', 'mapped type', 'Keys' || p_partkey, null {_BITS.format(8)}
union all select 'src/vary/t' || p_partkey || '.ts', 'parameter', 'T', 'Item' {_BITS.format(16)}
union all select 'src/vary/t' || p_partkey || '.ts', 'constraint', 'Repo' || p_partkey, 'Item' {_BITS.format(16)}""")
def ts_generics(spark, d):
    """Type parameters with their constraints, conditional and mapped types."""
    rows = with_ends(ingest.extract(varied(spark, d, "ts"), ("Type", "Generic"), ("CONSTRAINS",)), source="src_id")
    p, kind = F.col("props"), F.coalesce("label", "type")
    what = F.when((kind == "Type") & (p["conditional"] == "True"), "conditional type").when((kind == "Type") & (p["mapped"] == "True"), "mapped type").when(kind == "Generic", "parameter").when((kind == "CONSTRAINS") & F.col("source").isNotNull(), "constraint")
    detail = F.when(what == "conditional type", F.regexp_extract("type_definition", r"(\w+)\s*$", 1)).when(what == "parameter", F.col("type_definition")).when(what == "constraint", F.col("dst_ref"))
    return rows.select("file_path", what.alias("what"), F.when(what == "constraint", F.col("source")).otherwise(F.col("name")).alias("name"), detail.alias("detail")).where("what is not null")


def sections(path, content):
    """A language of a user's own: the sections of an ini file as modules, and what they include."""
    import re

    from ..sources.collect import Rows

    out, last = Rows(path, content, "ini", False), None
    for m in re.finditer(r"^(?:\[(\w+)\]|include\s*=\s*(\w+))", content, re.M):
        if m[1]:
            last = out.node("Module", m[1], m.start(), m.end())
        elif last:
            out.edge("USES", last, m[2], m.start())
    out.file()
    return out.rows


@query("ex_sql_table_function", f"""{", one as (select 1) "}{found("py", "label name", [("Class", "Base{n}"), ("Method", "area"), ("Method", "scale"), ("Function", "run_{n}"), ("Function", "put_{n}")])}
union all select 'conf/s' || s_suppkey || '.ini', 'Module', 'main' || s_suppkey from supplier union all select 'conf/s' || s_suppkey || '.ini', 'USES', 'base' || (s_suppkey % 3) from supplier""")
def table_function(spark, d):
    """Extraction in SQL, side by side for a known language and a user's own."""
    from ..sources.table_function import register as register_function

    register_function(spark, "extract_code", {".ini": sections})
    n = load(spark, d, "supplier").select(F.col("s_suppkey").alias("n"))
    own = n.select(F.concat(F.lit("conf/s"), "n", F.lit(".ini")).alias("path"), F.concat(F.lit("[main"), "n", F.lit("]\ninclude = base"), F.col("n") % 3, F.lit("\n")).alias("content"), F.lit("ini").alias("language"))
    sources(spark, d, "py").unionByName(own).createOrReplaceTempView("files_to_extract")
    return spark.sql("""select t.file_path, t.label, t.name from files_to_extract f, lateral extract_code(f.path, f.content, what => 'nodes') t where t.label in ('Class', 'Method', 'Function', 'Module')
    union all select t.file_path, t.type, t.dst_ref from files_to_extract f, lateral extract_code(f.path, f.content, what => 'edges') t where t.type = 'USES' and f.path like '%.ini'""")


@query("sc02_listed_by_tasks", """
select 'src/py/m' || (s_suppkey % 3) || '/mod' || s_suppkey || '.py' as path, '.py' as extension, length('x = ' || s_suppkey || chr(10))::bigint as length from supplier where s_suppkey % 10 <> 0
union all select 'src/web/_card' || s_suppkey || '.tsx', '.tsx', 0::bigint from supplier""")
def listed_by_tasks(spark, d):
    """A tree that tasks write and tasks list: ignored folders aren't entered, extensions and sizes are asked of the source."""
    from ..sources.folders import shared_dir
    from ..sources.tree import listing, write_tree

    n = load(spark, d, "supplier").select(F.col("s_suppkey").alias("n"))
    row = lambda path, content: n.select(F.concat(*path).alias("path"), content.alias("content"))
    text = F.concat(F.lit("x = "), F.col("n"), F.lit("\n"))
    large = F.when(F.col("n") % 10 == 0, F.repeat(F.lit("#"), 5000)).otherwise(text)
    files = reduce(DataFrame.unionByName, [
        row((F.lit("src/py/m"), F.col("n") % 3, F.lit("/mod"), "n", F.lit(".py")), large), row((F.lit("src/web/_card"), "n", F.lit(".tsx")), F.lit("")), row((F.lit("web/node_modules/lib"), "n", F.lit("/index.js")), text),
        row((F.lit("build/out"), "n", F.lit(".py")), text), row((F.lit("docs/page"), "n", F.lit(".md")), text),
    ])
    root = shared_dir(spark, "tree")
    write_tree(files, root).write.format("noop").mode("overwrite").save()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return listing(spark, root, pushdown=True).where("extension in ('.py', '.tsx', '.js') and length <= 4000").select("path", "extension", "length")


@query("sf3_read_file", "select replace('src/web/card{n}.tsx', '{n}', '1') as path, 'aW1wb3J0' as head, null::varchar as error union all select 'src/none.go', null, 'no such file: src/none.go'")
def read_one(spark, d):
    from .search import read_file

    files = sources(spark, d, "ts").withColumns({"length": F.octet_length("content"), "modified": F.current_timestamp()})
    got = read_file(files, "src/web/card1.tsx", "base64").unionByName(read_file(files, "src/none.go", "base64"))
    return got.select("path", F.substring("content", 1, 8).alias("head"), "error")


@query("sf2_listed_files", "select 'm' || r as name, 'src/py/m' || r as path, 'directory' as type from (select distinct s_suppkey % 3 as r from supplier)")
def listed(spark, d):
    from .search import list_files

    return list_files(sources(spark, d, "py"), "src/py", recursive=False)


@query("sc11_connections", """, c as (select * from (values
  ('Contains', 13), ('CALLS', 8), ('IMPORTS', 1), ('INHERITS', 1), ('EMBEDS', 1), ('IMPLEMENTS', 1), ('DEFINES', 2), ('USES', 4), ('TESTS', 6), ('COVERS', 4), ('MOCKS', 6), ('SETUP_FOR', 3), ('TEARDOWN_FOR', 1), ('ASSERTS', 2),
  ('VERIFIES', 4), ('SPIES', 4), ('STUBS', 4), ('FIXTURES', 2), ('RUNS_TEST', 2), ('GROUPS_TESTS', 2), ('SKIPS', 2), ('DEPENDS', 4), ('RE_EXPORTS', 3), ('DECORATES', 3), ('CONSTRAINS', 2), ('DYNAMIC_IMPORT', 2), ('HAS_PROPS', 2),
  ('RENDERS_JSX', 2), ('INJECTS', 2), ('CONSUMES_SERVICE', 2), ('HANDLES_ROUTE', 2), ('CALLS_API', 2), ('EXPOSES_ENDPOINT', 2), ('USES_MIDDLEWARE', 2)) v(name, n))
select name, n::bigint as n from c""")
def connections(spark, d):
    """The catalogue's relationship tables and how many pairs of labels each connects."""
    from ..graph import Graph
    from .binding import graph

    g: Graph = graph(spark, d)
    names = [r["name"] for r in introspect.show_tables(g).where("type = 'REL'").collect()]  # the schema's edge types
    each = [introspect.show_connection(g, x).agg(F.lit(x).alias("name"), F.count("*").alias("n")) for x in names]
    return reduce(DataFrame.unionByName, each)


@query("sc11_columns", """select * from (values ('EMBEDS', 'source_id', 'STRING'), ('EMBEDS', 'target_id', 'STRING'), ('TESTS', 'confidence_score', 'DOUBLE'), ('HAS_PROPS', 'prop_type', 'STRING'), ('HAS_PROPS', 'is_required', 'BOOLEAN')) v(name, property, type)""")
def columns(spark, d):
    from .binding import graph

    g = graph(spark, d)
    return reduce(DataFrame.unionByName, [introspect.table_info(g, x).select(F.lit(x).alias("name"), "property", "type") for x in ("EMBEDS", "TESTS", "HAS_PROPS", "CALLS")])
