"""Patterns, resolution, rules, reports and streams on hand-made inputs."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars
from loomgraph.functions import test_rules as T
from loomgraph.graph import Graph
from loomgraph.operators import patterns, resolve
from loomgraph.plans import coverage, crosslang, cypher, introspect, reports, search
from loomgraph.schema import EDGE_DDL, NODE_DDL, RAW_EDGE_DDL, conform
from loomgraph.streaming import changes as S


def edges(spark, text):
    return spark.createDataFrame([tuple(x.split(">")) for x in text.split()], "src_id string, dst_id string")


def test_walks_reach_and_cycles(spark):
    e = edges(spark, "a>b b>c c>a c>d d>d")
    w = patterns.walks(e, 1, 3)
    assert {(r.src_id, r.dst_id, r.hops) for r in w.where("src_id = 'a'").collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "a", 3), ("a", "d", 3)}
    assert {(r.id, r.hops) for r in patterns.cycles(e, 3).collect()} == {("d", 1), ("a", 3), ("b", 3), ("c", 3)}
    assert {r.dst_id for r in patterns.reachable(e, 1, 2).where("src_id = 'b'").collect()} == {"c", "a", "d"}


def test_closure(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = edges(spark, "a>b b>c c>a c>d x>y")
    got = {(r.id, r.depth) for r in patterns.closure(e, spark.createDataFrame([("a",)], "id string")).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


NODES = [
    ("s", "Function", "main", "app/main.go", 0, None, None), ("h1", "Function", "helper", "app/main.go", 50, None, None), ("h2", "Function", "helper", "app/util.go", 5, None, None), ("h3", "Function", "helper", "lib/a.go", 5, None, None),
    ("k", "Class", "helper", "app/main.go", 1, None, None), ("t", "Struct", "Disk", "lib/a.go", 1, None, None), ("m", "Method", "Save", "lib/a.go", 9, "Disk", None), ("c", "Class", "Shape", "py/s.py", 0, None, None), ("a", "Method", "area", "py/s.py", 5, "Shape", "c"),
]
RAW = [
    ("1", "CALLS", "s", "helper"), ("2", "CALLS", "h2", "helper"), ("3", "CALLS", "c", "helper"), ("4", "CALLS", "s", "Disk.Save"), ("5", "CALLS", "s", "Shape.area"), ("6", "CALLS", "s", "nothing"), ("7", "INHERITS", "c", "helper"),
    ("8", "CALLS", "gone", "helper"), ("9", "INHERITS", "s", "Shape"), ("10", "REFERENCES", "s", "t"), ("11", "CALLS", "s", None), ("12", "CALLS", "s", "a.b.c"), ("13", "CALLS", "s", "py.Shape.area"),
]


def resolved(spark, seed, **options):
    rnd = random.Random(seed)
    n, r = NODES[:], RAW[:]
    rnd.shuffle(n), rnd.shuffle(r)
    nodes = conform(spark.createDataFrame(n, "id string, label string, name string, file_path string, start_byte int, receiver_type string, parent_id string").repartition(3), NODE_DDL)
    raw = conform(spark.createDataFrame(r, "id string, type string, src_id string, dst_ref string"), RAW_EDGE_DDL)
    good, bad = resolve.resolve(raw, nodes, **options)
    return {x.id: (x.dst_id, x.strategy) for x in good.collect()}, {x.id: x.reason for x in bad.collect()}


def test_resolution(spark):
    good, bad = resolved(spark, 1)
    assert good == {"1": ("h1", "file"), "2": ("h2", "file"), "4": ("m", "method"), "5": ("a", "method"), "7": ("k", "global"), "10": ("t", "id"), "13": ("a", "qualified")}
    assert bad == {"3": resolve.NO_SCHEMA, "6": resolve.NO_TARGET, "8": resolve.NO_SOURCE, "9": resolve.NO_SCHEMA, "11": resolve.NO_TARGET, "12": resolve.NO_TARGET}
    assert resolved(spark, 2) == (good, bad)
    inside, _ = resolved(spark, 3, cross_file=False)
    assert "7" not in inside and inside["1"] == ("h1", "file")


def graph(spark):
    n = [("f1", "Function", "load", "src/a.py", False, None, None), ("f2", "Function", "save", "src/a.py", False, None, None), ("f3", "Function", "deep", "src/b.py", False, None, None), ("t1", "TestFunction", "test_load", "tests/t.py", True, 3, "unit"), ("t2", "TestFunction", "test_all", "tests/t.py", True, 0, "integration"), ("src/a.py", "File", "a.py", "src/a.py", False, None, None)]
    nodes = conform(spark.createDataFrame(n, "id string, label string, name string, file_path string, is_test boolean, assertion_count int, test_type string"), NODE_DDL, props=F.create_map(F.lit("owner"), F.col("name")))
    e = [("TESTS", "t1", "f1", 0.8, None), ("TESTS", "t2", "f1", None, None), ("COVERS", "t2", "f2", None, "indirect"), ("CALLS", "f1", "f2", None, None), ("CALLS", "f2", "f3", None, None), ("Contains", "src/a.py", "f1", None, None), ("Contains", "src/a.py", "f2", None, None)]
    labels = {r[0]: r[1] for r in n}
    rows = [(*r, labels[r[1]], labels[r[2]]) for r in e]
    return Graph(nodes, conform(spark.createDataFrame(rows, "type string, src_id string, dst_id string, confidence_score double, coverage_type string, src_label string, dst_label string"), EDGE_DDL))


def test_coverage_scores(spark):
    got = {r.entity_id: r for r in coverage.entity_coverage(graph(spark)).collect()}
    f1 = got["f1"]
    assert (f1.direct_tests, f1.indirect_tests, f1.assertion_count, f1.has_unit, f1.has_integration) == (2, 0, 3, True, True)
    assert f1.coverage_score == pytest.approx(min(1, 0.6 * 0.8 + 0.2 * 3 / 5 + 0.1 + 0.6 * 0.5 + 0.15)) and f1.confidence_score == pytest.approx(0.65)
    assert got["f2"].coverage_score == pytest.approx(0.09) and got["f2"].confidence_score == pytest.approx(0.15)
    assert not got["f3"].is_covered and got["f3"].coverage_score == 0
    derived = {(r.test_id, r.entity_id) for r in coverage.derived_indirect(graph(spark)).collect()}
    assert derived == {("t1", "f2"), ("t1", "f3"), ("t2", "f2"), ("t2", "f3")}
    m = coverage.metrics(graph(spark)).first()
    assert (m.total_entities, m.covered_entities, m.total_tests) == (3, 2, 2)


def test_cypher(spark):
    g = graph(spark)
    q = lambda text, **p: [tuple(r) for r in g.cypher(text, **p).collect()]
    assert q("MATCH (f:Function {name: $n}) RETURN f.file_path", n="load") == [("src/a.py",)]
    assert q("MATCH (f:Function) RETURN f.name AS n ORDER BY n DESC LIMIT 2") == [("save",), ("load",)]
    assert q("MATCH (f:Function) RETURN f.name AS n ORDER BY n SKIP 2") == [("save",)]
    assert q("MATCH (t:TestFunction)-[r:TESTS]->(f) RETURN f.name, count(*) AS n, collect(t.name) AS ts") == [("load", 2, ["test_all", "test_load"])]
    assert sorted(q("MATCH (a)-[:CALLS*1..2]->(b) RETURN a.name, b.name")) == [("load", "deep"), ("load", "save"), ("save", "deep")]
    assert q("MATCH (f:Function) WHERE NOT (()-[:CALLS]->(f)) RETURN f.name") == [("load",)]
    assert sorted(q("MATCH (f:Function) OPTIONAL MATCH (t:TestFunction)-[:TESTS]->(f) RETURN f.name, count(t)")) == [("deep", 0), ("load", 2), ("save", 0)]
    assert sorted(q("MATCH (a)-[r]-(b:File) RETURN a.name, type(r)")) == [("load", "Contains"), ("save", "Contains")]
    assert q("MATCH (f:Function) WITH collect(f.name) AS names UNWIND names AS x WITH x WHERE x CONTAINS 'a' RETURN x ORDER BY x") == [("load",), ("save",)]
    assert q("MATCH (f:Function) WHERE f.owner = 'deep' AND f.nothing IS NULL RETURN labels(f)[0], size(f.name)") == [("Function", 4)]
    assert q("MATCH (f:Function) WHERE f.name IN ['load', 'save'] AND ANY(x IN split(f.name, 'a') WHERE x = 'lo') RETURN {name: f.name, n: 1} AS m")[0][0].name == "load"
    assert q("MATCH (f:Function), (t:TestFunction) RETURN count(*) AS pairs") == [(6,)]
    for bad in ("", "MATCH (f", "RETURN $x", "MATCH (f) RETURN f.x #", "CREATE (f)", "MATCH (f) RETURN nosuch(f)"):
        with pytest.raises(cypher.CypherError):
            g.cypher(bad)


def test_service_and_growth(spark):
    g = graph(spark)
    from loomgraph.plans.service import run_cypher
    from loomgraph.streaming.events import EventBuffer, to_json

    r = run_cypher(g, "MATCH (f:Function) RETURN f.name AS n, f.complexity ORDER BY n")
    assert r["resultCount"] == 3 and r["result"].startswith("deep\t|\t")
    assert "error" in run_cypher(g, "MATCH (")
    more = g.add_nodes(spark.createDataFrame([("f1", "Function", "again"), ("f9", "Function", "new")], "id string, label string, name string"))
    assert {r.name for r in more.scan("Function").collect()} == {"load", "save", "deep", "new"}
    grown, bad = more.add_edges(spark.createDataFrame([("CALLS", "f9", "f1"), ("CALLS", "f9", "zz"), ("INHERITS", "f9", "f1"), ("CALLS", "zz", "f1")], "type string, src_id string, dst_id string"))
    assert grown.rel("CALLS").count() == 3 and sorted(r.reason for r in bad.collect()) == sorted([resolve.NO_TARGET, resolve.NO_SCHEMA, resolve.NO_SOURCE])
    left = g.without_files(spark.createDataFrame([("src/b.py",)], "file_path string"))
    assert left.nodes.count() == 5 and left.rel("CALLS").count() == 1
    b = EventBuffer(1)
    assert b.offer("Modified", files=1) and not b.offer("Deleted", files=1) and b.dropped == 1
    assert json.loads(to_json(b.drain()[0]))["data"] == {"files": 1}


def test_reports_and_introspection(spark):
    df = spark.createDataFrame([("a", None, True)], "x string, y int, z boolean")
    assert reports.render_text(df) == "a\t|\t\t|\ttrue\n"
    assert json.loads(reports.json_report(df).first()[0]) == {"x": "a", "z": True}
    assert "<td>a</td>" in reports.html_report(df, "<T>") and "&lt;T&gt;" in reports.html_report(df, "<T>")
    g = graph(spark)
    assert {r.type for r in introspect.show_tables(g).collect()} == {"NODE", "REL"}
    assert introspect.show_connection(g, "DEFINES").count() == 2 and introspect.table_info(g, "TESTS").first().type == "DOUBLE"
    s = json.loads(introspect.schema_json())
    assert len(s["nodes"]) == 33 and len(s["relationships"]) == 34


def test_stated_methods(spark):
    files = spark.createDataFrame([
        ("a.py", "python", "@bp.route ('/a', methods=['PUT', \"delete\"])\n@app.route('/b')\n@api.patch( '/c')"), ("b.go", "go", 'r.PUT ("/d", f)\nhttp.Put("https://h/e")\nr.Handle(`/f`, g)'),
        ("c.ts", "typescript", "fetch('/g', { method: 'POST', body })\nfetch ('/h')\nrouter.delete (`/i`)\n@Patch ('j')"), ("d.py", "python", None), ("e.rb", "ruby", "@app.route('/k')"),
    ], "path string, language string, content string")
    assert {(r.method, r.path) for r in crosslang.endpoints(files).collect()} == {("PUT", "/a"), ("DELETE", "/a"), ("GET", "/b"), ("PATCH", "/c"), ("PUT", "/d"), ("ANY", "/f"), ("DELETE", "/i"), ("PATCH", "j")}
    assert {(r.method, r.target) for r in crosslang.api_calls(files).collect()} == {("PUT", "https://h/e"), ("POST", "/g"), ("GET", "/h")}


def test_cross_language(spark):
    files = spark.createDataFrame([
        ("a.py", "python", "@app.route('/users')\n@app.post(\"/login\")\nrequests.get('http://h/api/items?x=1')"), ("b.go", "go", 'r.GET("/items", f)\nhttp.HandleFunc("/", root)\nhttp.Get("https://h/users/")'), ("c.ts", "typescript", "fetch('/v1/users/7')\naxios.post(`/login`)\napp.get('/', x)"),
    ], "path string, language string, content string")
    assert {(r.method, r.path, r.file) for r in crosslang.endpoints(files).collect()} == {("GET", "/users", "a.py"), ("POST", "/login", "a.py"), ("GET", "/items", "b.go"), ("ANY", "/", "b.go"), ("GET", "/", "c.ts")}
    links = crosslang.match_paths(crosslang.api_calls(files), crosslang.endpoints(files))
    targets = ("http://h/api/items?x=1", "https://h/users/", "/v1/users/7", "/login")
    assert {(r.target, r.endpoint_path) for r in links.collect()} == {(targets[0], "/items"), (targets[1], "/users"), (targets[2], "/users"), (targets[3], "/login")} | {(x, "/") for x in targets}
    r = crosslang.analyze_project(files).first()
    assert (r.endpoints, r.api_calls, r.links, r.called_endpoints, r.coverage_percentage) == (5, 4, 9, 5, 100.0)


def test_search_and_listing(spark):
    files = spark.createDataFrame([("src/a.py", "x = 1\n  Hello(2)\n"), ("src/sub/b.go", "hello"), ("node_modules/c.js", "hello")], "path string, content string")
    assert {(r.path, r.line_number, r.line, r.total) for r in search.search_lines(files, "HELLO(", most=5).collect()} == {("src/a.py", 2, "Hello(2)", 1)}
    assert search.search_lines(files, "hel+o", regex=True, glob="*.go", most=None).count() == 1
    assert {(r.name, r.type) for r in search.list_files(files, "src", recursive=False).collect()} == {("a.py", "file"), ("sub", "directory")}
    assert search.list_files(files).count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([("https://h/a/b?x=1", "src/t/x_test.go"), ("http://h", "a.py"), ("/p#f", "web/a.spec.tsx")], "u string, p string")
    got = df.select(scalars.url_path(F.col("u")), scalars.extension(F.col("p")), scalars.language(F.col("p")), scalars.is_test_path(F.col("p")), scalars.dirname(F.col("p")), scalars.contains_word(F.col("p"), "go")).collect()
    assert [tuple(r) for r in got] == [("/a/b", ".go", "go", True, "src/t", True), ("/", ".py", "python", False, "", False), ("/p", ".tsx", "typescript", True, "web", False)]
    assert len(spark.range(1).select(scalars.entity_id(F.lit("a"), F.lit(1))).first()[0]) == 16


def test_rules():
    assert T.go_is_test("a_test.go", "TestX", "()") and not T.go_is_test("a_test.go", "Testx", "()") and not T.go_is_test("a.go", "TestX", "()")
    assert T.go_test_type("TestE2EFlow", "") == "integration" and T.go_test_type("TestMain", "(m *testing.M)") == "suite"
    assert T.py_target("testAlpha") == "alpha" and T.py_framework("import nose", "x") == "nose" and T.py_framework("", "test_x") == "pytest"
    assert T.first("should return api", T.TS_TYPES, "unit") == "unit" and T.first("api", T.TS_TYPES, "unit") == "integration"


def test_streams_equal_batches(spark, tmp_path):
    rows = [(f"src/f{i % 5}.py", S.CHANGES[i * 7 % 4], i * 400 + (i % 3) * 300, i) for i in range(60)]
    df = spark.createDataFrame(rows, "path string, change_type string, ms bigint, entities bigint").select("path", "change_type", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("ms")).alias("ts"), "entities")
    for k in range(3):
        df.where(F.col("entities") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(x, mode, name):
        x.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(S.debounce(stream, "1 second"), "complete", "runs") == sorted(map(tuple, S.debounce(df, "1 second").collect()))
    assert run(S.update_stats(stream), "append", "stats") == sorted(map(tuple, S.update_stats_batch(df).collect()))
    assert S.next_state(None, "Deleted", 3) == (None, (0, 0, 0)) and S.next_state(4, "Modified", 3) == (3, (0, 4, 3))


def test_watched_folder_and_live_update(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("def one():\n    return 1\n")
    (root / "src/b.py").write_text("def two():\n    return 2\n")
    spark.dataSource.register(S.FolderWatch)

    def read_files(paths):
        from loomgraph.sources.ingest import scan

        return scan(spark, str(root)).join(paths.select("path"), "path", "left_semi")

    def turn():
        stream = S.relevant(spark.readStream.format("folder_watch").option("path", str(root)).option("state", str(tmp_path / "listings")).load())
        S.live_update(stream, read_files, str(tmp_path / "g"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return {(r.file_path, r.name) for r in S.stored_rows(spark, str(tmp_path / "g")).where("tag = 'node' and label = 'Function'").collect()}

    assert turn() == {("src/a.py", "one"), ("src/b.py", "two")}
    (root / "src/a.py").write_text("def three():\n    return 3\n")
    (root / "src/b.py").unlink()
    assert turn() == {("src/a.py", "three")}
    assert len(list((tmp_path / "listings").iterdir())) == 3  # none, two files, one
    (root / "src/a.py").write_text("def four():\n    return 4\n")
    assert turn() == {("src/a.py", "four")}
    assert len([p for p in (tmp_path / "g").iterdir() if p.is_dir()]) <= 3


def test_cycles_of_any_length(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    ring = " ".join(f"r{i}>r{(i + 1) % 7}" for i in range(7))
    e = edges(spark, f"{ring} r3>a a>b b>c c>d d>a a>x x>y s>s t>r0 y>z z>s p>q q>p")
    assert sorted(r.id for r in patterns.on_cycles(e).collect()) == sorted([*(f"r{i}" for i in range(7)), *"abcdspq"])
    assert patterns.on_cycles(edges(spark, "a>b b>c")).count() == 0
    assert patterns.on_cycles(edges(spark, "a>b").limit(0)).count() == 0


def strong(rows):
    """{frozenset of nodes} of the strong components on cycles, by what each node reaches."""
    to = {}
    for a, b in rows:
        if a is not None and b is not None:
            to.setdefault(a, set()).add(b)
    reached = {}
    for a in to:
        seen, front = set(), list(to[a])
        while front:
            x = front.pop()
            if x not in seen:
                seen.add(x)
                front += to.get(x, ())
        reached[a] = seen
    return {frozenset(b for b in reached[a] if a in reached.get(b, ())) for a in to if a in reached[a]}


def test_strong_components_against_reachability(spark, tmp_path):
    """Graphs of few edges a node, so that runs, rings, loops and ends all occur; repeated edges and null ends too."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    for seed in (0, 3, 5):
        r = random.Random(seed)
        n = 30
        rows = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(int(n * (0.8 + 0.15 * seed)))]
        # edges drawn out into runs, so that contraction has several levels
        for k in range(6):
            a, b = f"n{r.randrange(n)}", f"n{r.randrange(n)}"
            rows += list(itertools.pairwise([a, *(f"s{seed}_{k}_{i}" for i in range(r.randrange(1, 9))), b]))
        rows += [*rows[:3], (None, "n1"), ("n2", None), (None, None)]
        got = {}
        for row in patterns.strong_components(spark.createDataFrame(rows, "src_id string, dst_id string")).collect():
            assert row.id not in {x for part in got.values() for x in part}
            got.setdefault(row.component, set()).add(row.id)
        assert {frozenset(x) for x in got.values()} == strong(rows)
        assert all(c in x for c, x in got.items())


def test_long_ring_and_path_take_few_rounds(spark, tmp_path, monkeypatch):
    """A ring of 10,000 nodes with a path of 5,000 into it and one out of it: rounds grow with the logarithm."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    staged, frame = [], type(spark.range(1))
    real = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a: staged.append(1) or real(df, *a))
    ring = spark.range(10_000).selectExpr("concat('r', id) as src_id", "concat('r', (id + 1) % 10000) as dst_id")
    into = spark.range(5_000).selectExpr("concat('p', id) as src_id", "if(id = 4999, 'r0', concat('p', id + 1)) as dst_id")
    out = spark.range(5_000).selectExpr("if(id = 0, 'r5000', concat('q', id)) as src_id", "concat('q', id + 1) as dst_id")
    got = patterns.strong_components(ring.union(into).union(out))
    assert got.groupBy("component").count().collect()[0]["count"] == 10_000
    assert got.count() == 10_000
    assert 0 < len(staged) < 60


def test_rounds_keep_no_estimates_of_their_joins(spark, tmp_path, monkeypatch):
    """A frame of a round has the size of its files and not the product of all joins before it, which the driver would hold; rounds' files go."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    seen, real = [], patterns.replaced
    monkeypatch.setattr(patterns, "replaced", lambda df, *a: seen.append(real(df, *a)) or seen[-1])
    ring = spark.range(600).selectExpr("concat('r', id) as src_id", "concat('r', (id + 1) % 600) as dst_id")
    more = spark.createDataFrame([("r0", "a"), ("a", "r300"), ("r9", "b"), ("b", "r200"), ("b", "c"), ("c", "b")], "src_id string, dst_id string")
    got = patterns.strong_components(ring.union(more))
    assert got.count() == 603 and got.select("component").distinct().count() == 1
    assert 5 < len(seen) < 60
    estimate = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert estimate(got) < 1 << 200  # the given edges are of unknown size
    assert all(estimate(df) < 1 << 20 for df in seen if df.inputFiles() and os.path.exists(df.inputFiles()[0].removeprefix("file://")))
    there = [df for df in seen if all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())]
    assert len(there) <= len(seen) // 2


def test_walks_and_closure_without_bound(spark, tmp_path, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    e = edges(spark, " ".join(f"n{i}>n{i + 1}" for i in range(35)))
    start = spark.createDataFrame([("n0",)], "id string")
    assert patterns.closure(e, start).count() == 36
    with pytest.raises(OverflowError):
        patterns.closure(e, start, 30)
    few = edges(spark, " ".join(f"n{i}>n{i + 1}" for i in range(12)))
    assert patterns.walks(few, 1, None).count() == 78 and patterns.walks(few, 12, None).count() == 1 and patterns.walks(few, 13, None).count() == 0
    names = [f"n{i}" for i in range(13)]
    nodes = conform(spark.createDataFrame([(n, "Function", n) for n in names], "id string, label string, name string"), NODE_DDL)
    calls = conform(spark.createDataFrame([("CALLS", a, b, "Function", "Function") for a, b in zip(names, names[1:])], "type string, src_id string, dst_id string, src_label string, dst_label string"), EDGE_DDL)
    assert Graph(nodes, calls).cypher("MATCH (a {name: 'n0'})-[:CALLS*]->(b) RETURN b.name").count() == 12
    monkeypatch.setattr(patterns, "MOST_WALKS", 10)
    with pytest.raises(OverflowError):
        patterns.walks(few, 1, None)
