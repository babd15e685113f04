"""The tree source, its sink, and extraction as a table function."""

import os

from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, LessThanOrEqual

from loomgraph.sources import ingest, table_function, tree


def put(root, files):
    for path, text in files.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_ignored_folders_are_not_entered(spark, tmp_path):
    put(tmp_path, {"a.py": "x = 1\n", "_b.ts": "", ".c.go": "package c\n", "web/src/d.tsx": "d", "web/node_modules/lib/e.js": "e", "docs/f.md": "f", "deep/er/and/g.py": "g = 1", "dist/h.py": "h", "noext": "n", "web/api.db": "z"})
    os.symlink(tmp_path, tmp_path / "web/node_modules/loop")
    got = {r.path: (r.extension, r.length) for r in tree.listing(spark, str(tmp_path)).collect()}
    assert got == {"a.py": (".py", 6), "_b.ts": (".ts", 0), ".c.go": (".go", 10), "web/src/d.tsx": (".tsx", 1), "docs/f.md": (".md", 1), "deep/er/and/g.py": (".py", 5), "noext": ("", 1)}
    # every folder once, however many the driver listed itself
    for most in (0, 1, 3, 1000):
        reader = tree.TreeReader({"path": str(tmp_path)})
        before, tree.MOST_LISTED = tree.MOST_LISTED, most
        try:
            parts = reader.partitions()
        finally:
            tree.MOST_LISTED = before
        assert sorted(x[0] for p in parts for x in reader.read(p)) == sorted(got)
    assert tree.listing(spark, str(tmp_path / "nowhere")).count() == 0


def test_filters_are_taken_by_the_source(spark, tmp_path):
    put(tmp_path, {"a.py": "x" * 10, "b.ts": "y" * 20, "c.py": "z" * 30})
    reader = tree.PushedTreeReader({"path": str(tmp_path)})
    other = EqualTo(("path",), "a.py")
    left = list(reader.pushFilters([In(("extension",), (".py", ".go")), LessThanOrEqual(("length",), 30), LessThan(("length",), 30), GreaterThan(("length",), 5), other]))
    assert left == [other] and [x[0] for p in reader.partitions() for x in reader.read(p)] == ["a.py"]
    key = "spark.sql.python.filterPushdown.enabled"
    for pushdown in (False, True):
        spark.conf.set(key, str(pushdown).lower())
        try:
            files = tree.listing(spark, str(tmp_path), pushdown=pushdown).where("extension = '.py' and length < 20")
            assert [r.path for r in files.collect()] == ["a.py"]
        finally:
            spark.conf.unset(key)
    assert [r.path for r in tree.listing(spark, str(tmp_path), extensions=(".py", ".go"), most_bytes=20).collect()] == ["a.py"]


def test_trees_are_written_and_read_by_tasks(spark, tmp_path):
    rows = [(f"d{i % 5}/f{i}.py", f"v = {i}\n") for i in range(40)] + [("e.py", None), ("u.py", "é = 1")]
    files = spark.createDataFrame(rows, "path string, content string").repartition(3)
    assert tree.write_tree(files, str(tmp_path)).agg(F.sum("length")).first()[0] == sum(len((c or "").encode()) for _, c in rows)
    back = {r.path: r.content for r in ingest.scan(spark, f"file://{tmp_path}").collect()}
    assert back == {p: c or "" for p, c in rows}
    (tmp_path / "bad.py").write_bytes(b"\xff\xfe")
    assert ingest.scan(spark, str(tmp_path)).where("content is null").first().path == "bad.py"


def words(path, content):
    from loomgraph.sources.collect import Rows

    out = Rows(path, content, "words", False)
    for w in content.split():
        out.node("Variable", w, content.index(w), content.index(w) + len(w))
    return out.rows


def test_extraction_in_sql_equals_extract(spark):
    rows = [("a.py", "def f(x):\n    return g(x)\n\nclass C:\n    def m(self): pass\n"), ("b.go", "package b\nfunc H() { K() }\n"), ("c.ts", "export function t() { return u(); }"), ("bad.py", "def ("), ("none.py", None), ("notes.txt", "x"), (None, "y"), ("w.words", "one two")]
    files = spark.createDataFrame(rows, "path string, content string")
    files.createOrReplaceTempView("tf_files")
    table_function.register(spark, "tf_extract", {".words": words})
    want = ingest.extract(files.where("path like '%.py' or path like '%.go' or path like '%.ts'"))
    shown = ["tag", "id", "label", "name", "file_path", "start_byte", "line_number", "is_test", "type", "src_id", "dst_ref", "error"]
    got = spark.sql("select t.* from tf_files f, lateral tf_extract(f.path, f.content) t where f.path not like '%.words'")
    assert got.columns == want.columns
    plain = lambda df: sorted((tuple(map(str, r)) for r in df.select(shown).collect()))
    assert plain(got.fillna(False, ["is_test"])) == plain(want.fillna(False, ["is_test"]))
    assert {r.name for r in spark.sql("select t.name from tf_files f, lateral tf_extract(f.path, f.content, what => 'nodes') t where f.path = 'w.words'").collect()} == {"one", "two"}
    edges = spark.sql("select t.* from tf_files f, lateral tf_extract(f.path, f.content, what => 'edges') t")
    assert "dst_ref" in edges.columns and "label" not in edges.columns and edges.count() > 2
    assert {r.file_path for r in spark.sql("select t.* from tf_files f, lateral tf_extract(f.path, f.content, what => 'errors') t").collect()} == {"bad.py", "none.py"}
