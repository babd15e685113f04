"""What keeps the work of a query in proportion to its input: how it is dealt, read once, and held in slices."""

from __future__ import annotations

import pytest

from loomgraph.plans import extraction, queries
from loomgraph.sources import ingest
from loomgraph.sources.folders import staged

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["ex27_ts_decorators", "ex29_ts_generics", "ex33_ts_routes", "ex_varied_constructs", "ex28_ts_namespaces"])
def test_a_tree_is_extracted_once_and_by_many_tasks(spark, name):
    df = queries()[name](spark, SF)
    text = plan_of(df)
    assert text.count("MapInArrow") == 1 and "Join" not in text
    assert "RepartitionByExpression [n" in text


def test_extraction_of_what_is_asked_for_is_the_same(spark):
    files = extraction.sources(spark, SF, "ts", "ts_test", "py", "go")
    rows = ingest.extract(files).where("tag <> 'error'").localCheckpoint()
    got = ingest.extract(files, ("Class",), ("CALLS",)).localCheckpoint()
    key = lambda df: sorted((r.tag, r.id, r.name or "", r.dst_ref or "", sorted(r.props.items())) for r in df.collect())
    assert key(got.where("label = 'Class'")) == key(rows.where("label = 'Class'")) and key(got.where("tag = 'edge'")) == key(rows.where("type = 'CALLS'"))
    ends = {r.src_id for r in got.where("tag = 'edge'").collect()}
    assert ends <= {r.id for r in got.where("tag = 'node'").collect()}
    assert got.where("label = 'Import'").isEmpty()


def test_rows_leave_extraction_in_slices(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ingest, "ROWS_AT_ONCE", 10)
    held = []

    class Files:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            text = "def f(): return g()\n" * 30
            held.extend(run([pa.record_batch({"path": ["a.py", "b.py"], "content": [text, None]})]))

    ingest.extract(Files())
    assert max(b.num_rows for b in held) == 10 and sum(b.num_rows for b in held) == 62


def test_satisfaction_is_held_by_classes(spark, tmp_path):
    """n structs and n interfaces of equal methods are one link, not n * n edges, also at rest; read edges are all there."""
    from loomgraph.graph import Graph
    from loomgraph.sources.folders import staged

    one = "package p\ntype S{0} struct {{}}\nfunc (s S{0}) Save() {{}}\nfunc (s S{0}) Close() {{}}\ntype I{0} interface {{\n\tSave()\n\tClose()\n}}\ntype J{0} interface {{\n\tSave()\n\tOther()\n}}\n"
    files = spark.createDataFrame([(f"a/f{n}.go", one.format(n)) for n in range(12)], "path string, content string")
    g, _, _ = ingest.graph_of(staged(ingest.extract(files), "rows"))
    assert g.classes[2].count() == 1 and g.listed.where("type = 'IMPLEMENTS'").isEmpty()
    assert g.rel("IMPLEMENTS").select("src_id", "dst_id").distinct().count() == g.rel("IMPLEMENTS").count() == 144
    assert "Join" not in plan_of(g.rel("CALLS", "TESTS"))
    g.write(str(tmp_path / "g"))
    back = Graph.read(spark, str(tmp_path / "g"))
    key = lambda x: sorted(map(tuple, x.edges.select("type", "src_id", "dst_id", "src_label", "dst_label").distinct().collect()))
    assert key(back) == key(g) and not (tmp_path / "g/edges/type=IMPLEMENTS").exists()


def test_postings_are_lists_beside_their_files(spark, tmp_path):
    """One row for each trigram of a segment, not one for each trigram of a file, and only changed files' buckets are written again."""
    from loomgraph.plans import text_index

    frame = lambda text: spark.createDataFrame([(f"f{i}", text) for i in range(200)], "path string, content string")
    store = text_index.update_index(spark, str(tmp_path), 0, frame("abcdef"), frame("abcdef"), 2)
    lists = store.read("postings", text_index.POSTINGS)
    assert lists.count() <= 4 * 2 * text_index.SEGMENTS
    assert lists.selectExpr("explode(paths) as p").count() == 800
    store = text_index.update_index(spark, str(tmp_path), 1, frame("").limit(1), frame("xyz").limit(1), 2)
    assert sorted(store.now["postings"].values()) == [0, 1] and sorted(store.now["files"].values()) == [0, 1]
    assert text_index.search(spark, str(tmp_path), "xyz", most=None).count() == 1 and text_index.search(spark, str(tmp_path), "cde", most=None).count() == 199


def test_rows_that_are_there_once_are_not_sorted(spark):
    """Whole rows are sorted for their ids only where one is repeated; then each is there once, as before."""
    files = spark.createDataFrame([("a.ts", "export function f() { return g(); }\nfunction g() {}\n"), ("b.ts", "export { f } from './a';\n")], "path string, content string")
    rows = staged(ingest.extract(files), "rows")
    assert not any(x in plan_of(ingest.once(rows)) for x in ("Join", "Aggregate"))
    again = staged(rows.unionByName(rows), "rows")
    key = lambda df: sorted((r.tag, r.id) for r in df.collect())
    assert key(ingest.once(again)) == key(ingest.once(rows)) == sorted({(r.tag, r.id) for r in rows.collect()})
    one, two = ingest.graph_of(rows)[0], ingest.graph_of(again)[0]
    pairs = lambda g: sorted(map(tuple, g.edges.select("type", "src_id", "dst_id").collect()))
    assert pairs(one) == pairs(two) and one.nodes.count() == two.nodes.count()


def test_references_join_only_what_is_sought(spark):
    """Edges of types without a node at their place pass by the joins, and the schema's pairs start no Python worker."""
    from loomgraph.schema import allowed_pairs
    from loomgraph.sources import linking

    files = spark.createDataFrame([("a.tsx", "export function P(p) { return <div/>; }\n"), ("b.tsx", "export * from './a';\nfunction q() { return <P x='1'/>; }\nq();\n")], "path string, content string")
    rows = staged(ingest.extract(files), "rows")
    nodes, raw = rows.where("tag = 'node'"), rows.where("tag = 'edge'").select("id", "type", "src_id", "dst_ref", "file_path", "start_byte", "props")
    out, count = linking.placed(raw, nodes), lambda df: sorted((r.id, r.type) for r in df.collect())
    assert count(out.where("not optional")) == count(raw) == count(linking.re_exports(raw, nodes))
    left = plan_of(out).split("Join LeftOuter")[1]
    assert "RENDERS_JSX" in left.split("Relation")[0]
    assert "ExistingRDD" not in plan_of(allowed_pairs(spark)) and "LogicalRDD" not in plan_of(allowed_pairs(spark))


def test_pairs_of_few_values_are_dealt_to_many_tasks(spark):
    """Where one name is shared by all rows its pairs are many tasks' work; each is there as often as in a join, null meets nothing."""
    from pyspark.sql import functions as F

    from loomgraph.operators.patterns import every_pair

    a = spark.createDataFrame([(i % 97, "x" if i < 100 else None if i < 110 else "y") for i in range(120)], "a long, name string")
    b = spark.createDataFrame([(i, "x" if i < 50 else None if i < 60 else "z") for i in range(70)], "b long, name string")
    got = every_pair(a, b, "name", 8, 16)
    key = lambda df: sorted((r.name, r.a, r.b) for r in df.collect())
    assert got.columns == ["name", "a", "b"] and key(got) == key(a.join(b, "name"))
    rows = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 5000 and len(rows) > 8 and max(rows) < 2500
    for name in ("j21_tests_by_target_name", "j22_tests_api"):
        assert plan_of(queries()[name](spark, SF)).count("RepartitionByExpression [") == 2


def test_pairs_come_by_lists_and_are_small_in_files(spark, tmp_path):
    """Equal rows and nulls keep their number, a condition is asked of lists, no task has most pairs, and a file of them takes few bits for each."""
    from pyspark.sql import functions as F

    from loomgraph.operators.patterns import every_pair

    a = spark.range(4000).select(F.concat(F.lit("x"), F.col("id") % 2).alias("name"), F.concat(F.lit("test:"), F.col("id") % 3997).alias("a"), (F.col("id") % 3).alias("la"))
    b = spark.range(4000).select(F.concat(F.lit("x"), F.col("id") % 2).alias("name"), F.when(F.col("id") != 7, F.concat(F.lit("fn:"), "id")).alias("b"), (F.col("id") % 3).alias("lb"))
    got = every_pair(a, b, "name", 4, 4, alike=("la", "lb"), where="la <> lb")
    sums = lambda df: df.agg(F.count("*"), F.count("b"), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()
    assert got.columns == ["name", "a", "la", "b", "lb"] and sums(got) == sums(a.join(b, "name").where("la <> lb"))
    got.select("a", "b").write.parquet(str(tmp_path / "pairs"))
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * got.count()
    dealt = [r["count"] for r in every_pair(a, b, "name", 4, 4).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(dealt) == 8_000_000 and max(dealt) < 2_000_000
