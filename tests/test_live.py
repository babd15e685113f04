"""A live graph and its derived edges against what a rebuild gives."""

import random

from pyspark.sql import functions as F

from loomgraph.operators import resolve as R
from loomgraph.schema import NODE_DDL, RAW_EDGE_DDL, conform
from loomgraph.sources import derive
from loomgraph.sources.folders import shared_dir
from loomgraph.sources.ingest import extract
from loomgraph.streaming import derived, live_graph
from loomgraph.streaming.store import BucketStore, latest

RND = random.Random(5)
PAIRS = "src_id string, dst_id string, n bigint"


def a_file(test=False):
    if test:
        return "".join(f"def test_t{i}():\n    assert f{RND.randint(0, 6)}() == 1\n\n" for i in range(2))
    lines = []
    for _ in range(RND.randint(1, 3)):
        lines += [f"def f{RND.randint(0, 6)}():", f"    return {RND.choice(['f', 'C0.m', 'g'])}{RND.randint(0, 6)}()", ""]
    if RND.random() < 0.4:
        lines += ["class C0:", f"    def m{RND.randint(0, 2)}(self):", f"        return self.m{RND.randint(0, 2)}()", ""]
    return "\n".join(lines)


def rebuilt(spark, files):
    rows = extract(spark.createDataFrame(sorted(files.items()), "path string, content string")).cache()
    nodes = conform(rows.where("tag = 'node'"), NODE_DDL)
    return R.resolve(conform(rows.where("tag = 'edge'"), RAW_EDGE_DDL).dropDuplicates(["id"]), nodes)


def test_live_graph_equals_a_rebuild(spark):
    path, files, done = shared_dir(spark, "live"), {}, []
    names = [f"{d}/{x}.py" for d in ("a", "b") for x in "pqrs"] + ["tests/test_v.py", "tests/test_w.py"]
    read = lambda wanted: spark.createDataFrame([(p, files[p]) for p in files], "path string, content string").join(wanted.select("path"), "path", "left_semi")
    for number in range(5):
        changes = []
        for p in RND.sample(names, 7 if number == 0 else 3):
            if p in files and RND.random() < 0.3:
                del files[p]
                changes.append((p, "Deleted", number))
            else:
                files[p] = a_file(p.startswith("tests/"))
                changes.append((p, "Modified", number))
        batch = spark.createDataFrame(changes, "path string, change_type string, ts int")
        done.append(live_graph.apply_batch(spark, batch, number, read, path, buckets=8))
        if number == 3:  # a batch that is done again
            done[-1] = live_graph.apply_batch(spark, batch, number, read, path, buckets=8)
        if number in (1, 4):
            want, lost = rebuilt(spark, files)
            shown = ["id", "type", "src_id", "dst_id", "src_label", "dst_label", "strategy", "cross_file_edge"]
            assert sorted(map(tuple, live_graph.answers(spark, path).select(shown).collect())) == sorted(map(tuple, want.select(shown).collect()))
            covered = derive.indirect_covers(want.where("type = 'TESTS'"), want.where("type = 'CALLS'"))
            through = live_graph.read(spark, path).rel("COVERS").where("coverage_type = 'indirect'").select("src_id", "dst_id")
            assert sorted(map(tuple, through.collect())) == sorted(map(tuple, covered.collect()))
            assert sorted(map(tuple, live_graph.rejected(spark, path).select("id", "reason").collect())) == sorted(map(tuple, lost.select("id", "reason").collect()))
    assert sum(d["elsewhere"] for d in done) > 0
    assert live_graph.read(spark, path).scan("File").count() == len(files)


def test_a_small_change_reads_few_buckets(spark):
    path, n = shared_dir(spark, "live"), 200
    files = {f"d{i}/m{i}.py": f"def only{i}():\n    return only{(i + 1) % n}()\n" for i in range(n)}
    read = lambda wanted: spark.createDataFrame(list(files.items()), "path string, content string").join(wanted.select("path"), "path", "left_semi")
    first = live_graph.apply_batch(spark, spark.createDataFrame([(p, "Added", 0) for p in files], "path string, change_type string, ts int"), 0, read, path, buckets=50)
    assert first["resolved"] == n and first["elsewhere"] == 0
    files["d7/m7.py"] = "\n" + files["d7/m7.py"]
    store = BucketStore(spark, path, 1, 50)
    rows = extract(read(spark.createDataFrame([("d7/m7.py",)], "path string")))
    done = live_graph.update(store, spark.createDataFrame([("d7/m7.py",)], "file_path string"), rows.where("tag = 'node'"), rows.where("tag = 'edge'"))
    store.commit()
    assert done["files"] == 1 and done["resolved"] == 2 and done["elsewhere"] == 1
    assert len(store.asked["nodes"]) == 1 and len(store.asked["refs"]) <= 2 and len(store.asked["answers"]) <= 2 and max(len(store.asked[t]) for t in ("keys", "looks")) <= 25
    assert live_graph.answers(spark, path).count() == n


def test_streamed_changes_keep_the_graph(spark, tmp_path):
    from loomgraph.streaming.changes import relevant

    root, path = tmp_path / "in", shared_dir(spark, "live")
    root.mkdir()
    files = {"a/x.py": "def f():\n    return g()\n", "a/y.py": "def g():\n    return 1\n"}
    read = lambda wanted: spark.createDataFrame(list(files.items()), "path string, content string").join(wanted.select("path"), "path", "left_semi")

    def run():
        changes = relevant(spark.readStream.schema("path string, change_type string, ts timestamp").json(str(root)))
        live_graph.live_graph(changes, read, path, str(tmp_path / "check"), buckets=4).trigger(availableNow=True).start().awaitTermination()
        return live_graph.answers(spark, path).where("type = 'CALLS'").count()

    (root / "1.json").write_text('{"path": "a/x.py", "change_type": "Added", "ts": "2024-01-01T00:00:00Z"}\n')
    assert run() == 0
    (root / "2.json").write_text('{"path": "a/y.py", "change_type": "Added", "ts": "2024-01-01T00:00:01Z"}\n')
    assert run() == 1
    (root / "3.json").write_text('{"path": "a/y.py", "change_type": "Deleted", "ts": "2024-01-01T00:00:02Z"}\n')
    assert run() == 0


def test_derived_coverage_is_what_a_recomputation_gives(spark):
    path, tests, calls = shared_dir(spark, "derived"), [], []
    for number in range(4):
        gone_t, gone_c = [x for x in tests if RND.random() < 0.3], [x for x in calls if RND.random() < 0.3]
        for x in gone_t:
            tests.remove(x)
        for x in gone_c:
            calls.remove(x)
        more_t, more_c = [(f"t{RND.randint(0, 4)}", f"f{RND.randint(0, 9)}") for _ in range(4)], [(f"f{RND.randint(0, 9)}", f"f{RND.randint(0, 9)}") for _ in range(8)]
        tests += more_t
        calls += more_c
        delta = lambda plus, minus: spark.createDataFrame([(*x, 1) for x in plus] + [(*x, -1) for x in minus], PAIRS)
        store = BucketStore(spark, path, number, 8)
        derived.coverage_changed(store, delta(more_t, gone_t), delta(more_c, gone_c))
        store.commit()
        frame = lambda rows: spark.createDataFrame(rows, "src_id string, dst_id string")
        want = derive.indirect_covers(frame(tests), frame(calls))
        assert sorted(map(tuple, derived.coverage_of(spark, path).collect())) == sorted(map(tuple, want.collect()))


def test_derived_satisfaction_is_what_a_recomputation_gives(spark):
    path, methods, wanted = shared_dir(spark, "derived"), [], []
    for number in range(4):
        deltas = []
        for rows, kind in ((methods, "s"), (wanted, "i")):
            gone = [x for x in rows if RND.random() < 0.3]
            for x in gone:
                rows.remove(x)
            more = [(f"{kind}{RND.randint(0, 3)}", f"m{RND.randint(0, 3)}") for _ in range(7 if kind == "s" else 3)]
            rows += more
            deltas.append([(*x, 1) for x in more] + [(*x, -1) for x in gone])
        store = BucketStore(spark, path, number, 4)
        derived.satisfaction_changed(store, spark.createDataFrame(deltas[0], derived.METHOD), spark.createDataFrame(deltas[1], derived.WANTED))
        store.commit()
        want = derive.satisfied(spark.createDataFrame(methods, "struct string, method string"), spark.createDataFrame(wanted, "interface string, method string"))
        assert sorted(map(tuple, derived.satisfaction_of(spark, path).collect())) == sorted(map(tuple, want.select("struct", "interface").collect()))


def test_a_store_is_whole_or_as_before(spark):
    path = shared_dir(spark, "store")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    s = BucketStore(spark, path, 0, 4)
    s.put("t", rows(*range(20)), [0, 1, 2, 3], "k")
    assert latest(spark, path).read("t", "k int").count() == 0
    s.commit()
    s = BucketStore(spark, path, 1, 9)
    assert s.buckets == 4 and sorted(r.k for r in s.read("t", "k int").collect()) == list(range(20))
    at = s.touched(rows(3), "k")
    s.put("t", s.read("t", "k int", at).where("k <> 3"), at, "k")
    assert latest(spark, path).read("t", "k int").count() == 20
    s.commit()
    s.commit()
    assert latest(spark, path).read("t", "k int").where(F.col("k") == 3).count() == 0 and latest(spark, path).read("t", "k int").count() == 19
